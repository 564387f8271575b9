"""Ad-hoc SQL queries: the flat view (S16), the runner (Q1), the sample
questions (Q2a-f) and the star example queries (Q3a-b).

The same SQL text runs in Spark (through ``run_sql`` on the registered views)
and in DuckDB (over CTEs that define the same views).
"""

from __future__ import annotations

from tarmac.operators import abc
from pyspark.sql import functions as F

from tarmac.operators.adhoc import run_sql, sql_view
from tarmac.plans.bi_queries import ABC_CTES
from tarmac.plans.ingest_queries import flat_sales
from tarmac.plans.registry import register
from tarmac.sources import star
from tarmac.sources.tables import sales_view

FLAT_CTE = ABC_CTES + """,
fact_sales AS (SELECT Transaction_ID AS txn_code, Date AS date, Year AS year, Month AS month,
                      Month_Name AS month_name, Quarter AS quarter, Product_Name AS product_name,
                      Category AS category, Region AS region, Customer AS customer, Units_Sold AS units_sold,
                      Unit_Price AS unit_price, Revenue AS revenue, ABC_Class AS abc_class FROM sales_abc)"""

STAR_CTE = ABC_CTES + """,
dim_date AS (SELECT DISTINCT CAST(strftime(Date, '%Y%m%d') AS INTEGER) AS date_id, Date AS date,
                    CAST(year(Date) AS INTEGER) AS year, CAST(month(Date) AS INTEGER) AS month,
                    strftime(Date, '%b') AS month_name FROM sales),
dim_customer AS (SELECT DISTINCT Customer AS customer_name, Region AS region, Customer AS customer_id FROM sales),
fact_sales AS (SELECT CAST(strftime(Date, '%Y%m%d') AS INTEGER) AS date_id, Customer AS customer_id,
                      Revenue AS revenue FROM sales)"""


def _flat(spark, d):
    sql_view(abc.with_abc_class(sales_view(spark, d)))


def _star(spark, d):
    star.register_star_views(star.build_star(flat_sales(spark, d), ready=True))


def _flat_query(name: str, sql: str):
    def q(spark, d):
        _flat(spark, d)
        return run_sql(spark, sql, max_rows=None)
    register(name, sql, FLAT_CTE)(q)


@register("sql_view", "SELECT * FROM fact_sales", FLAT_CTE)
def q_sql_view(spark, d):
    return sql_view(abc.with_abc_class(sales_view(spark, d)))


ADHOC_TEXT = "```sql\nSELECT txn_code, customer, revenue FROM fact_sales ORDER BY revenue DESC, txn_code\n```"


@register("adhoc_sql", """
SELECT txn_code, customer, revenue FROM fact_sales ORDER BY revenue DESC, txn_code LIMIT 50""", FLAT_CTE)
def q_adhoc_sql(spark, d):
    _flat(spark, d)
    return run_sql(spark, ADHOC_TEXT, max_rows=50)


@register("adhoc_errors", """
SELECT 'SELECT txn_code, units_sold / 0 FROM fact_sales' AS sql, 'DIVIDE_BY_ZERO' AS kind, (SELECT COUNT(*) FROM sales) AS rows
UNION ALL SELECT 'DROP VIEW fact_sales', 'NOT_A_QUERY', (SELECT COUNT(*) FROM sales)
UNION ALL SELECT 'SELECT nope FROM fact_sales', 'UNRESOLVED_COLUMN', (SELECT COUNT(*) FROM sales)""")
def q_adhoc_errors(spark, d):
    """Q1: an error of the run, a command and an unknown column give error rows; the view is still there afterwards."""
    _flat(spark, d)
    texts = ["SELECT txn_code, units_sold / 0 FROM fact_sales", "```sql\nDROP VIEW fact_sales\n```",
             "SELECT nope FROM fact_sales"]
    errors = [run_sql(spark, t) for t in texts]
    rows = run_sql(spark, "SELECT COUNT(*) AS rows FROM fact_sales").first()[0]
    found = errors[0].unionByName(errors[1]).unionByName(errors[2])
    return found.select("sql", F.regexp_extract("error", r"\[([A-Z_]+)", 1).alias("kind"),
                        F.lit(rows).cast("long").alias("rows"))


# Q2a, Q2b, Q2c, Q2d, Q2e, Q2f: the UI's sample questions, written as SQL over
# the view (the text-to-SQL step itself is a remote model and is not built).
_flat_query("q_top_customers_region", """
SELECT customer, round(SUM(revenue), 2) AS revenue FROM fact_sales WHERE region = 'MIDDLE EAST'
GROUP BY customer ORDER BY revenue DESC, customer LIMIT 5""")

_flat_query("q_trend_category_year", """
SELECT month, round(SUM(revenue), 2) AS revenue FROM fact_sales WHERE category = 'ECONOMY' AND year = 2000
GROUP BY month ORDER BY month""")

_flat_query("q_class_a", """
SELECT DISTINCT product_name FROM fact_sales WHERE abc_class = 'A' ORDER BY product_name""")

_flat_query("q_avg_price_region", """
SELECT region, round(AVG(unit_price), 2) AS avg_price FROM fact_sales GROUP BY region ORDER BY avg_price DESC""")

_flat_query("q_units_quarter", """
SELECT quarter, CAST(SUM(units_sold) AS BIGINT) AS total_units FROM fact_sales GROUP BY quarter ORDER BY quarter""")

_flat_query("q_busy_customers", """
SELECT customer, COUNT(*) AS transactions FROM fact_sales GROUP BY customer HAVING COUNT(*) > 70
ORDER BY transactions DESC, customer""")


def _star_query(name: str, sql: str):
    def q(spark, d):
        _star(spark, d)
        return run_sql(spark, sql, max_rows=None)
    register(name, sql, STAR_CTE)(q)


# The example queries over the star schema.
_star_query("star_revenue_month", """
SELECT d.year, d.month_name, round(SUM(f.revenue), 2) AS revenue
FROM fact_sales f JOIN dim_date d ON f.date_id = d.date_id GROUP BY 1, 2""")

_star_query("star_top_customers", """
SELECT c.customer_name, c.region, round(SUM(f.revenue), 2) AS revenue
FROM fact_sales f JOIN dim_customer c ON f.customer_id = c.customer_id
GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 10""")
