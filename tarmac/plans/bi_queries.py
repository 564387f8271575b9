"""Dashboard queries (P1-P3, A1-A8, A13-A18, T1-T5, W1, S6) with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.operators import abc, bi
from tarmac.plans.registry import msum, register
from tarmac.sources.tables import sales_view

# Parameters of the registered queries on the given tables (orders span 1995-2001;
# 2001 is partial, so the YoY pair is 2000 over 1999).
CUR_YEAR, BASE_YEAR = 2000, 1999
F_YEAR, F_CATEGORY, F_REGION = 1998, "PROMO", "ASIA"

# S6 product classes in SQL (unrounded share), and the fact with its class.
ABC_CTES = f"""
prod AS (SELECT Product_Name AS name, SUM(CAST(Revenue AS DECIMAL(28,8))) AS rev
         FROM sales WHERE Product_Name IS NOT NULL GROUP BY 1),
cum AS (SELECT name, CAST(SUM(rev) OVER (ORDER BY rev DESC, name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
                     / CAST(SUM(rev) OVER () AS DOUBLE) AS share FROM prod),
cls AS (SELECT name, CASE WHEN share <= 0.7 THEN 'A' WHEN share <= 0.9 THEN 'B' ELSE 'C' END AS ABC_Class FROM cum),
sales_abc AS (SELECT s.*, c.ABC_Class FROM sales s LEFT JOIN cls c ON s.Product_Name = c.name)"""


def _sales(spark, d):
    return sales_view(spark, d)


def _sales_abc(spark, d):
    return abc.with_abc_class(sales_view(spark, d))


@register("fact_row_count", "SELECT COUNT(*) AS rows FROM sales")
def q_fact_row_count(spark, d):
    return bi.row_count(_sales(spark, d))


@register("filter_values", """
SELECT DISTINCT 'years' AS field, CAST(Year AS VARCHAR) AS value FROM sales WHERE Year IS NOT NULL
UNION SELECT DISTINCT 'categories', Category FROM sales WHERE Category IS NOT NULL
UNION SELECT DISTINCT 'regions', Region FROM sales WHERE Region IS NOT NULL""")
def q_filter_values(spark, d):
    return bi.filter_values(_sales(spark, d))


def _kpi_sql(where: str) -> str:
    return f"""
SELECT round(coalesce({msum()}, 0.0), 2) AS total_revenue,
       CAST(coalesce(SUM(Units_Sold), 0) AS BIGINT) AS total_units,
       COUNT(*) AS total_transactions,
       round(coalesce({msum()}, 0.0) / NULLIF(COUNT(*), 0), 2) AS avg_order_value,
       COUNT(DISTINCT Customer) AS unique_customers,
       (SELECT round(coalesce((coalesce(cur, 0.0) - prv) / NULLIF(prv, 0.0), 0.0), 2) FROM yoy) AS yoy_growth
FROM sales WHERE {where}"""


_YOY_CTE = f"""yoy AS (SELECT coalesce(CAST(SUM(CAST(Revenue AS DECIMAL(28,8))) FILTER (WHERE Year = {CUR_YEAR}) AS DOUBLE), 0.0) AS cur,
                          coalesce(CAST(SUM(CAST(Revenue AS DECIMAL(28,8))) FILTER (WHERE Year = {BASE_YEAR}) AS DOUBLE), 0.0) AS prv
                   FROM sales)"""


@register("kpis", _kpi_sql("TRUE"), _YOY_CTE)
def q_kpis(spark, d):
    return bi.kpis(_sales(spark, d), current_year=CUR_YEAR, base_year=BASE_YEAR)


@register("kpis_filtered", _kpi_sql(f"Year = {F_YEAR} AND Region = '{F_REGION}'"), _YOY_CTE)
def q_kpis_filtered(spark, d):
    return bi.kpis(_sales(spark, d), year=F_YEAR, region=F_REGION, current_year=CUR_YEAR, base_year=BASE_YEAR)


def _share_sql(key: str, where: str) -> str:
    return f"""
SELECT name, round(CAST(r AS DOUBLE), 2) AS revenue, units,
       round(CAST(r AS DOUBLE) / NULLIF(CAST(SUM(r) OVER () AS DOUBLE), 0) * 100, 1) AS pct
FROM (SELECT {key} AS name, SUM(CAST(Revenue AS DECIMAL(28,8))) AS r, CAST(SUM(Units_Sold) AS BIGINT) AS units
      FROM sales WHERE {key} IS NOT NULL AND {where} GROUP BY 1) g"""


@register("revenue_by_category", _share_sql("Category", f"Year = {F_YEAR - 1}"))
def q_revenue_by_category(spark, d):
    return bi.revenue_share(_sales(spark, d), "Category", year=F_YEAR - 1)


@register("revenue_by_region", _share_sql("Region", "TRUE"))
def q_revenue_by_region(spark, d):
    return bi.revenue_share(_sales(spark, d), "Region")


def _trend_sql(where: str) -> str:
    return f"""
SELECT strftime(Date, '%Y-%m') AS month, round({msum()}, 2) AS revenue, CAST(SUM(Units_Sold) AS BIGINT) AS units
FROM sales WHERE {where} GROUP BY 1"""


@register("trend_monthly", _trend_sql("TRUE"))
def q_trend_monthly(spark, d):
    return bi.trend_monthly(_sales(spark, d))


@register("trend_monthly_filtered", _trend_sql(f"Category = '{F_CATEGORY}' AND Region = 'EUROPE'"))
def q_trend_monthly_filtered(spark, d):
    return bi.trend_monthly(_sales(spark, d), category=F_CATEGORY, region="EUROPE")


@register("trend_last_12", f"""
SELECT * FROM ({_trend_sql('TRUE')}) t ORDER BY month DESC LIMIT 12""")
def q_trend_last_12(spark, d):
    return bi.last_k(bi.trend_monthly(_sales(spark, d)), "month", 12)


def _products_sql(where: str, with_price: bool) -> str:
    price = ", round(avg(Unit_Price), 0) AS avg_price" if with_price else ""
    return f"""
SELECT Product_Name AS name, Category AS category, ABC_Class AS abc, SUM(CAST(Revenue AS DECIMAL(28,8))) AS r,
       round({msum()}, 2) AS revenue, CAST(SUM(Units_Sold) AS BIGINT) AS units{price}
FROM sales_abc WHERE Product_Name IS NOT NULL AND Category IS NOT NULL AND {where} GROUP BY 1, 2, 3"""


@register("products_top", f"""
SELECT name, category, abc, revenue, units, CAST(row_number() OVER (ORDER BY r DESC, name) AS INTEGER) AS rank
FROM ({_products_sql('TRUE', False)}) g ORDER BY r DESC, name LIMIT 10""", ABC_CTES)
def q_products_top(spark, d):
    return bi.products_top(_sales_abc(spark, d), n=10, by="revenue")


@register("products_top_units", f"""
SELECT name, category, abc, revenue, units, CAST(row_number() OVER (ORDER BY units DESC, name) AS INTEGER) AS rank
FROM ({_products_sql(f'Year = {CUR_YEAR}', False)}) g ORDER BY units DESC, name LIMIT 7""", ABC_CTES)
def q_products_top_units(spark, d):
    return bi.products_top(_sales_abc(spark, d), n=7, by="units", year=CUR_YEAR)


@register("products_all", f"""
SELECT name, category, abc, revenue, units, avg_price FROM ({_products_sql('TRUE', True)}) g""", ABC_CTES)
def q_products_all(spark, d):
    return bi.products_all(_sales_abc(spark, d))


@register("products_sorted", f"""
SELECT name, category, abc, revenue, units, avg_price FROM ({_products_sql(f'Year = {F_YEAR}', True)}) g
ORDER BY units ASC, name""", ABC_CTES)
def q_products_sorted(spark, d):
    return bi.sort_table(bi.products_all(_sales_abc(spark, d), year=F_YEAR), "units", ascending=True,
                         tie_break="name")


_ABC_PRODUCTS_SQL = """
p AS (SELECT Product_Name AS name, SUM(CAST(Revenue AS DECIMAL(28,8))) AS rev FROM sales
      WHERE Product_Name IS NOT NULL AND {where} GROUP BY 1),
c AS (SELECT name, rev, round(CAST(SUM(rev) OVER (ORDER BY rev DESC, name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
                          / CAST(SUM(rev) OVER () AS DOUBLE) * 100, 2) AS cumulative_pct FROM p),
w1 AS (SELECT name, round(CAST(rev AS DOUBLE), 2) AS revenue, cumulative_pct,
              CASE WHEN cumulative_pct <= 70 THEN 'A' WHEN cumulative_pct <= 90 THEN 'B' ELSE 'C' END AS abc, rev FROM c)"""


@register("abc_products", "SELECT name, revenue, cumulative_pct, abc FROM w1",
          _ABC_PRODUCTS_SQL.format(where="TRUE"))
def q_abc_products(spark, d):
    return abc.abc_products(_sales(spark, d))


@register("abc_summary", """
SELECT k.abc, CAST(coalesce(s.cnt, 0) AS BIGINT) AS count, round(coalesce(CAST(s.r AS DOUBLE), 0.0), 2) AS revenue,
       round(coalesce(CAST(s.r AS DOUBLE) / CAST(SUM(s.r) OVER () AS DOUBLE) * 100, 0.0), 1) AS revenue_pct
FROM (VALUES ('A'), ('B'), ('C')) k(abc)
LEFT JOIN (SELECT abc, COUNT(*) AS cnt, SUM(CAST(revenue AS DECIMAL(28,2))) AS r FROM w1 GROUP BY abc) s ON k.abc = s.abc""",
          _ABC_PRODUCTS_SQL.format(where=f"Year = {CUR_YEAR}"))
def q_abc_summary(spark, d):
    return abc.abc_summary(_sales(spark, d), year=CUR_YEAR)


@register("abc_fact_class", """
SELECT Product_Name, ABC_Class, COUNT(*) AS rows FROM sales_abc GROUP BY 1, 2""", ABC_CTES)
def q_abc_fact_class(spark, d):
    s = _sales_abc(spark, d)
    return s.groupBy("Product_Name", "ABC_Class").agg(F.count(F.lit(1)).alias("rows"))


# The values that become columns: the categories and order years of the given tables.
CATEGORIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
YEARS = list(range(1995, 2002))
_CELL = "round(CAST(SUM(CASE WHEN {c} THEN CAST(Revenue AS DECIMAL(28,8)) END) AS DOUBLE){scale}, 2)"


@register("region_category_matrix", "SELECT Region AS region, " + ", ".join(
    f"""coalesce({_CELL.format(c=f"Category = '{c}'", scale='')}, 0.0) AS "{c}\"""" for c in CATEGORIES) + f"""
FROM sales WHERE Region IS NOT NULL AND Category IS NOT NULL AND Year = {CUR_YEAR} GROUP BY Region""")
def q_region_category_matrix(spark, d):
    return bi.region_category_matrix(_sales(spark, d), year=CUR_YEAR, categories=CATEGORIES)


@register("region_category_rollup", f"""
SELECT region, category, revenue, max(CASE WHEN category IS NOT NULL THEN revenue END) OVER () AS max_cell
FROM (SELECT Region AS region, Category AS category, round({msum()}, 2) AS revenue FROM sales
      WHERE Region IS NOT NULL AND Category IS NOT NULL GROUP BY ROLLUP (Region, Category)) r""")
def q_region_category_rollup(spark, d):
    return bi.region_category_rollup(_sales(spark, d))


@register("customers", f"""
SELECT Customer AS customer, Region AS region, round({msum()}, 2) AS revenue, COUNT(*) AS transactions,
       CAST(SUM(Units_Sold) AS BIGINT) AS units
FROM sales WHERE Customer IS NOT NULL AND Region IS NOT NULL AND Year = {CUR_YEAR} GROUP BY 1, 2""")
def q_customers(spark, d):
    return bi.customers_table(_sales(spark, d), year=CUR_YEAR)


@register("customers_region", f"""
SELECT Customer AS customer, Region AS region, round({msum()}, 2) AS revenue, COUNT(*) AS transactions,
       CAST(SUM(Units_Sold) AS BIGINT) AS units
FROM sales WHERE Customer IS NOT NULL AND Region = '{F_REGION}' GROUP BY 1, 2""")
def q_customers_region(spark, d):
    return bi.customers_table(_sales(spark, d), region=F_REGION)


@register("customer_top_products", """
SELECT customer, product, round(CAST(r AS DOUBLE), 2) AS revenue, rank FROM (
  SELECT customer, product, r, CAST(row_number() OVER (PARTITION BY customer ORDER BY r DESC, product) AS INTEGER) AS rank
  FROM (SELECT Customer AS customer, Product_Name AS product, SUM(CAST(Revenue AS DECIMAL(28,8))) AS r FROM sales
        WHERE Customer IS NOT NULL AND Product_Name IS NOT NULL GROUP BY 1, 2) g) t
WHERE rank <= 5""")
def q_customer_top_products(spark, d):
    return bi.customer_top_products(_sales(spark, d), k=5)


@register("popular_by_region", """
SELECT region, product, round(CAST(r AS DOUBLE), 2) AS revenue, rank FROM (
  SELECT region, product, r, CAST(row_number() OVER (PARTITION BY region ORDER BY r DESC, product) AS INTEGER) AS rank
  FROM (SELECT Region AS region, Product_Name AS product, SUM(CAST(Revenue AS DECIMAL(28,8))) AS r FROM sales
        WHERE Region IS NOT NULL AND Product_Name IS NOT NULL GROUP BY 1, 2) g) t
WHERE rank <= 5""")
def q_popular_by_region(spark, d):
    return bi.popular_by_region(_sales(spark, d), n=5)


@register("yoy_by_month", "SELECT strftime(Date, '%m') AS month, " + ", ".join(
    f"""{_CELL.format(c=f"Year = {y}", scale=' / 1e6')} AS "{y}\"""" for y in YEARS) + """
FROM sales WHERE Date IS NOT NULL GROUP BY 1""")
def q_yoy_by_month(spark, d):
    return bi.yoy_by_month(_sales(spark, d), years=YEARS)


@register("customers_top10", f"""
SELECT Customer AS customer, Region AS region, round({msum()}, 2) AS revenue, COUNT(*) AS transactions,
       CAST(SUM(Units_Sold) AS BIGINT) AS units
FROM sales WHERE Customer IS NOT NULL AND Region IS NOT NULL GROUP BY 1, 2
ORDER BY revenue DESC, customer LIMIT 10""")
def q_customers_top10(spark, d):
    return bi.top_customers(_sales(spark, d), 10)


@register("abc_pareto", """
SELECT CASE WHEN length(name) > 18 THEN substring(name, 1, 16) || '…' ELSE name END AS name,
       round(revenue / 1e6, 2) AS revenue, cumulative_pct AS cumulative, abc FROM w1""",
          _ABC_PRODUCTS_SQL.format(where="TRUE"))
def q_abc_pareto(spark, d):
    return abc.pareto_chart(abc.abc_products(_sales(spark, d)))


@register("customers_top10_chart", f"""
SELECT CASE WHEN length(customer) > 22 THEN substring(customer, 1, 20) || '…' ELSE customer END AS name,
       round(revenue / 1e6, 2) AS revenue
FROM (SELECT Customer AS customer, round({msum()}, 2) AS revenue FROM sales
      WHERE Customer IS NOT NULL AND Region IS NOT NULL GROUP BY Customer, Region
      ORDER BY revenue DESC, customer LIMIT 10) t""")
def q_customers_top10_chart(spark, d):
    return bi.top_customers_chart(_sales(spark, d), 10)
