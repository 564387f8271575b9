"""Ingest, validation, star schema and export queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.operators import abc
from tarmac.plans.bi_queries import ABC_CTES
from tarmac.plans.registry import register
from tarmac.sources import ingest, sinks, star, star_store
from tarmac.sources.tables import read_table, sales_view


def flat_sales(spark, d):
    """The sales with their classes, worked out once and stored, for a star's tables to read."""
    return abc.with_abc_class(sales_view(spark, d, by_order=True), store="star-sales")


def raw_sales(spark, d):
    """The sales view under raw alias names, plus one unknown column."""
    s = sales_view(spark, d)
    return s.select(F.col("Transaction_ID").alias("txn_id"), F.col("Date").alias("transaction_date"),
                    F.col("Product_Name").alias("product"), F.col("Category").alias("category"),
                    F.col("Region").alias("region"), F.col("Customer").alias("client"),
                    F.col("Units_Sold").alias("quantity"), F.col("Unit_Price").alias("price"),
                    F.col("Month_Name").alias("note"))


@register("map_columns", """
SELECT Transaction_ID, Date, Product_Name, Category, Region, Customer, Units_Sold, Unit_Price, Month_Name AS note
FROM sales""")
def q_map_columns(spark, d):
    return ingest.map_columns(raw_sales(spark, d))


def _raw_lineitem(spark, d):
    """A raw file with only date, product, category and quantity (read order = file order)."""
    li = ingest.numbered(read_table(spark, d, "lineitem"))
    return li.select("_pos", F.col("l_shipdate").alias("date"),
                     F.format_string("Part %d", "l_partkey").alias("product"),
                     F.col("l_returnflag").alias("category"),
                     F.col("l_quantity").alias("quantity"))


@register("fill_defaults", """
SELECT printf('TXN-%05d', row_number() OVER ()) AS Transaction_ID,
       CAST(l_shipdate AS DATE) AS Date, CAST(year(l_shipdate) AS INTEGER) AS Year,
       CAST(month(l_shipdate) AS INTEGER) AS Month, strftime(CAST(l_shipdate AS DATE), '%b') AS Month_Name,
       'Q' || CAST(quarter(l_shipdate) AS VARCHAR) AS Quarter, printf('Part %d', l_partkey) AS Product_Name,
       l_returnflag AS Category, 'Other' AS Region, 'Unknown Customer' AS Customer,
       CAST(l_quantity AS INTEGER) AS Units_Sold,
       coalesce(CASE l_returnflag WHEN 'Engine' THEN 12000.0 WHEN 'Avionics' THEN 8000.0 WHEN 'Airframe' THEN 6000.0
                WHEN 'Landing Gear' THEN 5000.0 WHEN 'Cabin' THEN 3000.0 WHEN 'Other' THEN 4000.0 END, 38000.0 / 6) AS Unit_Price,
       l_quantity * coalesce(CASE l_returnflag WHEN 'Engine' THEN 12000.0 WHEN 'Avionics' THEN 8000.0
                WHEN 'Airframe' THEN 6000.0 WHEN 'Landing Gear' THEN 5000.0 WHEN 'Cabin' THEN 3000.0
                WHEN 'Other' THEN 4000.0 END, 38000.0 / 6) AS Revenue,
       CAST(NULL AS VARCHAR) AS ABC_Class
FROM lineitem""")
def q_fill_defaults(spark, d):
    return ingest.conform(_raw_lineitem(spark, d))


@register("raw_defaults", """
SELECT printf('TXN-%05d', pos + 1) AS Transaction_ID, d AS Date, CAST(year(d) AS INTEGER) AS Year,
       CAST(month(d) AS INTEGER) AS Month, strftime(d, '%b') AS Month_Name,
       'Q' || CAST(quarter(d) AS VARCHAR) AS Quarter, printf('Part %d', l_partkey) AS Product_Name,
       'Cabin' AS Category, 'Other' AS Region, 'Unknown Customer' AS Customer, 1 AS Units_Sold,
       CAST(3000.0 AS DOUBLE) AS Unit_Price, CAST(3000.0 AS DOUBLE) AS Revenue, CAST(NULL AS VARCHAR) AS ABC_Class
FROM (SELECT *, DATE '2022-01-01' + CAST(pos AS INTEGER) AS d
      FROM (SELECT l_partkey, row_number() OVER () - 1 AS pos FROM lineitem))""")
def q_raw_defaults(spark, d):
    """S5a, S5b, S5e, S5f: a raw file without ids, dates and quantities; ids and dates follow the file, prices the table."""
    rows = ingest.numbered(read_table(spark, d, "lineitem"))
    return ingest.conform(rows.select(F.format_string("Part %d", "l_partkey").alias("product"),
                                      F.lit("Cabin").alias("category"), "_pos"))


@register("validate_batch", """
SELECT rule, CAST(violations AS BIGINT) AS violations FROM (
  SELECT * FROM (VALUES ('required_columns', 0)) t(rule, violations)
  UNION ALL SELECT 'revenue_positive', count_if(NOT coalesce(Revenue > 0, false)) FROM sales
  UNION ALL SELECT 'units_at_least_one', count_if(NOT coalesce(Units_Sold >= 1, false)) FROM sales
  UNION ALL SELECT 'unique_transaction_id', COUNT(*) - COUNT(DISTINCT Transaction_ID) FROM sales
  UNION ALL SELECT 'revenue_matches', count_if(NOT coalesce(abs(Revenue - Unit_Price * Units_Sold) < 1, false)) FROM sales)""")
def q_validate_batch(spark, d):
    return ingest.validate_batch(sales_view(spark, d)).drop("passed")


_DIM_CTES = """
fp AS (SELECT Product_Name AS product_name, min(strftime(Date, '%Y%m%d') || '|' || Transaction_ID) AS k,
              arg_min(Category, strftime(Date, '%Y%m%d') || '|' || Transaction_ID) AS category,
              arg_min(ABC_Class, strftime(Date, '%Y%m%d') || '|' || Transaction_ID) AS abc_class
       FROM sales_abc WHERE Product_Name IS NOT NULL GROUP BY 1),
dp AS (SELECT CAST(row_number() OVER (ORDER BY k, product_name) AS BIGINT) AS product_id, product_name, category,
              CAST(0.0 AS DOUBLE) AS base_price, abc_class FROM fp),
fc AS (SELECT Customer AS customer_name, min(strftime(Date, '%Y%m%d') || '|' || Transaction_ID) AS k,
              arg_min(Region, strftime(Date, '%Y%m%d') || '|' || Transaction_ID) AS region
       FROM sales WHERE Customer IS NOT NULL GROUP BY 1),
dc AS (SELECT CAST(row_number() OVER (ORDER BY k, customer_name) AS BIGINT) AS customer_id, customer_name, region FROM fc)"""


@register("dim_product", "SELECT * FROM dp", ABC_CTES + "," + _DIM_CTES)
def q_dim_product(spark, d):
    return star.dim_product(abc.with_abc_class(sales_view(spark, d)))


@register("dim_customer", "SELECT * FROM dc", ABC_CTES + "," + _DIM_CTES)
def q_dim_customer(spark, d):
    return star.dim_customer(sales_view(spark, d))


@register("dim_date", """
SELECT DISTINCT CAST(strftime(Date, '%Y%m%d') AS INTEGER) AS date_id, Date AS date, CAST(year(Date) AS INTEGER) AS year,
       CAST(month(Date) AS INTEGER) AS month, 'Q' || CAST(quarter(Date) AS VARCHAR) AS quarter,
       strftime(Date, '%b') AS month_name
FROM sales WHERE Date IS NOT NULL""")
def q_dim_date(spark, d):
    return star.dim_date(sales_view(spark, d))


# Customers first seen up to 1998 are stored; a later load inserts only the absent ones.
_INSERT_CTES = """
old AS (SELECT * FROM sales WHERE Year <= 1998),
fo AS (SELECT Customer AS customer_name, min(strftime(Date, '%Y%m%d') || '|' || Transaction_ID) AS k,
              arg_min(Region, strftime(Date, '%Y%m%d') || '|' || Transaction_ID) AS region
       FROM old WHERE Customer IS NOT NULL GROUP BY 1),
dold AS (SELECT CAST(row_number() OVER (ORDER BY k, customer_name) AS BIGINT) AS customer_id, customer_name, region FROM fo),
fn AS (SELECT Customer AS customer_name, min(strftime(Date, '%Y%m%d') || '|' || Transaction_ID) AS k,
              arg_min(Region, strftime(Date, '%Y%m%d') || '|' || Transaction_ID) AS region
       FROM sales WHERE Customer IS NOT NULL AND Customer NOT IN (SELECT customer_name FROM dold) GROUP BY 1),
dnew AS (SELECT CAST((SELECT max(customer_id) FROM dold) + row_number() OVER (ORDER BY k, customer_name) AS BIGINT)
                AS customer_id, customer_name, region FROM fn)"""


@register("dim_insert_absent", "SELECT * FROM dold UNION ALL SELECT * FROM dnew", _INSERT_CTES)
def q_dim_insert_absent(spark, d):
    s = sales_view(spark, d)
    old = star.dim_customer(s.filter(F.col("Year") <= 1998))
    return star.dim_customer(s, existing=old)


@register("star_flat", """
SELECT Transaction_ID, Date, Year, Month, Month_Name, Quarter, Product_Name, Category, ABC_Class, Customer, Region,
       Units_Sold, Unit_Price, Revenue FROM sales_abc""", ABC_CTES)
def q_star_flat(spark, d):
    return star.star_flat(star.build_star(flat_sales(spark, d), ready=True))


@register("star_fact_keys", """
SELECT COUNT(*) AS rows, COUNT(DISTINCT txn_code) AS codes, min(txn_id) AS min_id, max(txn_id) AS max_id
FROM (SELECT Transaction_ID AS txn_code, row_number() OVER (ORDER BY Date, Transaction_ID) AS txn_id FROM sales) f""")
def q_star_fact_keys(spark, d):
    f = star.build_star(flat_sales(spark, d), ready=True)["fact_sales"]
    ids = f.agg(F.count(F.lit(1)).alias("rows"), F.min("txn_id").alias("min_id"), F.max("txn_id").alias("max_id"))
    codes = f.agg(F.count_distinct("txn_code").alias("codes"))  # by itself: only codes are shuffled
    return ids.crossJoin(codes).select("rows", "codes", "min_id", "max_id")


def _merged(spark, d, second):
    """The star after two loads of the sales (rows for which ``second`` holds come later) and a replay of each."""
    from tarmac.session import scratch_path
    base = scratch_path(spark, "star-loads")
    sales = flat_sales(spark, d)  # worked out once for both loads
    halves = [("first", sales.filter(~second)), ("second", sales.filter(second))]
    for name, rows in [*halves, *halves]:
        star_store.merge(rows, base, name, ready=True)
    return star_store.read(spark, base)


# The first load has the even months, so later members and dates fall between earlier ones.
_MERGE_CTES = """
loaded AS (SELECT *, Month % 2 AS second, printf('%d|', Month % 2) || strftime(Date, '%Y%m%d') || '|' || Transaction_ID AS k
           FROM sales_abc),
mp AS (SELECT Product_Name AS product_name, min(k) AS k, arg_min(Category, k) AS category, arg_min(ABC_Class, k) AS abc_class
       FROM loaded WHERE Product_Name IS NOT NULL GROUP BY 1),
dmp AS (SELECT CAST(row_number() OVER (ORDER BY k, product_name) AS BIGINT) AS product_id, * FROM mp),
mc AS (SELECT Customer AS customer_name, min(k) AS k, arg_min(Region, k) AS region
       FROM loaded WHERE Customer IS NOT NULL GROUP BY 1),
dmc AS (SELECT CAST(row_number() OVER (ORDER BY k, customer_name) AS BIGINT) AS customer_id, * FROM mc)"""


@register("star_merge_facts", """
SELECT CAST(row_number() OVER (ORDER BY l.k) AS BIGINT) AS txn_id, l.Transaction_ID AS txn_code,
       CAST(strftime(l.Date, '%Y%m%d') AS INTEGER) AS date_id, p.product_id, c.customer_id,
       l.Units_Sold AS units_sold, l.Unit_Price AS unit_price, l.Revenue AS revenue
FROM loaded l LEFT JOIN dmp p ON l.Product_Name = p.product_name LEFT JOIN dmc c ON l.Customer = c.customer_name""",
          ABC_CTES + "," + _MERGE_CTES)
def q_star_merge_facts(spark, d):
    """Every fact row of two merged loads, with all its keys."""
    return _merged(spark, d, F.col("Month") % 2 == 1)["fact_sales"]


@register("star_merge_members", """
SELECT 'product' AS dimension, product_id AS id, product_name AS name, category AS attribute, abc_class FROM dmp
UNION ALL SELECT 'customer', customer_id, customer_name, region, NULL FROM dmc
UNION ALL SELECT DISTINCT 'date', CAST(strftime(Date, '%Y%m%d') AS BIGINT), strftime(Date, '%Y-%m-%d'),
       strftime(Date, '%b'), NULL FROM sales WHERE Date IS NOT NULL""", ABC_CTES + "," + _MERGE_CTES)
def q_star_merge_members(spark, d):
    """The members of the three dimensions after two merged loads."""
    s = _merged(spark, d, F.col("Month") % 2 == 1)
    none = F.lit(None).cast("string").alias("abc_class")
    return (s["dim_product"].select(F.lit("product").alias("dimension"), F.col("product_id").alias("id"),
                                    F.col("product_name").alias("name"), F.col("category").alias("attribute"), "abc_class")
            .unionByName(s["dim_customer"].select(F.lit("customer").alias("dimension"), F.col("customer_id").alias("id"),
                                                  F.col("customer_name").alias("name"),
                                                  F.col("region").alias("attribute"), none))
            .unionByName(s["dim_date"].select(F.lit("date").alias("dimension"), F.col("date_id").cast("long").alias("id"),
                                              F.col("date").cast("string").alias("name"),
                                              F.col("month_name").alias("attribute"), none)))


@register("star_merge_halves", """
SELECT CAST(row_number() OVER (ORDER BY Date, Transaction_ID) AS BIGINT) AS txn_id, Transaction_ID AS txn_code,
       CAST(strftime(Date, '%Y%m%d') AS INTEGER) AS date_id, p.product_id, c.customer_id,
       Units_Sold AS units_sold, Unit_Price AS unit_price, Revenue AS revenue
FROM sales s LEFT JOIN dp p ON s.Product_Name = p.product_name LEFT JOIN dc c ON s.Customer = c.customer_name""",
          ABC_CTES + "," + _DIM_CTES)
def q_star_merge_halves(spark, d):
    """Two loads, one after the other in time, give the keys of a single load."""
    return _merged(spark, d, F.col("Year") > 1998)["fact_sales"]


@register("kpi_export", f"""
SELECT * FROM (
  SELECT 1 AS position, 'Total Revenue' AS Metric, printf('$%.1fM', r / 1e6) AS Value FROM k
  UNION ALL SELECT 2, 'Total Units', format('{{:,}}', u) FROM k
  UNION ALL SELECT 3, 'Transactions', format('{{:,}}', n) FROM k
  UNION ALL SELECT 4, 'Avg Order Value', '$' || format('{{:,.0f}}', r / n) FROM k
  UNION ALL SELECT 5, 'Customers', CAST(c AS VARCHAR) FROM k)""",
          """k AS (SELECT CAST(SUM(CAST(Revenue AS DECIMAL(28,8))) AS DOUBLE) AS r, CAST(SUM(Units_Sold) AS BIGINT) AS u,
                  COUNT(*) AS n, COUNT(DISTINCT Customer) AS c FROM sales)""")
def q_kpi_export(spark, d):
    return sinks.kpi_export(sales_view(spark, d))


@register("export_customers", """
SELECT Customer, Region, round(CAST(SUM(CAST(Revenue AS DECIMAL(28,8))) AS DOUBLE), 2) AS Revenue,
       COUNT(*) AS Transactions FROM sales WHERE Year = 2000 GROUP BY 1, 2""")
def q_export_customers(spark, d):
    from tarmac.operators.bi import filter_sales
    return sinks.export_sheet("customers", filter_sales(sales_view(spark, d), year=2000))


@register("export_products", """
SELECT Product_Name, Category, ABC_Class, round(CAST(SUM(CAST(Revenue AS DECIMAL(28,8))) AS DOUBLE), 2) AS Revenue,
       CAST(SUM(Units_Sold) AS BIGINT) AS Units, round(avg(Unit_Price), 4) AS AvgPrice
FROM sales_abc GROUP BY 1, 2, 3""", ABC_CTES)
def q_export_products(spark, d):
    sheet = sinks.export_sheet("products", abc.with_abc_class(sales_view(spark, d)))
    return sheet.withColumn("AvgPrice", F.round("AvgPrice", 4))


@register("fact_roundtrip", """
SELECT Transaction_ID, Date, Year, Month, Month_Name, Quarter, Product_Name, Category, Region, Customer,
       Units_Sold, Unit_Price, Revenue, ABC_Class FROM sales_abc""", ABC_CTES)
def q_fact_roundtrip(spark, d):
    from tarmac.session import scratch_path
    from tarmac.sources.fact import materialize_fact, read_fact
    path = scratch_path(spark, "fact")
    materialize_fact(sales_view(spark, d), path)
    return read_fact(spark, path)


@register("csv_ingest", """
SELECT Transaction_ID, Date, Year, Month, Month_Name, Quarter, Product_Name, Category, Region, Customer,
       Units_Sold, Unit_Price, Units_Sold * Unit_Price AS Revenue, ABC_Class, Month_Name AS note
FROM sales_abc""", ABC_CTES)
def q_csv_ingest(spark, d):
    """S9 -> S2/S3 -> S4-S7 -> S6: raw-named sales written as CSV, read back with inferred
    types, conformed and classed (the file has no revenue column, so Revenue = units x price)."""
    from tarmac.session import scratch_path
    path = scratch_path(spark, "raw-csv")
    sinks.write_csv(raw_sales(spark, d), path)
    return ingest.load_raw_sales(spark, path)


@register("default_revenue", """
SELECT l_returnflag AS category, COUNT(*) AS rows,
       round(CAST(SUM(CAST(l_quantity * (38000.0 / 6) AS DECIMAL(28,8))) AS DOUBLE), 2) AS revenue
FROM lineitem GROUP BY 1""")
def q_default_revenue(spark, d):
    """S5f + S5g + money: revenue from default prices, which have parts below a cent, sums to the cent."""
    from tarmac.functions.columns import money_sum
    sales = ingest.conform(_raw_lineitem(spark, d).drop("date").withColumn("date", F.lit("2024-01-01"))
                           .withColumn("id", F.lit("-")))
    return sales.groupBy(F.col("Category").alias("category")).agg(
        F.count(F.lit(1)).alias("rows"), F.round(money_sum("Revenue"), 2).alias("revenue"))


_STAR_COLUMNS = {  # table -> (its row count, columns: type, nulls)
    "dim_product": ("count(DISTINCT Product_Name)", [
        ("product_id", "bigint"), ("product_name", "string"), ("category", "string"), ("base_price", "double"),
        ("abc_class", "string")]),
    "dim_customer": ("count(DISTINCT Customer)", [
        ("customer_id", "bigint"), ("customer_name", "string"), ("region", "string")]),
    "dim_date": ("count(DISTINCT Date)", [
        ("date_id", "int"), ("date", "date"), ("year", "int"), ("month", "int"), ("quarter", "string"),
        ("month_name", "string")]),
    "fact_sales": ("count(*)", [
        ("txn_id", "bigint"), ("txn_code", "string"), ("date_id", "int"), ("product_id", "bigint"),
        ("customer_id", "bigint"), ("units_sold", "int"), ("unit_price", "double"), ("revenue", "double")]),
}
_FACT_NULLS = {"date_id": "Date", "product_id": "Product_Name", "customer_id": "Customer", "units_sold": "Units_Sold",
               "unit_price": "Unit_Price", "revenue": "Revenue", "txn_code": "Transaction_ID"}


def _star_schema_sql() -> str:
    """One line for each column; of the fact the nulls of its source column, none in the dimensions."""
    lines = [f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", '{kind}' AS type, {rows} AS rows, "
             + (f"count_if({_FACT_NULLS[c]} IS NULL)" if t == "fact_sales" and c in _FACT_NULLS else "CAST(0 AS BIGINT)")
             + " AS nulls FROM sales" for t, (rows, cols) in _STAR_COLUMNS.items() for c, kind in cols]
    return "SELECT \"table\", \"column\", type, CAST(rows AS BIGINT) AS rows, CAST(nulls AS BIGINT) AS nulls FROM (\n" \
        + "\nUNION ALL ".join(lines) + ") t"


@register("star_schema", _star_schema_sql())
def q_star_schema(spark, d):
    """Columns, types, rows and nulls of the star tables built from the given tables."""
    from tarmac.operators.bi import schema_listing
    return schema_listing(star.build_star(flat_sales(spark, d), ready=True))


@register("price_proxy", """
SELECT Category, coalesce(CASE Category WHEN 'Engine' THEN 12000.0 WHEN 'Avionics' THEN 8000.0
              WHEN 'Airframe' THEN 6000.0 WHEN 'Landing Gear' THEN 5000.0 WHEN 'Cabin' THEN 3000.0
              WHEN 'Other' THEN 4000.0 END, 38000.0 / 6) AS Unit_Price, COUNT(*) AS rows
FROM sales GROUP BY 1""")
def q_price_proxy(spark, d):
    """S5f: a raw file without prices gets the category's table price per row (the
    mean of the table for unknown categories)."""
    raw = sales_view(spark, d).select(F.col("Date").alias("date"), F.col("Product_Name").alias("product"),
                                      F.col("Category").alias("category"), F.col("Units_Sold").alias("quantity"))
    conformed = ingest.conform(raw)
    return conformed.groupBy("Category", "Unit_Price").agg(F.count(F.lit(1)).alias("rows"))
