"""Readers for the given tables and the canonical sales view over them.

The sales view maps the TPC-H-style tables onto the canonical 14-column fact:

    Transaction_ID  'TXN-<orderkey>-<linenumber>-<partkey>-<suppkey>'
    Date            order date
    Product_Name    '<brand> <type>'      Category   part type
    Region          region of the customer's nation
    Customer        customer name
    Units_Sold      quantity              Unit_Price extendedprice / quantity
    Revenue         extendedprice

Join plan: customers are attached to orders first (orders are a quarter of the
line items and narrow), then lineitem and orders -- the two fact-sized inputs --
meet in one shuffle join on the order key, and only then part; written in this
order (the cost-based reorder is off by default) the line items cross the
network at most twice. Who stores all rows takes part first and orders last
(``by_order``). Customer and part are dimension-sized and are
broadcast by Spark only when their measured size is under
``spark.sql.autoBroadcastJoinThreshold`` (AQE re-checks at runtime), otherwise
they are sort-merge joined. Nation and region are bounded by definition (25 and
5 rows) and are always broadcast.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.functions.columns import quarter_label

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def customer_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer key -> (name, region); nation/region broadcast (fixed tiny tables)."""
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    geo = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey) \
        .select("n_nationkey", "r_name")
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    return cust.join(F.broadcast(geo), cust.c_nationkey == geo.n_nationkey) \
        .select(F.col("c_custkey"), F.col("c_name").alias("Customer"), F.col("r_name").alias("Region"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    return _named(part).select("p_partkey", "Product_Name", "Category")


def _named(rows: DataFrame) -> DataFrame:
    """Product_Name and Category of rows with the columns of a part."""
    return rows.withColumns({"Product_Name": F.concat_ws(" ", "p_brand", "p_type"), "Category": F.col("p_type")})


def sales_view(spark: SparkSession, sf_dir: str, by_order: bool = False) -> DataFrame:
    """The canonical sales fact (without ABC_Class; see ``operators.abc.with_abc_class``).

    With ``by_order`` the line items meet their parts before their orders: for who stores all rows, as those of an order
    then lie together, which compresses them, and narrower rows are shuffled.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    # customers meet orders first (an orders-sized shuffle on the customer key), so the
    # line items are shuffled once on the order key instead of twice (order key, then customer key)
    orders = orders.join(customer_regions(spark, sf_dir), orders.o_custkey == F.col("c_custkey"))
    meets_order, meets_part = F.col("l_orderkey") == F.col("o_orderkey"), F.col("l_partkey") == F.col("p_partkey")
    if by_order:
        part = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
        lo = _named(li.join(part, meets_part).join(orders, meets_order))
    else:
        lo = li.join(orders, meets_order).join(products(spark, sf_dir), meets_part)
    date = F.to_date("o_orderdate")
    return lo.select(
        F.format_string("TXN-%d-%d-%d-%d", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
        .alias("Transaction_ID"),
        date.alias("Date"),
        F.year(date).alias("Year"),
        F.month(date).alias("Month"),
        F.date_format(date, "MMM").alias("Month_Name"),
        quarter_label(date).alias("Quarter"),
        F.col("Product_Name"),
        F.col("Category"),
        F.col("Region"),
        F.col("Customer"),
        F.col("l_quantity").cast("int").alias("Units_Sold"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("Unit_Price"),
        F.col("l_extendedprice").alias("Revenue"),
    )


# The same view in DuckDB SQL, used by every oracle query as a CTE.
SALES_SQL = """
sales AS (
  SELECT format('TXN-{}-{}-{}-{}', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS Transaction_ID,
         CAST(o_orderdate AS DATE) AS Date,
         CAST(year(o_orderdate) AS INTEGER) AS Year,
         CAST(month(o_orderdate) AS INTEGER) AS Month,
         strftime(CAST(o_orderdate AS DATE), '%b') AS Month_Name,
         'Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS Quarter,
         p_brand || ' ' || p_type AS Product_Name,
         p_type AS Category,
         r_name AS Region,
         c_name AS Customer,
         CAST(l_quantity AS INTEGER) AS Units_Sold,
         l_extendedprice / l_quantity AS Unit_Price,
         l_extendedprice AS Revenue
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey
)"""
