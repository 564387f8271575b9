"""A star that grows load by load (S10, J6): merge a flat batch into the stored tables.

Layout: ``<base>/<table>/load=<n>`` for each of the four tables (the fact by year below that) and
``<base>/loads/load=<n>``, one row with the caller's name of the load and the largest keys after it.

* Members: names the stored dimension lacks are inserted, the others keep their key and attributes (left anti join on
  the name); only the new members are written. Dates are inserted by date key.
* Keys continue after the high-water marks of the last finished load, which are read from its one row. No stored
  fact is read by a merge.
* A load counts once its row under ``loads`` is written, which is done last. Readers take the loads up to the last such
  row, so a load that broke off is not seen; the next merge uses its number and overwrites its folders. Merging a
  load that has been finished, by name, changes nothing. One writer at a time.

Cases: a batch without rows is a load without rows; rows without a product, customer or date stay with a null key;
repeated rows are rows, as a load appends what it is given.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.session import path_exists, stored
from tarmac.sources import star

SCHEMAS = {
    "dim_product": "product_id long, product_name string, category string, base_price double, abc_class string",
    "dim_customer": "customer_id long, customer_name string, region string",
    "dim_date": "date_id int, date date, year int, month int, quarter string, month_name string",
    "fact_sales": "txn_id long, txn_code string, date_id int, product_id long, customer_id long, units_sold int, "
                  "unit_price double, revenue double",
}
LOADS = "name string, rows long, product_id long, customer_id long, txn_id long, load int"


def loads(spark: SparkSession, base: str) -> DataFrame:
    """One row for each finished load: its name, rows and the largest keys after it, and its number."""
    path = os.path.join(base, "loads")
    return spark.read.schema(LOADS).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], LOADS)


def read(spark: SparkSession, base: str, upto: int | None = None) -> dict[str, DataFrame]:
    """The four tables as of load ``upto`` (the last finished one)."""
    if upto is None:
        upto = loads(spark, base).agg(F.max("load")).first()[0] or 0
    out = {}
    for name, schema in SCHEMAS.items():
        path = os.path.join(base, name)
        extra = ", load int" + (", fact_year int" if name == "fact_sales" else "")
        out[name] = (spark.read.schema(schema + extra).parquet(path).filter(F.col("load") <= upto)
                     .drop("load", "fact_year") if upto and path_exists(spark, path)
                     else spark.createDataFrame([], schema))
    return out


def _insert(new: DataFrame, base: str, name: str, number: int) -> DataFrame:
    """Write a load's new members and give them back from the file."""
    path = os.path.join(base, name, f"load={number}")
    new.write.mode("overwrite").parquet(path)
    return new.sparkSession.read.schema(SCHEMAS[name]).parquet(path)


def merge(sales: DataFrame, base: str, name: str, ready: bool = False) -> bool:
    """Merge the flat batch ``sales`` as load ``name``; False if that load was finished before.

    A batch that is ``ready``, as it is read from files, is not stored again.
    """
    spark = sales.sparkSession
    done = loads(spark, base)
    if not done.filter(F.col("name") == name).isEmpty():
        return False
    last = done.orderBy(F.desc("load")).first()
    number = 1 + (last.load if last else 0)
    marks = {k: last[k] if last else 0 for k in ("product_id", "customer_id", "txn_id")}
    old = read(spark, base, number - 1)
    if not ready:
        sales = stored(sales, "star-load")  # worked out once for all tables
    dims = {}
    for table, build, key in (("dim_product", star.new_products, "product_id"),
                              ("dim_customer", star.new_customers, "customer_id")):
        added = _insert(build(sales, old[table], marks[key]), base, table, number)
        marks[key] += added.count()
        dims[table] = old[table].unionByName(added)
    _insert(star.new_dates(sales, old["dim_date"]), base, "dim_date", number)
    facts = star.fact_sales(sales, dims["dim_product"], dims["dim_customer"], marks["txn_id"] + 1)
    path = os.path.join(base, "fact_sales", f"load={number}")
    year = F.floor(F.col("date_id") / 10000).cast("int")
    (facts.withColumn("fact_year", year).hint("rebalance", F.col("fact_year"))
     .write.mode("overwrite").partitionBy("fact_year").parquet(path))
    rows = spark.read.schema(SCHEMAS["fact_sales"]).parquet(path).count()
    marks["txn_id"] += rows
    (spark.createDataFrame([(name, rows, marks["product_id"], marks["customer_id"], marks["txn_id"])],
                           LOADS.rsplit(",", 1)[0])
     .coalesce(1).write.mode("overwrite").parquet(os.path.join(base, "loads", f"load={number}")))
    return True
