"""Star schema: build dimensions and fact from the flat sales fact (S10, S11, J5,
J6), write/read them, and read back the flat fact (S12, J1).

Surrogate keys are dense and follow first appearance (date, then transaction
id), as an autoincrement insert in file order would; new members continue after
the largest existing key (insert-if-absent = left anti join against the stored
dimension). Keys come from ``scale.ordered_row_id``: a single window under the
size bound, two-phase range-partitioned ids above it.

Joins: dimension sides are broadcast only when the dimension is within
``spark.tarmac.broadcastRows`` (checked with a bounded count); otherwise the join is split by
heavy products and customers (``scale.lookup_join``). ``dim_date`` is bounded by the calendar
(one row per day), so it is always broadcast.

Disk: the fact is shuffled once for each dimension beyond the bound and once for its ids. Rows are stored between
these (``session.stored``), which removes the shuffle files behind them.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.functions.columns import quarter_label
from tarmac.operators.scale import bounded, fits_broadcast, lookup_join, ordered_row_id
from tarmac.session import stored

STAR_TABLES = ["dim_product", "dim_customer", "dim_date", "fact_sales"]


def _new_members(sales: DataFrame, name_col: str, attrs: dict[str, str], existing: DataFrame | None,
                 key: str, dim_name_col: str, mark: int | None = None) -> DataFrame:
    """Distinct names with first-seen attributes, minus the stored ones, with keys after ``mark`` (by default the
    largest stored key)."""
    seen = F.struct("Date", "Transaction_ID", *[F.col(src).alias(dst) for dst, src in attrs.items()])
    first = stored(sales.filter(F.col(name_col).isNotNull())
                   .groupBy(F.col(name_col).alias(dim_name_col))
                   .agg(F.min(seen).alias("_seen")), "star-members")  # counted, then numbered
    offset = mark or 0
    if existing is not None:
        first = first.join(existing.select(dim_name_col), dim_name_col, "left_anti")
        if mark is None:
            offset = existing.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
    order = [F.col("_seen.Date").asc(), F.col("_seen.Transaction_ID").asc(), F.col(dim_name_col).asc()]
    ided = ordered_row_id(first, order, key, start=offset + 1)
    return ided.select(F.col(key).cast("long").alias(key), dim_name_col,
                       *[F.col(f"_seen.{dst}").alias(dst) for dst in attrs])


def new_products(sales: DataFrame, existing: DataFrame | None = None, mark: int | None = None) -> DataFrame:
    """The products that ``existing`` lacks: product_id, product_name, category, base_price (0), abc_class."""
    new = _new_members(sales, "Product_Name", {"category": "Category", "abc_class": "ABC_Class"},
                       existing, "product_id", "product_name", mark)
    return new.select("product_id", "product_name", "category", F.lit(0.0).alias("base_price"), "abc_class")


def dim_product(sales: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """product_id, product_name, category, base_price (0), abc_class."""
    new = new_products(sales, existing)
    return new if existing is None else existing.unionByName(new)


def new_customers(sales: DataFrame, existing: DataFrame | None = None, mark: int | None = None) -> DataFrame:
    """The customers that ``existing`` lacks: customer_id, customer_name, region (first seen)."""
    return _new_members(sales, "Customer", {"region": "Region"}, existing, "customer_id", "customer_name", mark)


def dim_customer(sales: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """customer_id, customer_name, region (first seen)."""
    new = new_customers(sales, existing)
    return new if existing is None else existing.unionByName(new)


def date_key(c) -> F.Column:
    return F.date_format(c, "yyyyMMdd").cast("int")


def new_dates(sales: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """The dates that ``existing`` lacks, one row each with the int key YYYYMMDD."""
    d = sales.select("Date").filter(F.col("Date").isNotNull()).distinct()
    if existing is not None:
        d = d.join(existing.select(F.col("date").alias("Date")), "Date", "left_anti")
    return d.select(date_key("Date").alias("date_id"), F.col("Date").alias("date"),
                    F.year("Date").alias("year"), F.month("Date").alias("month"),
                    quarter_label("Date").alias("quarter"), F.date_format("Date", "MMM").alias("month_name"))


def dim_date(sales: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One row per distinct date with the int key YYYYMMDD."""
    new = new_dates(sales, existing)
    return new if existing is None else existing.unionByName(new)


def fact_sales(sales: DataFrame, products: DataFrame, customers: DataFrame,
               start_id: int = 1) -> DataFrame:
    """S10 + J5: fact rows with foreign keys; txn_id dense in (Date, Transaction_ID) order.

    A row without a product, customer or date stays, with a null key.
    """
    p = products.select(F.col("product_name").alias("Product_Name"), "product_id")
    c = customers.select(F.col("customer_name").alias("Customer"), "customer_id")
    f = lookup_join(lookup_join(sales, p, "Product_Name"), c, "Customer")
    f = f.select(F.col("Transaction_ID").alias("txn_code"), date_key("Date").alias("date_id"),
                 "product_id", "customer_id", F.col("Units_Sold").alias("units_sold"),
                 F.col("Unit_Price").alias("unit_price"), F.col("Revenue").alias("revenue"))
    if not (fits_broadcast(products) and fits_broadcast(customers)):
        f = stored(f, "star-keyed")  # the sort reads its rows twice; the shuffles of the lookups are gone before its own
    # The key has the order of the date, so neither date nor id is sorted and stored twice.
    ided = ordered_row_id(f, [F.col("date_id").asc(), F.col("txn_code").asc()], "txn_id", start=start_id,
                          small=bounded(sales))  # the lookups add no rows
    return ided.select(F.col("txn_id").cast("long").alias("txn_id"), "txn_code", "date_id", "product_id",
                       "customer_id", "units_sold", "unit_price", "revenue")


def build_star(sales: DataFrame, ready: bool = False) -> dict[str, DataFrame]:
    """S10 + S11: the four star tables from the flat fact, which is worked out once and stored, as each table reads it.

    A fact that is ``ready``, as it is read from files, is not stored again.
    """
    if not ready:
        sales = stored(sales, "star-sales")
    products = dim_product(sales).persist()  # read by the key joins and returned
    customers = dim_customer(sales).persist()
    return {
        "dim_product": products,
        "dim_customer": customers,
        "dim_date": dim_date(sales),
        "fact_sales": fact_sales(sales, products, customers),
    }


def write_star(star: dict[str, DataFrame], base: str, mode: str = "overwrite") -> None:
    """Write each star table as Parquet (the fact partitioned by its date key's year)."""
    for name, df in star.items():
        w = df.write.mode(mode)
        if name == "fact_sales":
            df = df.withColumn("year", (F.col("date_id") / 10000).cast("int"))
            w = df.write.mode(mode).partitionBy("year")
        w.parquet(os.path.join(base, name))


def read_star(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    out = {n: spark.read.parquet(os.path.join(base, n)) for n in STAR_TABLES}
    out["fact_sales"] = out["fact_sales"].drop("year")
    return out


def read_star_jdbc(spark: SparkSession, url: str, properties: dict | None = None,
                   fact_partitions: int = 0, fact_bounds: tuple[int, int] | None = None) -> dict[str, DataFrame]:
    """S12 (JDBC variant): the four star tables from a database. With
    ``fact_partitions`` and ``fact_bounds`` the fact is read in parallel ranges of
    ``txn_id``; dimensions are small and read in one task each."""
    props = dict(properties or {})
    out = {n: spark.read.jdbc(url, n, properties=props) for n in STAR_TABLES if n != "fact_sales"}
    if fact_partitions and fact_bounds:
        out["fact_sales"] = spark.read.jdbc(url, "fact_sales", column="txn_id", lowerBound=fact_bounds[0],
                                            upperBound=fact_bounds[1], numPartitions=fact_partitions,
                                            properties=props)
    else:
        out["fact_sales"] = spark.read.jdbc(url, "fact_sales", properties=props)
    return out


def star_flat(star: dict[str, DataFrame]) -> DataFrame:
    """S12 + J1: the flat fact from the star (three equi-joins; a null key gives null attributes).

    Dimensions beyond the broadcast bound come first, so what the others add is not shuffled.
    """
    j = star["fact_sales"]
    for name, key in sorted([("dim_product", "product_id"), ("dim_customer", "customer_id")],
                            key=lambda x: fits_broadcast(star[x[0]])):
        j = lookup_join(j, star[name], key)
    j = j.join(F.broadcast(star["dim_date"]), "date_id", "left")  # one row per calendar day
    return j.select(
        F.col("txn_code").alias("Transaction_ID"), F.col("date").alias("Date"), F.col("year").alias("Year"),
        F.col("month").alias("Month"), F.col("month_name").alias("Month_Name"), F.col("quarter").alias("Quarter"),
        F.col("product_name").alias("Product_Name"), F.col("category").alias("Category"),
        F.col("abc_class").alias("ABC_Class"), F.col("customer_name").alias("Customer"),
        F.col("region").alias("Region"), F.col("units_sold").alias("Units_Sold"),
        F.col("unit_price").alias("Unit_Price"), F.col("revenue").alias("Revenue"),
    )


def register_star_views(star: dict[str, DataFrame]) -> None:
    """Temp views named as the star tables, for SQL over the star."""
    for name, df in star.items():
        df.createOrReplaceTempView(name)
