"""ABC (Pareto) classification of products by cumulative revenue share.

Two rules exist and both are kept:

* dashboard (W1/A8): share in percent rounded to 2 digits, class from the
  rounded value (<= 70 A, <= 90 B, else C);
* ingest (S6): class from the unrounded share (<= 0.70 A, <= 0.90 B, else C),
  written onto every fact row.

Products are aggregated first (partial aggregation, so a product holding a third
of the rows is combined map-side); the running share over the product table uses
``scale.running_total`` (single window under a size bound, two-phase above).
Revenue is summed as an exact decimal so the running share does not depend on
summation order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions.columns import money_double, money_total, ratio, truncate_label
from tarmac.operators.bi import filter_sales
from tarmac.operators.scale import bounded, fits_broadcast, lookup_join, running_total
from tarmac.schema import ABC_A_LIMIT, ABC_B_LIMIT
from tarmac.session import stored

CLASSES = ["A", "B", "C"]


def product_revenue(sales: DataFrame) -> DataFrame:
    return (sales.filter(F.col("Product_Name").isNotNull())
            .groupBy(F.col("Product_Name").alias("name"))
            .agg(money_total("Revenue").alias("_rev")))


def _cumulative(prod: DataFrame, small: bool) -> DataFrame:
    order = [F.col("_rev").desc(), F.col("name").asc()]
    run = running_total(prod, order, "_rev", "_cum", "_tot", small=small)
    return run.withColumn("_share", ratio(money_double("_cum"), money_double("_tot")))  # null when nothing was sold


def abc_products(sales: DataFrame, year=None) -> DataFrame:
    """Name, revenue, cumulative_pct (2 digits), abc (from the rounded pct)."""
    prod = product_revenue(filter_sales(sales, year)).persist()
    run = _cumulative(prod, bounded(prod))
    pct = F.round(F.col("_share") * 100, 2)
    cls = F.when(pct <= ABC_A_LIMIT, "A").when(pct <= ABC_B_LIMIT, "B").otherwise("C")
    return run.select(
        "name",
        F.round(money_double("_rev"), 2).alias("revenue"),
        pct.alias("cumulative_pct"),
        cls.alias("abc"),
    ).orderBy(F.desc("revenue"), "name")


def abc_summary(sales: DataFrame, year=None) -> DataFrame:
    """Per class product count, revenue and % of revenue (1 digit); all three classes present."""
    prods = abc_products(sales, year)
    per = prods.groupBy("abc").agg(
        F.count(F.lit(1)).alias("count"),
        F.sum(F.col("revenue").cast("decimal(28,2)")).alias("_r"),
    )
    spark = sales.sparkSession
    classes = spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in CLASSES])).alias("abc"))
    tot = F.sum("_r").over(Window.partitionBy())  # three rows at most
    joined = classes.join(F.broadcast(per), "abc", "left")
    return joined.select(
        "abc",
        F.coalesce("count", F.lit(0)).cast("long").alias("count"),
        F.round(F.coalesce(F.col("_r").cast("double"), F.lit(0.0)), 2).alias("revenue"),
        F.round(F.coalesce(ratio("_r", tot) * 100, F.lit(0.0)), 1)
        .alias("revenue_pct"),
    ).orderBy("abc")


def product_classes(sales: DataFrame) -> tuple[DataFrame, bool]:
    """S6 class per product from the unrounded share; returns (table, is_small)."""
    prod = product_revenue(sales).persist()
    small = fits_broadcast(prod)
    run = _cumulative(prod, small)
    cls = F.when(F.col("_share") <= ABC_A_LIMIT / 100, "A") \
        .when(F.col("_share") <= ABC_B_LIMIT / 100, "B").otherwise("C")
    return run.select(F.col("name").alias("_pname"), cls.alias("ABC_Class")), small


def with_abc_class(sales: DataFrame, store: str | None = None) -> DataFrame:
    """S6 + J4: write the ABC class onto every fact row (overwrites any given class).

    The product-class table is broadcast only when the product count is under
    the checked bound; otherwise the join is split by heavy products (``scale.lookup_join``).

    ``store`` names a scratch table, for who reads the result several times: the rows are worked out once, for their
    classes too. A broadcast of the classes is then repeated by each reader, a join beyond the bound is stored as well.
    """
    base = sales.drop("ABC_Class") if "ABC_Class" in sales.columns else sales
    if store:
        base = stored(base, store)
    classes, small = product_classes(base)
    names = base.columns
    classed = lookup_join(base, classes.withColumnRenamed("_pname", "Product_Name"), "Product_Name").select(
        *names, "ABC_Class")
    return stored(classed, store) if store and not small else classed


def pareto_chart(products: DataFrame) -> DataFrame:
    """Chart rows of ``abc_products``: name cut to 16 characters + ellipsis beyond 18,
    revenue in millions (2 digits), cumulative % and class."""
    return products.select(truncate_label("name", 18, 16).alias("name"),
                           F.round(F.col("revenue") / 1e6, 2).alias("revenue"),
                           F.col("cumulative_pct").alias("cumulative"), "abc")
