"""The materialised canonical fact (S1, S6, S8): conform once, serve many analyses.

``materialize_fact`` writes the conformed fact partitioned by Year in one pass
over the source (for the given tables: one evaluation of the five-way join),
then derives the product ABC classes from the written fact (a two-column scan)
and stores them beside it. ``read_fact`` returns the fact with ``ABC_Class``
attached by a join with the class table -- broadcast when its size is under the
checked bound, a shuffle join otherwise. The class is a product attribute, so
storing it once per product instead of once per row avoids a second pass over
the fact (at 100 TB that pass would be the most expensive job of the load).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from tarmac.operators.abc import product_classes
from tarmac.operators.scale import maybe_broadcast
from tarmac.schema import SALES_COLUMNS, SALES_SCHEMA

CLASSES_DIR = "_abc_classes"


def _fact_dir(path: str) -> str:
    return os.path.join(path, "fact")


def _classes_dir(path: str) -> str:
    return os.path.join(path, CLASSES_DIR)


def materialize_fact(sales: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write ``sales`` (any ABC_Class column is dropped) and its product classes under ``path``."""
    spark = sales.sparkSession
    base = sales.drop("ABC_Class") if "ABC_Class" in sales.columns else sales
    base.write.mode(mode).partitionBy("Year").parquet(_fact_dir(path))
    stored = spark.read.parquet(_fact_dir(path))
    classes, _ = product_classes(stored)
    classes.write.mode(mode).parquet(_classes_dir(path))


def read_fact(spark: SparkSession, path: str) -> DataFrame:
    """The materialised fact with ``ABC_Class`` (S1 + J4), in canonical column order."""
    schema_wo_class = [f for f in SALES_SCHEMA.fields if f.name != "ABC_Class"]
    from pyspark.sql import types as T
    fact = spark.read.schema(T.StructType(schema_wo_class)).parquet(_fact_dir(path))
    classes = spark.read.parquet(_classes_dir(path))
    right = maybe_broadcast(classes)
    joined = fact.join(right, fact.Product_Name == right._pname, "left")
    return joined.select(*SALES_COLUMNS)
