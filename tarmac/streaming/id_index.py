"""The ids of a growing store, by hash prefix: which ids of a micro-batch are stored already (ST2).

Ids lie under ``ingest_id=<micro-batch>/level=<l>/prefix=<p>``: at level l a prefix is the low l bits of the id's
64-bit hash. A micro-batch is written at the level at which a prefix holds about ``spark.tarmac.idsPerPrefix`` ids of
the whole store, so prefixes get longer as the store grows and each (level, prefix) stays bounded. A look-up reads, at
each of the few levels (one more whenever the store doubles), only the prefixes that the new ids fall into: partition
filters on literals, which the plan shows. So the bytes a trigger reads follow from its own ids and the number of levels, not
from the store; the folder listing is the only thing that grows.

A micro-batch's folder is its own; a replay overwrites it and looks at the others only. ``<folder>_totals`` has one row
for each micro-batch, the ids stored up to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.session import path_exists

ID = "Transaction_ID"
PER_PREFIX = 1 << 20
# Prefixes a look-up names one by one; beyond that it meets the whole level, of which it would read most anyway.
NAMED = 4096
SCHEMA = f"{ID} string, ingest_id long, level int, prefix long"
REBUILT = -1  # the micro-batch number of ids taken over from a store without an index


def per_prefix(spark: SparkSession) -> int:
    """Ids a prefix may hold (``spark.tarmac.idsPerPrefix``)."""
    return int(spark.conf.get("spark.tarmac.idsPerPrefix", str(PER_PREFIX)))


def level_for(total: int, most: int) -> int:
    """The least level whose prefixes hold ``most`` of ``total`` ids on average."""
    return (-(-max(total, 1) // most) - 1).bit_length()


def _prefix(level: int):
    return F.xxhash64(F.col(ID)).bitwiseAND(F.lit((1 << level) - 1).cast("long"))


def _totals(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{folder}_totals"
    schema = "total long, level int, ingest_id long"
    return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(Transaction_ID, ingest_id, level, prefix) of all stored ids."""
    return spark.read.schema(SCHEMA).parquet(folder)


def candidates(spark: SparkSession, folder: str, ids: DataFrame, batch_id: int) -> DataFrame:
    """The stored ids of other micro-batches in the prefixes that ``ids`` touch."""
    found = read(spark, folder).filter(F.col("ingest_id") != batch_id)
    levels = [r.level for r in _totals(spark, folder).filter(F.col("ingest_id") != batch_id)
              .select("level").distinct().collect()]  # a few: one more whenever the store doubles
    if not levels:
        return found.limit(0)
    top = max(levels)
    touched = [r.p for r in ids.select(_prefix(top).alias("p")).distinct().limit(NAMED + 1).collect()]
    if len(touched) > NAMED:
        return found
    wanted = F.lit(False)
    for level in levels:
        wanted |= (F.col("level") == level) & F.col("prefix").isin(sorted({p & ((1 << level) - 1) for p in touched}))
    return found.filter(wanted)


def stored(spark: SparkSession, folder: str, ids: DataFrame, batch_id: int) -> DataFrame:
    """The ids of ``ids`` that other micro-batches have stored."""
    if not path_exists(spark, folder):
        return spark.createDataFrame([], f"{ID} string")
    return candidates(spark, folder, ids, batch_id).join(ids, ID, "left_semi").select(ID).distinct()


def add(rows: DataFrame, folder: str, batch_id: int) -> None:
    """Store the ids of a micro-batch, in place of what it stored before."""
    spark = rows.sparkSession
    new = rows.select(ID).filter(F.col(ID).isNotNull()).distinct().persist()
    before = _totals(spark, folder).filter(F.col("ingest_id") != batch_id).agg(F.max("total")).first()[0] or 0
    total = before + new.count()
    level = level_for(total, per_prefix(spark))
    placed = new.withColumn("level", F.lit(level)).withColumn("prefix", _prefix(level))
    # One file for each prefix, unless it has too much for one task.
    (placed.hint("rebalance", F.col("prefix")).write.mode("overwrite").partitionBy("level", "prefix")
     .parquet(f"{folder}/ingest_id={batch_id}"))
    (spark.range(1).select(F.lit(total).cast("long").alias("total"), F.lit(level).alias("level"))
     .write.mode("overwrite").parquet(f"{folder}_totals/ingest_id={batch_id}"))
    new.unpersist()


def rebuild(fact: DataFrame, folder: str) -> None:
    """The index of a store that has none yet."""
    add(fact, folder, REBUILT)
