"""Shared helpers: tables, stored intermediates, column hygiene."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.session import stored  # noqa: F401

# ASCII white space: the separators of the word contracts ([^\x20\x09-\x0D]+).
WORD_RE = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n (0 where the key is null)."""
    return F.coalesce(F.crc32(key.cast("string")) % n, F.lit(0))


def utf8(col: str = "text") -> Column:
    """The column as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(col).cast("string").cast("binary"), F.lit(b""))


def replace_columns(df: DataFrame, names) -> DataFrame:
    """``df`` without columns whose names (any case) an operator is about to add."""
    taken = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def set_aside(df: DataFrame, names) -> tuple[DataFrame, list[Column]]:
    """``df`` with columns of ``names`` (any case) renamed out of an operator's way, and the columns that restore it."""
    taken, out, back = {n.lower() for n in names} | {c.lower() for c in df.columns}, [], []
    clash = {n.lower() for n in names}
    for c in df.columns:
        own = c
        while own.lower() in clash or own != c and own.lower() in taken:
            own = f"given_{own}"
        taken.add(own.lower())
        out.append(F.col(f"`{c}`").alias(own))
        back.append(F.col(f"`{own}`").alias(c))
    return df.select(*out), back


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _has_map(kind.elementType)


def row_hash(df: DataFrame) -> Column:
    """Two 64-bit hashes of all columns, nulls told apart from values: rows with equal ones are interchangeable.

    Maps, which Spark does not hash, are taken as JSON.
    """
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        cols.append(F.to_json(F.struct(c), {"ignoreNullFields": "false"}) if _has_map(f.dataType) else c)
    nulls = [F.col(f"`{c}`").isNull() for c in df.columns]
    return F.struct(F.xxhash64(*cols, *nulls).alias("a"), F.xxhash64(F.lit("b"), *nulls, *cols).alias("b"))


def extended(schema: T.StructType, **added: T.DataType) -> T.StructType:
    return T.StructType(list(schema.fields) + [T.StructField(k, v) for k, v in added.items()])


def add_arrays(batch: pa.RecordBatch, **arrays) -> pa.RecordBatch:
    """``batch`` with more columns at its end."""
    return pa.RecordBatch.from_arrays(list(batch.columns) + list(arrays.values()),
                                      names=list(batch.schema.names) + list(arrays))


def tidy(run):
    """``run`` (batches to batches) that returns freed memory to the system at its end: an idle Python worker would keep it."""
    def tidied(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        pa.system_memory_pool().release_unused()

    return tidied
