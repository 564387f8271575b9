"""Named queries over the given tables, each with its DuckDB oracle SQL.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name] -> SQL``. A
query without an oracle entry is checked by row count and invariants only
(model-based operators). Column names are aliased identically on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarmac.sources.tables import SALES_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None, ctes: str = ""):
    """Register a query; ``sql`` is the body after ``WITH sales AS (...)[, ctes]``."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_sales(sql, ctes)
        return fn
    return deco


def with_sales(body: str, ctes: str = "") -> str:
    extra = f",\n{ctes}" if ctes.strip() else ""
    return f"WITH {SALES_SQL.strip()}{extra}\n{body}"


# SQL snippets shared by several oracle queries.
MONEY_SUM = "CAST(SUM(CAST({c} AS DECIMAL(28,8))) AS DOUBLE)"


def msum(c: str = "Revenue") -> str:
    return MONEY_SUM.format(c=c)


def load_all() -> None:
    """Import every plan module so its queries register."""
    from tarmac.plans import (  # noqa: F401
        bi_queries, customer_queries, ingest_queries, model_queries, sql_queries, stream_queries,
    )
