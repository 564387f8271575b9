"""Ad-hoc SQL over the sales view.

The flat view ``fact_sales`` renames six columns to snake_case; Spark SQL is
case-insensitive, so the other canonical names resolve in any case. ``run_sql``
takes a SQL text out of its fence, accepts it only if it parses to one query
without commands, runs it with a row cap pushed into the plan, and returns
errors, those of the run included, as a one-row DataFrame instead of raising.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.schema import SQL_VIEW_RENAMES

MAX_ROWS = 50


def sql_view(sales: DataFrame, name: str = "fact_sales") -> DataFrame:
    """Register the flat view (six snake_case renames, every name lower case) and return it."""
    view = sales.withColumnsRenamed({k: v for k, v in SQL_VIEW_RENAMES.items() if k in sales.columns})
    view = view.toDF(*[c.lower() for c in view.columns])
    view.createOrReplaceTempView(name)
    return view


# An optional fence of backticks with an optional language word; what closes it is a fence only if one was opened.
_FENCED = re.compile(r"\s*(`+)?\s*(?:sql\s)?(.*?)(?(1)\s*`+|)\s*", re.S | re.I)
_NOT_QUERIES = ("org.apache.spark.sql.catalyst.plans.logical.Command",
                "org.apache.spark.sql.catalyst.plans.logical.ParsedStatement")


class NotAQuery(ValueError):
    """The text holds a command: it would change something instead of reading."""


def clean_sql(text: str) -> str:
    return _FENCED.fullmatch(text)[2].strip()


def _check_query(spark: SparkSession, sql: str) -> None:
    """Raise unless ``sql`` parses to one query; nothing is run or resolved."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    loader = spark._jvm.org.apache.spark.util.Utils.getContextOrSparkClassLoader()
    kinds = [loader.loadClass(k) for k in _NOT_QUERIES]
    todo = [plan]
    while todo:
        node = todo.pop()
        if any(k.isInstance(node) for k in kinds):
            raise NotAQuery(f"[NOT_A_QUERY] {node.nodeName()} is not a query")
        below = node.children()
        todo += [below.apply(i) for i in range(below.size())]


def run_sql(spark: SparkSession, text: str, max_rows: int | None = MAX_ROWS) -> DataFrame:
    """Q1: the rows of the query ``text``, at most ``max_rows``; errors as one (sql, error) row.

    The capped rows are computed here, so that an error of the run is a row too. Without a cap the result stays lazy
    and only errors before the run are.
    """
    sql = clean_sql(text)
    try:
        _check_query(spark, sql)
        df = spark.sql(sql)
        return df if max_rows is None else spark.createDataFrame(df.limit(max_rows).collect(), df.schema)
    except Exception as e:  # noqa: BLE001 -- the error is the result
        msg = str(e).strip().splitlines()[0] if str(e).strip() else type(e).__name__
        return spark.range(1).select(F.lit(sql).alias("sql"), F.lit(msg).alias("error"))
