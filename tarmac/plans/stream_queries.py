"""Incremental ingest queries (ST1, ST2): daily purchase batches derived from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.plans.registry import register
from tarmac.session import scratch_path
from tarmac.streaming import ingest as st

_EVENT_CTES = """
p AS (SELECT *, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'purchase'),
bad AS (SELECT d FROM p GROUP BY d
        HAVING count_if(NOT coalesce(value > 0, false)) > 0 OR COUNT(*) <> COUNT(DISTINCT event_id))"""


def _ingest(spark, d):
    base = scratch_path(spark, "ingest")
    st.write_daily_batches(st.events_as_sales(spark, d), f"{base}/landing")
    return st.run_ingest_once(spark, f"{base}/landing", base)


@register("incremental_ingest", """
SELECT printf('EVT-%d', event_id) AS Transaction_ID, d AS Date, CAST(year(d) AS INTEGER) AS Year,
       CAST(month(d) AS INTEGER) AS Month, strftime(d, '%b') AS Month_Name, 'Q' || CAST(quarter(d) AS VARCHAR) AS Quarter,
       'Purchase' AS Product_Name, event_type AS Category, 'Other' AS Region, printf('User %d', user_id) AS Customer,
       1 AS Units_Sold, value AS Unit_Price, value AS Revenue, CAST(NULL AS VARCHAR) AS ABC_Class
FROM p WHERE d NOT IN (SELECT d FROM bad)""", _EVENT_CTES)
def q_incremental_ingest(spark, d):
    return st.read_ingested(spark, _ingest(spark, d)["fact"]).drop("ingest_id")


@register("ingest_quarantine", """
SELECT CAST(COUNT(DISTINCT d) AS BIGINT) AS batches, COUNT(*) AS rows FROM p WHERE d IN (SELECT d FROM bad)""",
          _EVENT_CTES)
def q_ingest_quarantine(spark, d):
    q = spark.read.parquet(_ingest(spark, d)["quarantine"])
    return q.agg(F.count_distinct("batch").alias("batches"), F.count(F.lit(1)).alias("rows"))


@register("ingest_repeated_ids", """
SELECT 'fact' AS place, 'stored' AS reason, COUNT(*) AS rows, COUNT(DISTINCT event_id) AS ids
FROM p WHERE d NOT IN (SELECT d FROM bad) HAVING COUNT(*) > 0
UNION ALL SELECT 'quarantine', 'repeated_id', COUNT(*), COUNT(DISTINCT event_id)
FROM p WHERE d NOT IN (SELECT d FROM bad) HAVING COUNT(*) > 0
UNION ALL SELECT 'quarantine', 'failed_rules', COUNT(*), COUNT(DISTINCT id)
FROM (SELECT 'EVT-' || event_id AS id FROM p WHERE d IN (SELECT d FROM bad)
      UNION ALL SELECT 'EVT-' || event_id FROM p WHERE d IN (SELECT d FROM bad)
      UNION ALL SELECT 'REF-' || event_id FROM p WHERE value > 0) HAVING COUNT(*) > 0""", _EVENT_CTES)
def q_ingest_repeated_ids(spark, d):
    """ST2: a later feed brings every purchase again one day later, a third one brings refunds (negative
    revenue). Rows by where they end: stored once, quarantined as repeats, or quarantined with their batch."""
    base = scratch_path(spark, "ingest")
    sales = st.events_as_sales(spark, d)
    late = sales.withColumn("Date", F.date_add("Date", 1))
    refunds = sales.filter(F.col("Revenue") > 0).withColumn("Revenue", -F.col("Revenue")) \
        .withColumn("Transaction_ID", F.regexp_replace("Transaction_ID", "^EVT", "REF"))
    st.write_daily_batches(sales, f"{base}/landing")
    st.write_daily_batches(late, f"{base}/landing", "late-", "append")
    st.write_daily_batches(refunds, f"{base}/landing", "refund-", "append")
    paths = st.run_ingest_once(spark, f"{base}/landing", base)
    stored = st.read_ingested(spark, paths["fact"]).select(
        F.lit("fact").alias("place"), F.lit("stored").alias("reason"), "Transaction_ID")
    held = spark.read.parquet(paths["quarantine"]).select(F.lit("quarantine").alias("place"), "reason", "Transaction_ID")
    return stored.unionByName(held).groupBy("place", "reason").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("Transaction_ID").alias("ids"))
