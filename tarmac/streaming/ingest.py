"""Incremental batch ingest with Structured Streaming (ST1, ST2, S14, S15).

New batch files landing in a folder are picked up by a file-source stream; each
file is one batch (its ``batch`` partition value). In ``foreachBatch`` every
batch of the micro-batch is validated as a unit with the five batch rules (one
grouped aggregate for all of them); passing batches are added to the stored
fact (partitioned by Year), failing ones are diverted whole to a quarantine
folder, and the per-batch reports are added to a report table. A trigger may take many files (``max_files``), so a backlog costs
one commit, not one per file.

Ids are unique over the whole store (ST2): a row whose Transaction_ID is already
stored, on whatever day, or that an earlier batch of the same trigger holds, goes
to the quarantine with the reason ``repeated_id`` and is counted in the reports.
The check reads no fact: stored ids are kept in a table of their own
(``streaming.id_index``), of which a trigger reads the parts its ids fall into.
Batches that arrive in the order of their ``batch`` values give the same fact and
quarantine for any ``max_files``.

Exactly-once: fact, ids, quarantine and reports of a micro-batch live in folders of
their own (``ingest_id=<micro-batch id>``) that a replay overwrites, and the id
check looks at the other micro-batches only. So a replay after a lost executor or
driver changes no table. Progress lives in the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.functions.columns import quarter_label
from tarmac.schema import SALES_COLUMNS, SALES_SCHEMA
from tarmac.session import path_exists
from tarmac.sources.ingest import validate_batches
from tarmac.sources.tables import read_table
from tarmac.streaming import id_index

FAILED, REPEATED = "failed_rules", "repeated_id"  # why a row is in the quarantine


def events_as_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase events of the given ``events`` table in the canonical sales schema."""
    ev = read_table(spark, sf_dir, "events").filter(F.col("event_type") == "purchase")
    d = F.to_date("ts")
    return ev.select(
        F.format_string("EVT-%d", "event_id").alias("Transaction_ID"), d.alias("Date"),
        F.year(d).alias("Year"), F.month(d).alias("Month"), F.date_format(d, "MMM").alias("Month_Name"),
        quarter_label(d).alias("Quarter"), F.lit("Purchase").alias("Product_Name"),
        F.col("event_type").alias("Category"), F.lit("Other").alias("Region"),
        F.format_string("User %d", "user_id").alias("Customer"), F.lit(1).alias("Units_Sold"),
        F.col("value").alias("Unit_Price"), F.col("value").alias("Revenue"),
        F.lit(None).cast("string").alias("ABC_Class"),
    )


def write_daily_batches(sales: DataFrame, folder: str, prefix: str = "", mode: str = "overwrite") -> None:
    """One batch per day (``batch=<prefix>YYYY-MM-DD`` sub-folders), as a nightly feed would land.

    The rebalance hint lets AQE split a day that is too large for one task; its files share the batch value.
    """
    (sales.withColumn("batch", F.concat(F.lit(prefix), F.date_format("Date", "yyyy-MM-dd")))
     .hint("rebalance", F.col("batch")).write.mode(mode).partitionBy("batch").parquet(folder))


def read_ingested(spark: SparkSession, target: str) -> DataFrame:
    """The stored fact in canonical columns, plus the micro-batch (``ingest_id``) of each row; without rows as long as
    no batch has passed."""
    schema = T.StructType(SALES_SCHEMA.fields + [T.StructField("ingest_id", T.LongType())])
    return spark.read.schema(schema).parquet(target).select(*SALES_COLUMNS, "ingest_id")


def make_batch_handler(target: str, quarantine: str, reports: str, ids: str | None = None):
    """The ``foreachBatch`` function: validate every batch, then append or divert.

    ``ids`` is the folder of the id index, by default ``<target>_ids``.
    """
    ids = ids or f"{target.rstrip('/')}_ids"

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if "batch" not in batch.columns:
            batch = batch.withColumn("batch", F.lit(str(batch_id)))
        batch = batch.select(*SALES_COLUMNS, "batch").persist()
        report = validate_batches(batch, "batch")
        status = report.groupBy("batch").agg(F.min("passed").alias("_ok"))  # one row per batch file
        # ids are unique inside a passing batch; of the batches of one trigger the earliest wins
        first = Window.partitionBy("Transaction_ID").orderBy(F.desc("_ok"), "batch")
        judged = batch.join(status, "batch").withColumn("_nth", F.row_number().over(first))
        good_ids = judged.filter("_ok AND _nth = 1").select("Transaction_ID")
        if not path_exists(spark, ids) and path_exists(spark, target):  # a store from before the index
            id_index.rebuild(read_ingested(spark, target).filter(F.col("ingest_id") != batch_id), ids)
        repeats = id_index.stored(spark, ids, good_ids, batch_id).withColumn("_stored", F.lit(True))
        judged = judged.join(repeats, "Transaction_ID", "left").withColumn(
            "reason", F.when(~F.col("_ok"), F.lit(FAILED))
            .when((F.col("_nth") > 1) | F.col("_stored"), F.lit(REPEATED))).persist()

        def write(df, folder, *parts):
            df.write.mode("overwrite").partitionBy(*parts).parquet(f"{folder}/ingest_id={batch_id}")

        kept = judged.filter(F.col("reason").isNull()).select(*SALES_COLUMNS)
        id_index.add(kept, ids, batch_id)  # before the fact: a replay overwrites both
        write(kept, target, "Year")
        write(judged.filter(F.col("reason").isNotNull()).select(*SALES_COLUMNS, "batch", "reason"), quarantine)
        dropped = judged.groupBy("batch").agg(F.count_if(F.col("reason") == REPEATED).alias("violations")).select(
            "batch", F.lit(REPEATED).alias("rule"), "violations", (F.col("violations") == 0).alias("passed"))
        write(report.unionByName(dropped), reports)
        judged.unpersist()
        batch.unpersist()

    return handle


def start_ingest(spark: SparkSession, source: str, target: str, quarantine: str, reports: str,
                 checkpoint: str, available_now: bool = True, clean_source: str = "off",
                 archive_dir: str | None = None, max_files: int | None = None):
    """ST1: start the incremental ingest stream; returns the StreamingQuery.

    ``clean_source`` = "delete" removes a batch file once its micro-batch is
    committed, "archive" moves it to ``archive_dir`` (S15: the batch is removed
    afterwards); "off" keeps it.
    """
    schema = T.StructType(SALES_SCHEMA.fields + [T.StructField("batch", T.StringType())])
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if clean_source != "off":
        reader = reader.option("cleanSource", clean_source)
        if clean_source == "archive":
            reader = reader.option("sourceArchiveDir", archive_dir)
    stream = reader.parquet(source)
    writer = (stream.writeStream.foreachBatch(make_batch_handler(target, quarantine, reports))
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def run_ingest_once(spark: SparkSession, source: str, base: str, clean_source: str = "off",
                    max_files: int | None = None) -> dict[str, str]:
    """Run the stream over everything present in ``source`` and stop; returns the folders."""
    paths = {k: f"{base}/{k}" for k in ["fact", "quarantine", "reports", "checkpoint", "archive"]}
    q = start_ingest(spark, source, paths["fact"], paths["quarantine"], paths["reports"], paths["checkpoint"],
                     clean_source=clean_source, archive_dir=paths["archive"], max_files=max_files)
    q.awaitTermination()
    return paths
