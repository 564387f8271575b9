"""Incremental ingest: valid batches appended once, failing batches diverted, replays idempotent."""

import datetime as dt

from pyspark.sql import functions as F

from tarmac.schema import SALES_SCHEMA
from tarmac.session import scratch_path
from tarmac.streaming import ingest as st


def _batch(spark, day, n, bad=False):
    d = dt.date.fromisoformat(day)
    rows = [(f"TXN-{day}-{i:03d}", d, d.year, d.month, d.strftime("%b"), "Q1", "P", "E", "R", "C",
             1, 10.0, 0.0 if (bad and i == 0) else 10.0, "A") for i in range(n)]
    return spark.createDataFrame(rows, SALES_SCHEMA)


def test_ingest_validates_and_is_idempotent(spark):
    base = scratch_path(spark, "test-ingest")
    landing = f"{base}/landing"
    good = _batch(spark, "2024-01-01", 30).unionByName(_batch(spark, "2024-01-02", 25))
    st.write_daily_batches(good.unionByName(_batch(spark, "2024-01-03", 40, bad=True)), landing)
    paths = st.run_ingest_once(spark, landing, base)
    fact = spark.read.parquet(paths["fact"])
    assert fact.count() == 55
    assert spark.read.parquet(paths["quarantine"]).count() == 40
    # replaying a batch (as after a failure) appends nothing new
    handler = st.make_batch_handler(paths["fact"], paths["quarantine"], paths["reports"])
    handler(_batch(spark, "2024-01-01", 30).withColumn("batch", F.lit("2024-01-01")), 99)
    # one trigger over several files validates each file on its own
    assert spark.read.parquet(paths["reports"]).select("batch").distinct().count() == 3
    assert spark.read.parquet(paths["fact"]).count() == 55
    assert fact.select("Transaction_ID").distinct().count() == 55


def test_fact_is_empty_when_every_batch_fails(spark):
    base = scratch_path(spark, "test-ingest-none")
    bad = _batch(spark, "2024-01-03", 6, bad=True).unionByName(_batch(spark, "2024-01-04", 4, bad=True))
    st.write_daily_batches(bad, f"{base}/landing")
    paths = st.run_ingest_once(spark, f"{base}/landing", base)
    fact = st.read_ingested(spark, paths["fact"])
    assert fact.columns == [*SALES_SCHEMA.names, "ingest_id"] and fact.count() == 0
    assert spark.read.parquet(paths["quarantine"]).count() == 10
    # a later batch that passes is stored beside it
    handler = st.make_batch_handler(paths["fact"], paths["quarantine"], paths["reports"])
    handler(_batch(spark, "2024-01-05", 3).withColumn("batch", F.lit("2024-01-05")), 7)
    assert {(r.Year, r.ingest_id) for r in st.read_ingested(spark, paths["fact"]).collect()} == {(2024, 7)}


def test_ingest_archives_processed_batches(spark):
    import glob
    base = scratch_path(spark, "test-ingest-archive")
    landing = f"{base}/landing"
    st.write_daily_batches(_batch(spark, "2024-02-01", 10).unionByName(_batch(spark, "2024-02-02", 12)), landing)
    paths = st.run_ingest_once(spark, landing, base, clean_source="archive", max_files=1)
    assert spark.read.parquet(paths["fact"]).count() == 22
    local = landing[len("file:"):] if landing.startswith("file:") else landing
    remaining = glob.glob(f"{local}/batch=*/*.parquet")
    # the file source archives a file once a later micro-batch has committed
    assert len(remaining) <= 1


def test_duplicate_ids_across_batches_of_one_trigger(spark):
    base = scratch_path(spark, "test-ingest-dup")
    landing = f"{base}/landing"
    a = _batch(spark, "2024-03-01", 5)
    # the next day's file repeats two ids of the first day
    b = _batch(spark, "2024-03-02", 5).withColumn(
        "Transaction_ID", F.when(F.col("Transaction_ID").endswith("000"), F.lit("TXN-2024-03-01-000"))
        .when(F.col("Transaction_ID").endswith("001"), F.lit("TXN-2024-03-01-001")).otherwise(F.col("Transaction_ID")))
    st.write_daily_batches(a.unionByName(b), landing)
    paths = st.run_ingest_once(spark, landing, base)
    fact = spark.read.parquet(paths["fact"])
    assert fact.count() == 8
    assert fact.select("Transaction_ID").distinct().count() == 8
    kept = {r["Transaction_ID"]: str(r["Date"]) for r in fact.collect()}
    assert kept["TXN-2024-03-01-000"] == "2024-03-01"


def test_any_trigger_size_and_replay_give_the_same_tables(spark):
    """One id on two days and one failing batch: the same fact and quarantine for any trigger size; a replay changes none."""
    seen = []
    for n in (None, 1):
        base = scratch_path(spark, "test-ingest-any")
        landing = f"{base}/landing"
        st.write_daily_batches(_batch(spark, "2024-04-01", 4), landing)
        again = _batch(spark, "2024-04-02", 4).withColumn("Transaction_ID", F.regexp_replace(
            "Transaction_ID", "2024-04-02-000", "2024-04-01-000"))
        st.write_daily_batches(again, landing, mode="append")
        st.write_daily_batches(_batch(spark, "2024-04-03", 3, bad=True), landing, mode="append")
        paths = st.run_ingest_once(spark, landing, base, max_files=n)

        def tables():
            fact = st.read_ingested(spark, paths["fact"]).select("Transaction_ID", "Date").collect()
            held = spark.read.parquet(paths["quarantine"]).select("Transaction_ID", "batch", "reason").collect()
            return sorted(map(tuple, fact)), sorted(map(tuple, held))

        before = tables()
        reports = spark.read.parquet(paths["reports"])
        rows = reports.count()
        assert reports.filter("rule = 'repeated_id'").agg(F.sum("violations")).first()[0] == 1
        last = reports.agg(F.max("ingest_id")).first()[0]
        if n is None:  # the whole trigger again
            st.make_batch_handler(paths["fact"], paths["quarantine"], paths["reports"])(
                spark.read.schema(SALES_SCHEMA).parquet(landing)
                .withColumn("batch", F.col("batch").cast("string")), last)
            assert tables() == before
            assert spark.read.parquet(paths["reports"]).count() == rows
        seen.append(before)
    assert seen[0] == seen[1]
    assert len(seen[0][0]) == 7
    assert [r for *_, r in seen[0][1]] == ["repeated_id"] + ["failed_rules"] * 3


def _scan(df):
    """(description, files, bytes) of the one file scan of ``df``, after it ran without adaptive stages."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    df = df.select("*")
    df.collect()
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    scans = [leaves.apply(i) for i in range(leaves.size()) if "FileScan" in leaves.apply(i).simpleString(9999)]
    assert len(scans) == 1
    metric = lambda name: scans[0].metrics().apply(name).value()
    return scans[0].simpleString(9999), metric("numFiles"), metric("filesSize")


def test_id_index_reads_only_touched_prefixes(spark):
    """Partition filters reach the scan, and what a trigger reads does not grow with the store."""
    from tarmac.streaming import id_index as ix
    folder = f"{scratch_path(spark, 'test-ids')}/ids"
    name = lambda lo, hi: spark.range(lo, hi).select(F.concat(F.lit("T"), F.col("id")).alias("Transaction_ID"))
    spark.conf.set("spark.tarmac.idsPerPrefix", "50")
    try:
        sizes, at = [], 0
        for n, rows in enumerate((100, 100, 200, 400, 800, 1600)):
            ix.add(name(at, at + rows), folder, n)
            at += rows
            few = name(at - 1, at + 1)  # one stored, one new
            text, files, size = _scan(ix.candidates(spark, folder, few, 99))
            assert "PartitionFilters: [" in text and "prefix#" in text.split("PartitionFilters")[1]
            sizes.append((files, size))
            assert [r[0] for r in ix.stored(spark, folder, few, 99).collect()] == [f"T{at - 1}"]
            whole = _scan(ix.read(spark, folder))
        levels = len(sizes)
        assert sizes[-1][0] <= 2 * levels and sizes[-1][1] < whole[2] / 10
        assert ix.read(spark, folder).groupBy("level", "prefix").count().agg(F.max("count")).first()[0] <= 150
        # the same micro-batch again: nothing twice, and its own ids do not count as stored
        ix.add(name(at - 1600, at), folder, 5)
        assert ix.read(spark, folder).count() == at
        assert ix.stored(spark, folder, name(at - 3, at), 5).count() == 0
        assert ix.stored(spark, folder, name(0, at + 10), 99).count() == at
    finally:
        spark.conf.unset("spark.tarmac.idsPerPrefix")


def test_levels():
    from tarmac.streaming import id_index as ix
    assert [ix.level_for(n, 10) for n in (0, 1, 10, 11, 20, 21, 40, 41, 10 ** 9)] == [0, 0, 0, 1, 1, 2, 2, 3, 27]


def test_store_without_an_index_gets_one(spark):
    base = scratch_path(spark, "test-ingest-old")
    st.write_daily_batches(_batch(spark, "2024-05-01", 12), f"{base}/landing")
    paths = st.run_ingest_once(spark, f"{base}/landing", base)
    handler = st.make_batch_handler(paths["fact"], paths["quarantine"], paths["reports"], f"{base}/new_ids")
    handler(_batch(spark, "2024-05-01", 15).withColumn("batch", F.lit("again")), 7)
    fact = spark.read.parquet(paths["fact"])
    assert fact.count() == fact.select("Transaction_ID").distinct().count() == 15
