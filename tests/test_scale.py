"""The two-phase (range-partitioned) primitives equal the single-window forms."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarmac.operators import scale


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"k": rng.integers(0, 50, 1000).astype(float),  # many ties
                        "name": [f"n{i:04d}" for i in range(1000)],
                        "v": rng.integers(1, 100, 1000)})
    return spark.createDataFrame(pdf).repartition(7)


def test_running_total_two_phase(frame):
    order = [F.col("k").desc(), F.col("name").asc()]
    a = scale.running_total(frame, order, "v", "cum", "tot", small=True).select("name", "cum", "tot")
    b = scale.running_total(frame, order, "v", "cum", "tot", small=False).select("name", "cum", "tot")
    assert sorted(a.collect()) == sorted(b.collect())
    assert b.agg(F.max("cum")).first()[0] == b.first()["tot"]


def test_ordered_row_id_two_phase(frame):
    order = [F.col("k").asc(), F.col("name").asc()]
    a = scale.ordered_row_id(frame, order, "rid", start=1, small=True).select("name", "rid")
    b = scale.ordered_row_id(frame, order, "rid", start=1, small=False).select("name", "rid")
    assert sorted(a.collect()) == sorted(b.collect())
    ids = sorted(r["rid"] for r in b.collect())
    assert ids == list(range(1, 1001))


def test_positional_row_id(frame):
    b = scale.ordered_row_id(frame, None, "rid", start=0)
    ids = sorted(r["rid"] for r in b.collect())
    assert ids == list(range(1000))


@pytest.mark.parametrize("rows,bits", [(100_000, 16), (20, 16), (0, 7), (0, 16)])
def test_exact_quantiles(spark, frame, monkeypatch, rows, bits):
    """Also with so few rows for the last round that prefixes are refined to the end."""
    monkeypatch.setattr(scale, "SELECT_ROWS", rows)
    monkeypatch.setattr(scale, "KEY_BITS", bits)
    probs = [0.0, 0.25, 0.5, 0.6, 0.75, 1.0]
    wide = [-1e300, -2.5, -2.5, -1e-300, -0.0, 0.0, 5e-324, 1e-9, 3.0, 3.0, 3.0, 7e200, None, 1e308]
    odd = spark.createDataFrame([(x, None, 4.0) for x in wide], "w double, e double, s double")
    got = scale.exact_quantiles(odd, {"w": [0.0, 0.3, 0.5, 1.0], "e": probs, "s": [0.1, 0.9]})
    want = np.percentile([x for x in wide if x is not None], [0, 30, 50, 100])
    assert got == {"w": pytest.approx(want.tolist()), "e": [], "s": [4.0, 4.0]}
    if bits == 16:
        a = scale.exact_quantiles(frame, {"k": probs, "v": probs})
        pdf = frame.toPandas()
        for c in ["k", "v"]:
            assert a[c] == pytest.approx(np.percentile(pdf[c].to_numpy(dtype=float), [p * 100 for p in probs]).tolist())


def test_average_rank_pct(frame):
    pdf = frame.toPandas()
    want = dict(zip(pdf["name"], pdf["k"].rank(pct=True)))
    for small in (True, False):
        got = scale.average_rank_pct(frame, "k", "pct", small=small).select("name", "pct").collect()
        assert {r["name"]: r["pct"] for r in got} == pytest.approx(want)


def test_bounded(frame):
    assert scale.bounded(frame, 1000) and not scale.bounded(frame, 999)


def test_window_free_of_single_partition_on_raw_rows(frame):
    """The two-phase running total plans no window without partitionBy over the input rows."""
    plan = scale.running_total(frame, [F.col("k").asc(), F.col("name").asc()], "v", "c", small=False)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in text.split("BroadcastExchange")[0]


@pytest.mark.parametrize("kind", ["csv", "parquet"])
def test_file_order_ids(spark, tmp_path, kind):
    """Files of unequal size in splits so small that one file is many tasks and tasks mix files: ids follow the files."""
    from tarmac.sources import ingest
    sizes, at = [3000, 1, 700, 0, 2500, 40], 0
    for i, n in enumerate(sizes):
        rows = pd.DataFrame({"product": [f"p{at + j:06d}" for j in range(n)], "note": "x" * 40})
        if kind == "csv":
            rows.to_csv(tmp_path / f"part-{i}.csv", index=False)
        else:
            rows.astype({"product": str, "note": str}).to_parquet(tmp_path / f"part-{i}.parquet", row_group_size=300)
        at += n
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000" if kind == "csv" else "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "500")
    try:
        raw = spark.read.option("header", True).csv(str(tmp_path)) if kind == "csv" else spark.read.parquet(str(tmp_path))
        assert raw.rdd.getNumPartitions() > 8
        got = ingest.numbered(raw).select("product", "_pos").collect()
        assert sorted((r._pos, r.product) for r in got) == [(i, f"p{i:06d}") for i in range(at)]
        sales = ingest.conform(ingest.numbered(raw)).collect()
        assert {r.Transaction_ID: r.Product_Name for r in sales} == {f"TXN-{i + 1:05d}": f"p{i:06d}" for i in range(at)}
        assert {(r.Units_Sold, str(r.Date)) for r in sales if r.Transaction_ID == "TXN-00003"} == {(1, "2022-01-03")}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
