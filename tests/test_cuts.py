"""Sums below a cent, rows without a dimension member, means over rows with revenue, default columns, tied values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tarmac.functions.columns import money_sum
from tarmac.operators import bi, scale
from tarmac.schema import SALES_SCHEMA
from tarmac.sources import ingest, sinks, star


def _sales(spark, rows):
    day = dt.date(2024, 1, 1)
    return spark.createDataFrame(
        [(f"T{i}", d, 2024, 1, "Jan", "Q1", p, "E", r, c, 1, v, v, "A")
         for i, (d, p, r, c, v) in enumerate((day if x[0] else None, *x[1:]) for x in rows)], SALES_SCHEMA)


def test_sums_keep_parts_below_a_cent(spark):
    def total(df):
        return df.agg(F.round(money_sum("v"), 2)).first()[0]

    assert total(spark.range(1000).select(F.lit(0.004).alias("v"))) == 4.0
    assert total(spark.range(60000).select(F.lit(38000 / 6).alias("v"))) == 380_000_000.0
    assert total(spark.createDataFrame([(-0.005,), (1e15,), (None,), (0.015,)], "v double")) == 1e15 + 0.01


def test_star_keeps_rows_without_a_member(spark):
    sales = _sales(spark, [(True, "P", "R", "C", 1.0), (True, None, "R", "C", 2.0), (True, "P", "R", None, 3.0),
                           (False, "P", "R", "C", 4.0)])
    flat = star.star_flat(star.build_star(sales))
    got = {r["Transaction_ID"]: (r["Product_Name"], r["Customer"], r["Date"] is None) for r in flat.collect()}
    assert got == {"T0": ("P", "C", False), "T1": (None, "C", False), "T2": ("P", None, False), "T3": ("P", "C", True)}


def test_means_skip_missing_revenue_and_exports_skip_missing_keys(spark):
    sales = _sales(spark, [(True, "P", "R", "C", 10.0), (True, "P", None, "C", None)])
    assert bi.kpis(sales).first()["avg_order_value"] == 10.0
    assert sinks.kpi_export(sales).collect()[3]["Value"] == "$10"
    assert [tuple(r) for r in sinks.export_sheet("customers", sales).collect()] == [("C", "R", 10.0, 1)]


def test_default_columns(spark):
    raw = spark.createDataFrame([("Engine", None), ("Cabin", 2), ("?", 3), (None, 1)], "category string, units int")
    rows = ingest.conform(raw).collect()
    assert [r["Unit_Price"] for r in rows] == [12000.0, 3000.0, 38000 / 6, 38000 / 6]
    assert [r["Revenue"] for r in rows] == [None, 6000.0, 19000.0, 38000 / 6]
    assert [str(r["Date"]) for r in rows] == ["2022-01-01", "2022-01-02", "2022-01-03", "2022-01-04"]
    assert {r["Transaction_ID"] for r in rows} == {f"TXN-0000{i}" for i in (1, 2, 3, 4)}
    assert ingest.conform(raw.drop("units")).first()["Units_Sold"] == 1


def test_quantiles_of_tied_values(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, F.lit(5.0)).otherwise(F.col("id") * 1.0).alias("v"))
    assert scale.exact_quantiles(df, {"v": [0.0, 0.25, 0.5, 0.95, 1.0]})["v"] == pytest.approx(
        [5.0, 5.0, 5.0, 949.05, 999.0])
