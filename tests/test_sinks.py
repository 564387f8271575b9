"""Sinks, exports, guards and the ad-hoc SQL runner."""

import os

import pytest
from pyspark.sql import functions as F

from tarmac.operators import abc
from tarmac.operators.adhoc import clean_sql, run_sql, sql_view
from tarmac.schema import SALES_SCHEMA
from tarmac.session import scratch_path
from tarmac.sources import ingest, sinks


def _local(path: str) -> str:
    return path[len("file:"):] if path.startswith("file:") else path


def test_parquet_roundtrip_and_append(spark, sales):
    path = scratch_path(spark, "t-fact")
    fact = abc.with_abc_class(sales)
    sinks.write_sales_parquet(fact, path)
    back = ingest.read_sales_parquet(spark, path)
    assert back.count() == sales.count()
    assert sorted(back.columns) == sorted(f.name for f in SALES_SCHEMA.fields)
    assert os.path.isdir(os.path.join(_local(path), "Year=1998"))
    sinks.append_batch(fact.filter(F.col("Year") == 1998), path)
    again = ingest.read_sales_parquet(spark, path)
    assert again.count() == sales.count() + sales.filter(F.col("Year") == 1998).count()


def test_csv_sink_and_raw_reader(spark, sales):
    path = scratch_path(spark, "t-csv")
    sinks.write_csv(sales.limit(50), path)
    raw = ingest.read_raw(spark, path)
    assert raw.count() == 50
    assert dict(raw.dtypes)["Units_Sold"] == "int"


def test_min_rows_guard(spark, sales):
    assert ingest.require_min_rows(sales, 100)
    assert not ingest.require_min_rows(sales.limit(99), 100)


def test_exports(spark, sales):
    base = scratch_path(spark, "t-export")
    sheet = sinks.export_sheet("customers", sales)
    assert sheet.columns == ["Customer", "Region", "Revenue", "Transactions"]
    for fmt in ["csv", "json", "parquet"]:
        sinks.export(sheet, sinks.export_path(base, "customers", fmt), fmt, preview_rows=100)
    back = spark.read.parquet(sinks.export_path(base, "customers", "parquet"))
    assert back.count() == 100
    assert sinks.export_sheet("abc", sales).count() == sales.select("Product_Name").distinct().count()
    assert [r["Metric"] for r in sinks.export_sheet("kpis", sales).collect()] == [
        "Total Revenue", "Total Units", "Transactions", "Avg Order Value", "Customers"]
    with pytest.raises(ValueError):
        sinks.export_sheet("nope", sales)


def test_run_sql_cleans_caps_and_reports_errors(spark, sales):
    sql_view(sales)
    assert clean_sql("```sql\nSELECT 1\n```") == "SELECT 1"
    assert run_sql(spark, "```sql SELECT * FROM fact_sales```").count() == 50
    err = run_sql(spark, "SELECT nope FROM fact_sales").first()
    assert err["error"] and "nope" in err["error"]


def test_star_write_read_roundtrip(spark, sales):
    from tarmac.sources import star
    fact = abc.with_abc_class(sales)
    built = star.build_star(fact)
    base = scratch_path(spark, "t-star")
    star.write_star(built, base)
    back = star.read_star(spark, base)
    assert set(back) == set(star.STAR_TABLES)
    flat = star.star_flat(back)
    assert flat.count() == sales.count()
    assert sorted(flat.columns) == sorted(fact.columns)
    ids = back["fact_sales"].agg(F.min("txn_id"), F.max("txn_id"), F.count_distinct("txn_id")).first()
    assert (ids[0], ids[1], ids[2]) == (1, sales.count(), sales.count())


def test_load_and_save_raw_single_pass(spark, sales):
    raw_path = scratch_path(spark, "t-raw")
    raw = sales.select(F.col("Transaction_ID").alias("txn_id"), F.col("Date").alias("date"),
                       F.col("Product_Name").alias("product"), F.col("Category").alias("category"),
                       F.col("Region").alias("region"), F.col("Customer").alias("client"),
                       F.col("Units_Sold").alias("units"), F.col("Unit_Price").alias("price"))
    sinks.write_csv(raw, raw_path)
    stored = ingest.load_and_save_raw(spark, raw_path, scratch_path(spark, "t-raw-fact"))
    lazy = ingest.load_raw_sales(spark, raw_path)
    assert stored.count() == sales.count()
    key = ["Transaction_ID", "Product_Name", "ABC_Class"]
    assert sorted(stored.select(*key).collect()) == sorted(lazy.select(*key).collect())


def test_sql_fences():
    assert clean_sql("SELECT 1 AS `x`") == "SELECT 1 AS `x`"
    assert clean_sql("```SQL\nSELECT 2\n```\n") == "SELECT 2"
    assert clean_sql("sqlite") == "sqlite" and clean_sql("sql SELECT 3") == "SELECT 3"
    assert clean_sql("``` SELECT `a` FROM t ```") == "SELECT `a` FROM t"


@pytest.mark.parametrize("text", ["DROP VIEW fact_sales", "CREATE TABLE x AS SELECT 1", "INSERT INTO x SELECT 1", "SET a=1",
                                  "CACHE TABLE fact_sales", "SELECT 1; SELECT 2", "", "SELECT 1/0",
                                  "SELECT raise_error('no') FROM fact_sales", "SELECT CAST('x' AS INT)"])
def test_run_sql_only_runs_queries(spark, sales, text):
    sql_view(sales)
    got = run_sql(spark, text)
    assert got.columns == ["sql", "error"] and got.count() == 1
    assert run_sql(spark, "WITH a AS (SELECT 1 AS x) SELECT x FROM a UNION ALL VALUES (2)").count() == 2
    assert spark.catalog.tableExists("fact_sales")
