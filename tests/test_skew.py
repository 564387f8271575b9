"""One customer holding a third of all rows: results stay exact and whole."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from tarmac.operators import abc, bi, customers, scale
from tarmac.schema import SALES_SCHEMA
from tarmac.sources import star


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    n = 3000
    cust = np.where(np.arange(n) % 3 == 0, "HOT", np.array([f"C{i % 97}" for i in range(n)]))
    days = rng.integers(0, 700, n)
    rows = []
    for i in range(n):
        d = dt.date(2022, 1, 1) + dt.timedelta(days=int(days[i]))
        units = int(rng.integers(1, 5))
        price = float(rng.integers(100, 10000)) / 100
        rows.append((f"T{i}", d, d.year, d.month, d.strftime("%b"), f"Q{(d.month - 1) // 3 + 1}",
                     f"P{i % 11}", f"K{i % 3}", "R0" if cust[i] == "HOT" else f"R{(i % 97) % 4}", str(cust[i]), units, price, round(units * price, 2), None))
    return spark.createDataFrame(rows, SALES_SCHEMA).repartition(8)


def test_customer_table_exact_under_skew(skewed):
    pdf = skewed.toPandas()
    want = pdf.groupby("Customer").agg(revenue=("Revenue", "sum"), transactions=("Transaction_ID", "count"))
    got = {r["customer"]: r for r in bi.customers_table(skewed).collect()}
    assert got["HOT"]["transactions"] == 1000
    for c, row in want.iterrows():
        assert got[c]["revenue"] == pytest.approx(round(row["revenue"], 2), abs=1e-6)
        assert got[c]["transactions"] == row["transactions"]


def test_top_products_per_customer_under_skew(skewed):
    pdf = skewed.toPandas()
    hot = pdf[pdf.Customer == "HOT"].groupby("Product_Name")["Revenue"].sum().round(2)
    want = hot.sort_values(ascending=False).head(5)
    got = bi.customer_top_products(skewed, "HOT", 5).orderBy("rank").collect()
    assert [r["product"] for r in got] == list(want.index)


def test_cohorts_under_skew(skewed):
    pdf = skewed.toPandas()
    pdf["ym"] = pd.to_datetime(pdf["Date"]).dt.to_period("M")
    first = pdf.groupby("Customer")["ym"].min()
    got = customers.cohort_retention(skewed).collect()
    sizes = {}
    for r in got:
        if r["age"] == 0:
            sizes[r["cohort"]] = r["size"]
    assert sum(sizes.values()) == len(first)
    assert sum(r["active"] for r in got) == pdf.groupby(["Customer", "ym"]).ngroups


@pytest.fixture
def beyond_broadcast(spark):
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.tarmac.broadcastRows", "5")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.tarmac.broadcastRows")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)


def _hot_sales(spark, n=40_000):
    """90 % of the rows on one product, a twentieth without any, the rest on 500."""
    i = F.col("id")
    product = (F.when(i % 20 < 18, F.lit("HOT")).when(i % 20 == 18, F.lit(None))
               .otherwise(F.concat(F.lit("P"), (i % 500).cast("string"))))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (i % 300).cast("int"))
    return spark.range(0, n, 1, 8).select(
        F.concat(F.lit("T"), i).alias("Transaction_ID"), day.alias("Date"), F.year(day).alias("Year"),
        F.month(day).alias("Month"), F.date_format(day, "MMM").alias("Month_Name"),
        F.concat(F.lit("Q"), F.quarter(day)).alias("Quarter"), product.alias("Product_Name"), F.lit("K").alias("Category"),
        F.lit("R").alias("Region"), F.concat(F.lit("C"), (i % 50)).alias("Customer"), F.lit(1).alias("Units_Sold"),
        (i % 7 + 1).cast("double").alias("Unit_Price"), (i % 7 + 1).cast("double").alias("Revenue"),
        F.lit(None).cast("string").alias("ABC_Class"))


def _evenly(df):
    sizes = sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())
    return sizes[-1] <= 3 * sizes[len(sizes) // 2]


def test_hot_product_above_the_broadcast_bound(spark, beyond_broadcast):
    sales = _hot_sales(spark)
    classes, _ = abc.product_classes(sales)
    want = {r[0]: r[1] for r in classes.collect()}
    out = abc.with_abc_class(sales)
    rows = out.select("Transaction_ID", "Product_Name", "ABC_Class").collect()
    assert len(rows) == 40_000 and len({r[0] for r in rows}) == 40_000
    assert all(r[2] == want.get(r[1]) for r in rows)
    assert out.columns == sales.columns
    assert _evenly(out)


def test_star_round_trip_of_a_hot_product(spark, beyond_broadcast):
    sales = _hot_sales(spark)
    tables = star.build_star(sales)
    flat = star.star_flat(tables)
    cols = ["Transaction_ID", "Product_Name", "Customer", "Date", "Revenue"]
    assert flat.select(*cols).exceptAll(sales.select(*cols)).count() == 0
    assert flat.count() == 40_000
    assert _evenly(scale.lookup_join(tables["fact_sales"].repartition(8), tables["dim_product"], "product_id"))


def test_heavy_keys(spark, beyond_broadcast):
    df = _hot_sales(spark)
    assert [r[0] for r in scale.heavy_keys(df, "Product_Name").collect()] == ["HOT"]
    assert scale.heavy_keys(df.limit(0), "Product_Name").count() == 0
    right = df.select("Product_Name").distinct().filter("Product_Name IS NOT NULL").withColumn("x", F.lit(1))
    joined = scale.lookup_join(df, right, "Product_Name")
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "broadcast" in plan
    assert joined.filter("x IS NULL").count() == df.filter("Product_Name IS NULL").count()


def _exchanges(df):
    """The columns of the shuffles by a key in the plan of ``df``: {key: [names, ...]}."""
    found = {}

    def walk(plan):
        if plan.nodeName() == "Exchange" and "hashpartitioning" in plan.toString().split("\n")[0]:
            key = plan.toString().split("\n")[0].split("hashpartitioning(")[1].split("#")[0]
            found.setdefault(key, []).append({a.name() for a in _items(plan.output())})
        for c in _items(plan.children()):
            walk(c)

    walk(df._jdf.queryExecution().executedPlan().initialPlan())
    return found


def _items(seq):
    return [seq.apply(i) for i in range(seq.size())]


def test_flat_read_back_shuffles_no_dates(spark, beyond_broadcast):
    """A dimension beyond the bound meets rows of keys and values, before the calendar is added to them."""
    tables = star.build_star(_hot_sales(spark, 2000))
    shuffled = _exchanges(star.star_flat(tables))["customer_id"]
    assert any("txn_code" in names for names in shuffled)
    assert not any({"date", "month_name", "quarter"} & names for names in shuffled)


def test_counting_codes_shuffles_codes_only(spark, monkeypatch):
    from tarmac.plans import QUERIES, ingest_queries, load_all
    load_all()
    monkeypatch.setattr(ingest_queries, "sales_view", lambda *a, **k: _hot_sales(spark, 2000).drop("ABC_Class"))
    out = QUERIES["star_fact_keys"](spark, "-")
    assert tuple(out.first()) == (2000, 2000, 1, 2000)
    assert _exchanges(out)["txn_code"] == [{"txn_code"}]


def test_heavy_keys_are_exact_among_many(spark):
    """Values just above and below an even share, among thousands of rare ones; numbers, texts and nulls."""
    n = 40_000
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = n // parts
    i = F.col("id")
    k = (F.when(i < share + 1, "above").when(i < 2 * share, "below").when(i < 2 * share + 500, F.lit(None))
         .otherwise(F.concat(F.lit("r"), (i % 15_000))))
    df = spark.range(0, n + 500, 1, 8).select(k.alias("k"), F.when(k == "above", 7).when(k.isNotNull(), F.hash(k))
                                              .cast("long").alias("m")).repartition(8, F.hash("k") % 3, F.rand(1))
    assert [r[0] for r in scale.heavy_keys(df, "k").collect()] == ["above"]
    got = scale.heavy_keys(df, "m")
    assert got.schema["m"].dataType == df.schema["m"].dataType
    assert 7 in [r[0] for r in got.collect()] and got.count() <= 2
    plan = df.filter("k IS NULL")
    assert scale.heavy_keys(plan, "k").count() == 0


def test_heavy_keys_group_no_rows_without_a_candidate(spark, monkeypatch):
    """The sketch tells that none is heavy; no value is grouped, and so none is shuffled."""
    group = type(spark.range(0)).groupBy
    df = spark.range(0, 30_000, 1, 4).select(F.concat(F.lit("v"), F.col("id")).alias("k"))

    def grouped(df, *keys):
        assert not keys
        return group(df)

    monkeypatch.setattr(type(df), "groupBy", grouped)
    assert scale.heavy_keys(df, "k").collect() == []


def test_stored_rows_leave_no_shuffle_files(spark):
    """What a stored table was shuffled through is gone with its write; the shuffles of others are not."""
    import time

    from tarmac.session import CLEANUP, stored

    def files():
        every = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for f in every.mkString("\n").split("\n") if "shuffle_" in f}

    df = spark.range(0, 1000, 1, 4).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).count()
    kept = df.repartition(3)
    assert kept.count() == 7
    before, setting = files(), spark.conf.get(CLEANUP, None)
    table = stored(df, "t-stored")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert spark.conf.get(CLEANUP, None) == setting
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, kept.collect()))
