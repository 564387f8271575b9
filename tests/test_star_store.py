"""The star that grows load by load: replays, broken loads, empty loads, null keys, and what a merge reads."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tarmac.operators import abc
from tarmac.schema import SALES_SCHEMA
from tarmac.session import path_exists, scratch_path
from tarmac.sources import star, star_store


@pytest.fixture(scope="module")
def fact(spark, sales):
    return abc.with_abc_class(sales).persist()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def tables(spark, base):
    return {n: rows(df) for n, df in star_store.read(spark, base).items()}


def test_two_loads_equal_one_and_a_replay_changes_nothing(spark, fact):
    base = scratch_path(spark, "t-loads")
    assert all(df.count() == 0 for df in star_store.read(spark, base).values())
    assert star_store.merge(fact.filter("Year <= 1998"), base, "a")
    assert star_store.merge(fact.filter("Year > 1998"), base, "b")
    got = tables(spark, base)
    assert got == {n: rows(df) for n, df in star.build_star(fact).items()}
    assert not star_store.merge(fact.filter("Year <= 1998"), base, "a")
    assert tables(spark, base) == got
    assert [tuple(r)[-1] for r in star_store.loads(spark, base).orderBy("load").collect()] == [1, 2]


def test_a_broken_load_is_not_seen_and_is_overwritten(spark, fact, monkeypatch):
    base = scratch_path(spark, "t-broken")
    star_store.merge(fact.filter("Year <= 1996"), base, "a")
    before = tables(spark, base)
    with monkeypatch.context() as m:  # the members of the load are written, its facts are not
        m.setattr(star, "fact_sales", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            star_store.merge(fact.filter("Year > 1998"), base, "b")
    assert path_exists(spark, os.path.join(base, "dim_customer", "load=2"))
    assert tables(spark, base) == before
    star_store.merge(fact.filter("Year IN (1997, 1998)"), base, "c")
    star_store.merge(fact.filter("Year > 1998"), base, "b")
    assert tables(spark, base) == {n: rows(df) for n, df in star.build_star(fact).items()}


def test_empty_loads_null_keys_and_kept_members(spark, fact):
    base = scratch_path(spark, "t-odd")
    star_store.merge(fact.limit(0), base, "none")
    one = fact.orderBy("Transaction_ID").limit(1)
    star_store.merge(one, base, "one")
    odd = one.unionByName(one.withColumns({"Product_Name": F.lit(None).cast("string"), "Date": F.lit(None).cast("date"),
                                           "Customer": F.lit(None).cast("string")}))
    star_store.merge(odd.withColumn("Region", F.lit("elsewhere")), base, "odd")
    got = star_store.read(spark, base)
    assert [r.load for r in star_store.loads(spark, base).orderBy("load").collect()] == [1, 2, 3]
    assert got["dim_customer"].count() == got["dim_product"].count() == got["dim_date"].count() == 1
    assert got["dim_customer"].first().region == one.first().Region  # a stored member keeps its attributes
    keys = sorted(map(tuple, got["fact_sales"].select("txn_id", "product_id", "customer_id").collect()))
    assert [k[0] for k in keys] == [1, 2, 3]
    assert sorted((k[1] is None, k[2] is None) for k in keys) == [(False, False), (False, False), (True, True)]
    assert star.star_flat(got).count() == 3


def test_a_merge_reads_no_stored_fact(spark, fact):
    base = scratch_path(spark, "t-reads")
    star_store.merge(fact.filter("Year <= 1998"), base, "a")
    # Without the facts of the first load the second gets the same keys.
    stored = os.path.join(base.removeprefix("file:"), "fact_sales")
    os.rename(stored, stored + "-away")
    star_store.merge(fact.filter("Year > 1998"), base, "b")
    got = rows(star_store.read(spark, base)["fact_sales"])
    first = fact.filter("Year <= 1998").count()
    assert got == [r for r in rows(star.build_star(fact)["fact_sales"]) if r[0] > first]


def test_star_works_out_its_rows_once(spark):
    """Every table of a build, and of a merged load, reads stored rows; the flat input is not worked out again."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    day = dt.date(2024, 1, 1)
    rows = [(f"T{i:02d}", day, 2024, 1, "Jan", "Q1", f"P{i % 3}", "E", "R", None if i == 4 else f"C{i % 5}", 1, 10.0,
             10.0, "A") for i in range(20)]
    flat = spark.createDataFrame(rows + rows[:1], SALES_SCHEMA)
    frame = flat.mapInArrow(run, SALES_SCHEMA)
    built = {n: sorted(map(tuple, df.collect()), key=str) for n, df in star.build_star(frame).items()}
    assert seen.value == 21 and len(built["fact_sales"]) == 21 and len(built["dim_customer"]) == 5
    base = scratch_path(spark, "test-star-once")
    assert star_store.merge(frame, base, "one")
    assert seen.value == 42
    assert len(star_store.read(spark, base)["fact_sales"].collect()) == 21


def test_star_queries_work_out_the_sales_once(spark, monkeypatch):
    """The classes and the tables of a star read stored sales, small or large; the joins under them run once."""
    from tarmac.plans import QUERIES, ingest_queries, load_all
    load_all()
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    day = dt.date(2024, 1, 1)
    base = [(f"T{i:02d}", day, 2024, 1, "Jan", "Q1", f"P{i % 3}", "E", "R", f"C{i % 5}", 1, 10.0, 10.0) for i in range(20)]
    schema = type(SALES_SCHEMA)(SALES_SCHEMA.fields[:13])
    monkeypatch.setattr(ingest_queries, "sales_view",
                        lambda *a, **k: spark.createDataFrame(base, schema).mapInArrow(run, schema))
    assert len(QUERIES["star_flat"](spark, "-").collect()) == 20
    assert seen.value == 20
    assert tuple(QUERIES["star_fact_keys"](spark, "-").first()) == (20, 20, 1, 20)
    assert seen.value == 40
    spark.conf.set("spark.tarmac.broadcastRows", "2")
    try:
        assert len(QUERIES["star_flat"](spark, "-").collect()) == 20
    finally:
        spark.conf.unset("spark.tarmac.broadcastRows")
    assert seen.value == 60


def test_sales_by_order_are_the_same_rows(spark, sales):
    from paths import SF_SMALL
    from tarmac.sources.tables import sales_view
    other = sales_view(spark, SF_SMALL, by_order=True)
    assert other.schema == sales.schema
    assert rows(other) == rows(sales)


def test_members_keep_their_first_row_and_order(spark):
    """First by date, then by id; a name's later rows change neither its key nor its attributes."""
    d = [dt.date(2024, 1, 2), dt.date(2024, 1, 1), None]
    flat = spark.createDataFrame(
        [("T2", d[0], 2024, 1, "Jan", "Q1", "P", "late", "Z", "C", 1, 1.0, 1.0, "A"),
         ("T9", d[1], 2024, 1, "Jan", "Q1", "P", "early", "Y", "C", 1, 1.0, 1.0, "B"),
         ("T1", d[1], 2024, 1, "Jan", "Q1", "Q", "one", "X", "D", 1, 1.0, 1.0, "C"),
         ("T5", d[2], None, None, None, None, "Q", "none", None, None, 1, 1.0, 1.0, None)], SALES_SCHEMA)
    assert rows(star.dim_product(flat)) == [(1, "Q", "none", 0.0, None), (2, "P", "early", 0.0, "B")]
    assert rows(star.dim_customer(flat)) == [(1, "D", "X"), (2, "C", "Y")]
