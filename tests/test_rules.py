"""Edge rules on small hand-made frames (FIXTURES.md section 7)."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tarmac.functions.stats import t_two_sided_p
from tarmac.operators import abc, bi, customers, elasticity
from tarmac.schema import SALES_SCHEMA
from tarmac.sources import ingest


def fact(spark, rows):
    """Rows of (txn, date, product, category, region, customer, units, price)."""
    out = []
    for txn, d, p, c, r, cu, u, pr in rows:
        d = dt.date.fromisoformat(d)
        out.append((txn, d, d.year, d.month, d.strftime("%b"), f"Q{(d.month - 1) // 3 + 1}", p, c, r, cu,
                    u, float(pr), float(u * pr), None))
    return spark.createDataFrame(out, SALES_SCHEMA)


def test_abc_limits_inclusive_and_ties(spark):
    s = fact(spark, [("T1", "2022-01-01", "P1", "E", "R", "C", 1, 70.0),
                     ("T2", "2022-01-02", "P2", "E", "R", "C", 1, 20.0),
                     ("T3", "2022-01-03", "P3", "E", "R", "C", 1, 5.0),
                     ("T4", "2022-01-04", "P4", "E", "R", "C", 1, 5.0)])
    got = {r["name"]: (r["cumulative_pct"], r["abc"]) for r in abc.abc_products(s).collect()}
    assert got["P1"] == (70.0, "A")
    assert got["P2"] == (90.0, "B")
    # equal revenue: the name decides the order
    assert got["P3"] == (95.0, "C") and got["P4"] == (100.0, "C")
    summary = {r["abc"]: (r["count"], r["revenue_pct"]) for r in abc.abc_summary(s).collect()}
    assert summary == {"A": (1, 70.0), "B": (1, 20.0), "C": (2, 10.0)}


def test_abc_summary_keeps_empty_class(spark):
    s = fact(spark, [("T1", "2022-01-01", "P1", "E", "R", "C", 1, 100.0)])
    summary = {r["abc"]: r["count"] for r in abc.abc_summary(s).collect()}
    assert summary == {"A": 0, "B": 0, "C": 1}


def test_rfm_single_value_and_rank_fallback(spark):
    # one recency for all; frequencies 1,1,1,1,1,2,3,9 -> qcut edges collide -> percent-rank fallback
    rows, k = [], 0
    for i, f in enumerate([1, 1, 1, 1, 1, 2, 3, 9]):
        for _ in range(f):
            k += 1
            rows.append((f"T{k}", "2022-03-01", "P", "E", "R", f"C{i}", 1, 10.0 * (i + 1)))
    s = fact(spark, rows)
    out = {r["customer"]: r for r in customers.rfm(s, "2022-03-02").collect()}
    assert {r["recency_score"] for r in out.values()} == {4}
    freq = [out[f"C{i}"]["frequency_score"] for i in range(8)]
    assert freq == [1, 1, 1, 1, 1, 2, 3, 3]


def test_rfm_segments(spark):
    s = fact(spark, [(f"T{i}", f"2022-01-{i + 1:02d}", "P", "E", "R", f"C{i}", 1, 10.0 * (i + 1)) for i in range(8)])
    out = customers.rfm(s, "2022-02-01").collect()
    for r in out:
        assert r["rfm_score"] == r["recency_score"] + r["frequency_score"] + r["monetary_score"]
        want = ("Champions" if r["rfm_score"] >= 10 else "Loyal Customers" if r["rfm_score"] >= 8
                else "Potential Loyalists" if r["rfm_score"] >= 6 else "At Risk" if r["rfm_score"] >= 4 else "Lost")
        assert r["segment"] == want


def test_null_keys_dropped(spark):
    s = fact(spark, [("T1", "2022-01-01", "P", None, "R", None, 1, 10.0),
                     ("T2", "2022-01-01", "P", "E", "R", "C", 1, 10.0)])
    assert [r["name"] for r in bi.revenue_share(s, "Category").collect()] == ["E"]
    assert [r["customer"] for r in bi.customers_table(s).collect()] == ["C"]


def test_cohort_gap(spark):
    s = fact(spark, [("T1", "2022-01-05", "P", "E", "R", "C", 1, 10.0),
                     ("T2", "2022-06-05", "P", "E", "R", "C", 1, 10.0)])
    got = [(r["cohort"], r["age"], r["retention"]) for r in customers.cohort_retention(s).collect()]
    assert got == [("2022-01", 0, 100.0), ("2022-01", 5, 100.0)]


def test_yoy_zero_base(spark):
    s = fact(spark, [("T1", "2023-01-05", "P", "E", "R", "C", 1, 10.0)])
    r = bi.kpis(s, current_year=2023, base_year=2022).first()
    assert r["yoy_growth"] == 0.0 and r["total_revenue"] == 10.0


def test_elasticity_skips_short_and_clips(spark):
    rows = []
    for m in range(1, 6):  # five months only -> skipped
        rows.append((f"A{m}", f"2022-{m:02d}-01", "P", "Short", "R", "C", 1, 10.0 + m))
    for m in range(1, 8):
        rows.append((f"B{m}", f"2022-{m:02d}-01", "P", "Long", "R", "C", m, 100.0 - m))
    s = fact(spark, rows)
    got = elasticity.elasticity(s).collect()
    assert [r["category"] for r in got] == ["Long"]
    assert got[0]["months"] == 7


def test_t_pvalue_matches_integration(spark):
    import math

    import numpy as np

    def p_numeric(t, nu):
        if nu == 1:  # Cauchy: closed form (its tail is too heavy for the finite grid)
            return 1 - 2 / math.pi * math.atan(abs(t))
        xs = np.linspace(abs(t), abs(t) + 400, 2_000_001)
        c = math.gamma((nu + 1) / 2) / (math.sqrt(nu * math.pi) * math.gamma(nu / 2))
        dens = c * (1 + xs * xs / nu) ** (-(nu + 1) / 2)
        return 2 * np.trapezoid(dens, xs)

    cases = [(2.228, 10), (1.5, 3), (0.7, 4), (3.1, 7), (4.303, 2), (1.0, 1), (2.0, 28)]
    df = spark.createDataFrame(cases, "t double, nu int")
    got = df.select(t_two_sided_p(F.col("t"), F.col("nu")).alias("p")).collect()
    for (t, nu), r in zip(cases, got):
        assert r["p"] == pytest.approx(p_numeric(t, nu), abs=2e-5)


def test_t_p_value_equals_finite_series(spark):
    """Any degrees of freedom, the far tails, t = 0 and values that are no numbers."""
    def series(t, nu):
        theta = math.atan2(abs(t), math.sqrt(nu))
        term = total = 1.0
        for k in range(1, (nu - 2 - nu % 2) // 2 + 1):
            term *= ((2 * k - 1) / (2 * k) if nu % 2 == 0 else 2 * k / (2 * k + 1)) * math.cos(theta) ** 2
            total += term
        if nu % 2 == 0:
            return 1 - math.sin(theta) * total
        return 1 - 2 / math.pi * (theta + (math.sin(theta) * math.cos(theta) * total if nu > 1 else 0))

    cases = [(t, nu) for nu in (1, 2, 3, 4, 9, 78, 79, 1001, 20000)
             for t in (0.0, 1e-9, 0.01, 0.7, -1.0, 1.96, 4.0, -25.0, 1e6)]
    odd = [(float("nan"), 5), (None, 5), (float("inf"), 5)]
    df = spark.createDataFrame(cases + odd, "t double, nu int")
    got = [r.p for r in df.select(t_two_sided_p(F.col("t"), F.col("nu")).alias("p")).collect()]
    assert got[-3:] == [None, None, 0.0]
    for (t, nu), p in zip(cases, got):
        assert p == pytest.approx(series(t, nu), abs=1e-9), (t, nu)
        assert 0 <= p <= 1 + 1e-12


def test_map_columns_aliases(spark):
    df = spark.createDataFrame([("x1", None, "2022-01-02", 3, 9.5, "extra")],
                               "txn_id string, id string, date string, quantity int, price double, note string")
    out = ingest.map_columns(df)
    assert out.columns == ["Transaction_ID", "Date", "Units_Sold", "Unit_Price", "note"]
    assert out.first()["Transaction_ID"] == "x1"


def test_conform_defaults_and_price_lookup(spark):
    df = spark.createDataFrame([("2022-01-05", "Fan", "Engine", 2), ("not a date", "Box", "Toys", 1)],
                               "date string, product string, category string, quantity int")
    rows = ingest.conform(df).orderBy("Product_Name").collect()
    box, fan = rows
    assert fan["Unit_Price"] == 12000.0 and fan["Revenue"] == 24000.0
    assert box["Unit_Price"] == pytest.approx(38000.0 / 6)
    assert box["Date"] is None and fan["Date"] == dt.date(2022, 1, 5)
    assert fan["Quarter"] == "Q1" and fan["Month_Name"] == "Jan"
    assert sorted(r["Transaction_ID"] for r in rows) == ["TXN-00001", "TXN-00002"]
    assert fan["Region"] == "Other" and fan["Customer"] == "Unknown Customer"


def test_conform_nan_price_is_null(spark):
    df = spark.createDataFrame([("2022-01-05", float("nan"), 1)], "date string, price double, units int")
    assert ingest.conform(df).first()["Unit_Price"] is None


def test_validate_batch_rules(spark):
    s = fact(spark, [("T1", "2022-01-01", "P", "E", "R", "C", 1, 10.0),
                     ("T1", "2022-01-01", "P", "E", "R", "C", 0, 10.0)])
    s = s.withColumn("Revenue", F.when(F.col("Units_Sold") == 0, F.lit(0.0)).otherwise(F.col("Revenue") + 5))
    rep = {r["rule"]: r["violations"] for r in ingest.validate_batch(s).collect()}
    assert rep == {"required_columns": 0, "revenue_positive": 1, "units_at_least_one": 1,
                   "unique_transaction_id": 1, "revenue_matches": 1}
    missing = ingest.validate_batch(s.drop("Region", "Year"))
    assert missing.first()["violations"] == 2 and not ingest.batch_passed(missing)


def test_top_products_rank_and_sort(spark):
    s = fact(spark, [(f"T{i}", "2022-01-01", f"P{i % 4}", "E", "R", "C", 1, 10.0 * (i % 4 + 1)) for i in range(12)])
    s = abc.with_abc_class(s)
    top = bi.products_top(s, 3).collect()
    assert [r["rank"] for r in top] == [1, 2, 3]
    assert [r["name"] for r in top] == ["P3", "P2", "P1"]
    srt = bi.sort_table(bi.products_all(s), "units", ascending=True, tie_break="name").collect()
    assert [r["name"] for r in srt] == ["P0", "P1", "P2", "P3"]


def test_rfm_base_sorts_no_sales_rows(spark):
    """The region first seen: a missing date comes first, then the transaction id decides, a missing one first."""
    rows = [("T2", "2022-01-01", "N", "C1"), ("T1", "2022-01-01", "S", "C1"), ("T0", "2022-01-02", "W", "C1"),
            ("T5", None, "W", "C2"), ("T4", "2022-01-01", "N", "C2"), ("T6", "2022-03-01", None, "C3"),
            ("T7", "2022-03-02", "N", "C3"), (None, "2022-01-05", "S", "C4"), ("T1", "2022-01-05", "N", "C4"),
            ("T9", "2022-02-01", "N", "C5"), ("T8", "2022-02-01", "N", "C5"), ("T3", "2022-02-02", "N", "C5"),
            ("T1", "2022-02-02", "N", None), ("T1", "2022-02-02", "N", "C6"), ("T2", "2022-02-02", "S", "C6")]
    s = spark.createDataFrame([(t, d and dt.date.fromisoformat(d), r, c, 1.25) for t, d, r, c in rows],
                              "Transaction_ID string, Date date, Region string, Customer string, Revenue double")
    got = {r.Customer: tuple(r)[1:] for r in customers.rfm_base(s, "2022-04-01").collect()}
    assert got == {"C1": ("S", 89, 3, 3.75), "C2": ("W", 90, 2, 2.5), "C3": (None, 30, 2, 2.5),
                   "C4": ("S", 86, 1, 2.5), "C5": ("N", 58, 3, 3.75), "C6": ("N", 58, 2, 2.5)}
    one = customers.rfm_base(s.filter("Customer IN ('C5')"), "2022-04-01")
    assert "Transaction_ID" not in " ".join(
        x for x in one._jdf.queryExecution().executedPlan().toString().splitlines() if "SortAggregate" in x)
