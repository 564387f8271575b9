
import pytest
from pyspark.sql import functions as F

from tarmac.operators import abc, bi, customers, elasticity, forecast
from tarmac.sources import sinks

SNAP = "2001-08-02"


@pytest.fixture(scope="module")
def fact(sales):
    return abc.with_abc_class(sales).persist()


def test_filters_and_counts(sales):
    vals = {}
    for r in bi.filter_values(sales).collect():
        vals.setdefault(r["field"], []).append(r["value"])
    assert len(vals["years"]) == 7 and len(vals["categories"]) == 6 and len(vals["regions"]) == 5
    assert bi.row_count(sales).first()["rows"] == sales.count()


def test_kpis_all_fields_and_filter_smaller(sales):
    full = bi.kpis(sales, current_year=2000, base_year=1999).first().asDict()
    part = bi.kpis(sales, year=2000, current_year=2000, base_year=1999).first().asDict()
    assert set(full) == {"total_revenue", "total_units", "total_transactions", "avg_order_value",
                         "unique_customers", "yoy_growth"}
    assert part["total_revenue"] < full["total_revenue"]
    assert full["unique_customers"] == sales.select("Customer").distinct().count()


def test_shares_sum_to_100(sales):
    cats = bi.revenue_share(sales, "Category").collect()
    assert sum(r["pct"] for r in cats) == pytest.approx(100, abs=0.5)
    regions = {r["name"] for r in bi.revenue_share(sales, "Region").collect()}
    assert regions == {"AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"}


def test_products(fact):
    top = bi.products_top(fact, 10).collect()
    assert len(top) == 10 and top[0]["rank"] == 1
    allp = bi.products_all(fact).collect()
    assert len(allp) == fact.select("Product_Name").distinct().count()
    assert {r["abc"] for r in allp} <= {"A", "B", "C"}


def test_abc_monotone_and_class_a_dominant(sales):
    rows = abc.abc_products(sales).collect()
    cum = [r["cumulative_pct"] for r in rows]
    assert cum == sorted(cum) and cum[-1] == 100.0
    summary = {r["abc"]: r["revenue_pct"] for r in abc.abc_summary(sales).collect()}
    assert summary["A"] >= 60


def test_rfm(sales):
    r = customers.rfm(sales, SNAP).collect()
    assert len(r) == len({x["customer"] for x in r}) == sales.select("Customer").distinct().count()
    assert {x["segment"] for x in r} <= {"Champions", "Loyal Customers", "Potential Loyalists", "At Risk", "Lost"}
    assert all(x["recency"] > 0 and x["frequency"] >= 1 for x in r)


def test_cohort_month_zero_is_full(sales):
    ret = customers.cohort_retention(sales).collect()
    assert all(r["retention"] == 100.0 for r in ret if r["age"] == 0)
    assert len({r["cohort"] for r in ret}) == 26


def test_forecast_periods(sales):
    assert forecast.history(sales).count() == 80
    assert forecast.forecast(sales, 12).count() == 12
    assert forecast.forecast(sales, 3).count() == 3


def test_elasticity_fields(sales):
    rows = elasticity.elasticity(sales).collect()
    assert len(rows) == 6
    for r in rows:
        assert r["elasticity"] != 0 and r["insight"] and 0 <= r["r_squared"] <= 1


def test_export_unknown_rejected(sales):
    with pytest.raises(ValueError):
        sinks.export_sheet("unknown", sales)


def test_matrix_and_customers(sales):
    m = bi.region_category_matrix(sales)
    assert m.count() == 5 and len(m.columns) == 1 + 6
    c = bi.customers_table(sales).collect()
    revs = [r["revenue"] for r in c]
    assert revs == sorted(revs, reverse=True)
    asia = bi.customers_table(sales, region="ASIA").collect()
    assert asia and all(r["region"] == "ASIA" for r in asia)
    assert len(asia) == sales.filter(F.col("Region") == "ASIA").select("Customer").distinct().count()
