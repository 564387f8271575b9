"""Plan checks: pushdown, pruning, no Python in the BI hot path."""

import pytest

from tarmac.operators import abc, bi, customers
from tarmac.sources.tables import sales_view

@pytest.fixture(scope="module")
def view(spark):
    # another scale than the cached session fixture, so the plans reach the scans
    return sales_view(spark, "/root/testdata/sf0.01")


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_category_filter_reaches_scan(view):
    text = plan_text(bi.trend_monthly(view, category="PROMO"))
    assert "PushedFilters: [IsNotNull(p_type), EqualTo(p_type,PROMO)" in text


def test_column_pruning(view):
    text = plan_text(bi.trend_monthly(view))
    assert "l_extendedprice" in text and "l_discount" not in text and "o_orderpriority" not in text


def test_bi_has_no_python(sales):
    for df in [bi.kpis(sales), bi.products_all(abc.with_abc_class(sales)), bi.customer_top_products(sales),
               customers.cohort_retention(sales)]:
        text = plan_text(df)
        assert "Python" not in text and "ArrowEval" not in text


def test_nation_region_broadcast(view):
    assert "BroadcastHashJoin" in plan_text(bi.revenue_share(view, "Region"))


PY_NODES = ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "PythonUDF")
MODEL_OR_STREAM = ("churn", "anomaly", "forecast", "recommend", "incremental_ingest", "ingest_quarantine")


def test_no_python_in_sql_checkable_queries(spark):
    """Every oracle-checked query except the model/stream ones plans without any Python operator."""
    from tarmac.plans import ORACLE, QUERIES, load_all
    load_all()
    for name in sorted(ORACLE):
        if name.startswith(MODEL_OR_STREAM):
            continue
        text = plan_text(QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert not any(p in text for p in PY_NODES), name
