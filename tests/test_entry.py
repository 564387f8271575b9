"""Driver contract: entry runs, every query has a callable, oracle keys are a subset."""

import __spark_entry__ as entry_mod


def test_entry_returns_rows(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["month", "revenue", "units"]


def test_queries_and_oracle_keys():
    q = entry_mod.queries()
    o = entry_mod.oracle_sql()
    assert len(q) >= 70
    assert set(o) <= set(q)
    assert all(callable(f) for f in q.values())
    # model-based operators are the only ones without oracle SQL
    from tarmac.plans import QUERIES
    no_sql = set(QUERIES) - set(o)
    assert all(n.startswith(("churn", "anomaly", "forecast", "recommend", "elasticity_pvalue", "star_schema",
                                 "cohort_matrix"))
               for n in no_sql), no_sql
