"""Every registered query without oracle SQL runs on sf0.001 and returns rows
(the driver's rows-only check), with invariants where the result allows."""

import pytest

from tarmac.plans import ORACLE, QUERIES, load_all

from paths import SF_SMALL

load_all()
ROWS_ONLY = sorted(set(QUERIES) - set(ORACLE))


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only_query_runs(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    rows = df.collect()
    assert df.columns and len(set(df.columns)) == len(df.columns)
    if name in ("churn", "churn_attribution", "recommend", "anomaly", "forecast", "forecast_combined",
                "churn_histogram", "churn_importance", "elasticity_pvalue", "cohort_matrix", "star_schema"):
        assert len(rows) > 0
    if name == "elasticity_pvalue":
        assert all(0.0 <= r["p_value"] <= 1.0 for r in rows)
    if name == "churn_histogram":
        assert sum(r["count"] for r in rows) == 150
