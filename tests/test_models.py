"""Invariants of the model-based operators (the reference's own test strategy)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarmac.operators import anomaly, churn, customers, forecast, recommend

SNAP = "2001-08-02"


@pytest.fixture(scope="module")
def churn_result(spark, sales):
    rfm_table = customers.rfm_scores(customers.rfm_base(sales, SNAP))
    return churn.train_churn(rfm_table, max_iter=10)


def test_churn_probabilities_and_risk(churn_result):
    tab = churn.churn_table(churn_result["scores"]).collect()
    assert len(tab) == 150
    for r in tab:
        assert 0.0 <= r["churn_prob"] <= 1.0
        want = "High" if r["churn_prob"] >= 0.65 else None
        if want:
            assert r["risk"] == "High"
    counts = churn.risk_counts(churn.churn_table(churn_result["scores"])).first()
    assert counts["high_risk_count"] + counts["medium_risk_count"] <= len(tab)


def test_churn_importance_sums_to_one(churn_result):
    imp = churn.importance_table(churn_result["importance"]).collect()
    assert {r["feature"] for r in imp} == {"Recency", "Frequency", "Monetary"}
    assert sum(r["importance"] for r in imp) == pytest.approx(1.0, abs=0.01)


def test_attribution_is_additive(churn_result):
    sc = churn_result["scores"].select("Customer", "churn_prob").toPandas()
    at = churn_result["attribution"].toPandas().merge(sc, on="Customer")
    p = at["churn_prob"].clip(1e-15, 1 - 1e-15)
    logit = np.log(p / (1 - p))
    total = at["base_value"] + at["shap_recency"] + at["shap_frequency"] + at["shap_monetary"]
    assert np.max(np.abs(logit - total)) < 1e-6
    one = churn.attribution_table(churn_result["attribution"], at["Customer"].iloc[0]).collect()
    assert len(one) == 1
    assert churn.attribution_table(churn_result["attribution"], "nobody").count() == 0


def test_attribution_is_worked_out_once_for_all_readers(spark, churn_result):
    """Each reader ran the attribution anew, over its own partitions, once Spark's cache had let go of it."""
    plan = churn_result["attribution"]._jdf.queryExecution().analyzed().toString()
    assert "MapInPandas" not in plan


def test_equal_places_between_thresholds_are_attributed_once(spark, monkeypatch):
    leaf = {"left": -1, "right": -1, "feat": -1, "thr": 0.0}
    tree = [{**leaf, "pred": 0.0, "count": 8.0, "left": 1, "right": 2, "feat": 0, "thr": 0.5},
            {**leaf, "pred": -1.0, "count": 5.0},
            {**leaf, "pred": 0.0, "count": 3.0, "left": 3, "right": 4, "feat": 2, "thr": -1.0},
            {**leaf, "pred": 0.25, "count": 1.0}, {**leaf, "pred": 2.0, "count": 2.0}]
    trees = [{k: np.array([n[k] for n in tree]) for k in tree[0]}]
    weights = np.array([0.5])
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(200, 3)), [[0.5, 0.0, -1.0], [0.5, 1.0, 3.0], [0.6, 0.0, -1.0]]])
    rows = spark.createDataFrame([(f"c{i % 150}", v.tolist()) for i, v in enumerate(x)], "Customer string, _x array<double>")
    asked = spark.sparkContext.accumulator(0)
    whole = churn.shapley

    def counted(x, *args):
        asked.add(len(x))
        return whole(x, *args)

    monkeypatch.setattr(churn, "shapley", counted)
    got = churn.attribute(rows, trees, weights).collect()
    base, phi = whole(x, trees, weights)

    def keys(found):
        return sorted((c, *np.round(v, 9)) for c, *v in found)
    assert keys(got) == keys((f"c{i % 150}", 2 * base, *(2 * p)) for i, p in enumerate(phi))
    assert 0 < asked.value <= 4


def test_churn_fit_has_partitions_by_rows(spark, sales, monkeypatch):
    """The many partitions of the customer aggregate are not those of the fit, in which each costs tasks in every job."""
    seen = []

    class Spy(churn.Pipeline):
        def fit(self, frame):
            seen.append(frame.rdd.getNumPartitions())
            return super().fit(frame)

    monkeypatch.setattr(churn, "Pipeline", Spy)
    table = customers.rfm_scores(customers.rfm_base(sales, SNAP)).repartition(64)
    result = churn.train_churn(table, max_iter=2)
    assert seen == [1]
    assert churn.churn_check(result).first().asDict() == {
        "customers": 150, "bad_probability": 0, "bad_count": 0, "bad_sum": 0}
    assert [churn.fit_partitions(n, 12) for n in (0, 25_001, 900_000, 54_000_000)] == [1, 2, 12, 108]


def test_churn_histogram_has_ten_bins(churn_result):
    h = churn.probability_histogram(churn.churn_table(churn_result["scores"])).collect()
    assert [r["bin"] for r in h] == list(range(10))
    assert sum(r["count"] for r in h) == 150


def test_anomaly_share(sales):
    res = anomaly.monthly_anomalies(sales).collect()
    assert len(res) == 80
    share = sum(r["is_anomaly"] for r in res) / len(res)
    assert 0.05 <= share <= 0.20
    flagged = [r["anomaly_score"] for r in res if r["is_anomaly"]]
    normal = [r["anomaly_score"] for r in res if not r["is_anomaly"]]
    assert min(flagged) >= max(normal)


def test_isolation_forest_finds_outlier(spark):
    rows = [(f"k{i}", float(i % 7), float(i % 5)) for i in range(60)] + [("out", 500.0, 400.0)]
    df = spark.createDataFrame(rows, "key string, a double, b double")
    res = anomaly.isolation_forest(df, "key", ["a", "b"], n_trees=50, contamination=0.02).collect()
    top = max(res, key=lambda r: r["anomaly_score"])
    assert top["key"] == "out" and top["is_anomaly"]


def test_forecast_invariants(sales):
    fc = forecast.forecast(sales, 12).collect()
    assert len(fc) == 12
    for r in fc:
        assert r["predicted"] >= 0 and r["lower"] >= 0
        assert r["lower"] <= r["predicted"] + 1e-6 <= r["upper"] + 2e-6
    assert [r["month"] for r in fc] == [r["month"] for r in forecast.calendar(sales, 12).collect()]
    assert len(forecast.forecast(sales, 6).collect()) == 6
    assert forecast.history(sales).count() == 80


def test_forecast_per_category(sales):
    fc = forecast.forecast(sales, 3, by="Category")
    assert fc.select("series").distinct().count() == 6 and fc.count() == 18


def test_recommend_unseen_and_bounded(spark, sales):
    trained = recommend.train_recommender(sales, iterations=5)
    recs = recommend.recommend(trained, n=5)
    per = recs.groupBy("customer").count().agg(F.max("count")).first()[0]
    assert per <= 5
    bought = recommend.interactions(sales).select("customer", "product")
    assert recs.join(bought, ["customer", "product"]).count() == 0
    assert recommend.recommend_for(trained, "nobody").count() == 0


@pytest.mark.parametrize("block", [1000, 7])
def test_masked_top_n_equals_brute_force(spark, block):
    """Ties, a user who bought everything, one who bought nothing, several blocks of items."""
    rng = np.random.default_rng(block)
    u, v = rng.integers(-2, 3, (30, 3)).astype(float), rng.integers(-2, 3, (40, 3)).astype(float)
    bought = {(0, i) for i in range(40)} | {(a, b) for a in range(2, 30) for b in range(40) if rng.random() < 0.4}
    frame = lambda m: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "id int, features array<float>")
    held = spark.createDataFrame(sorted(bought), "user int, item int")
    got = recommend.masked_top_n(frame(u), frame(v), held, 4, block)
    blocks = -(-40 // block)
    assert got.count() <= 30 * 4 * blocks
    best = {}
    for r in got.collect():
        best.setdefault(r.user, []).append((-r.score, r.item))
    for a in range(30):
        want = sorted((-float(u[a] @ v[b]), b) for b in range(40) if (a, b) not in bought)[:4]
        assert sorted(best.get(a, []))[:4] == want
    assert 0 not in best
    assert recommend.masked_top_n(frame(u), frame(v).limit(0), held, 4).count() == 0
