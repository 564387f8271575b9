"""The recommender's fit from summed equations: equal to the library's, and what a task sends does not follow its users."""

import numpy as np
import pyarrow as pa
import pytest

from tarmac.operators import als


@pytest.fixture(scope="module")
def ratings(spark):
    """60 users: one rated everything, one only zero, one has a zero beside others, one a negative rating."""
    rng = np.random.default_rng(1)
    rows = {(u, i): float(rng.uniform(0.1, 9)) for u in range(60) for i in range(12) if rng.random() < 0.4}
    rows |= {(0, i): 1.0 + i for i in range(12)} | {(1, 3): 0.0, (2, 0): 0.0, (2, 1): 5.0, (3, 2): -2.0, (3, 4): 3.0}
    rows = {(u, i): r for (u, i), r in rows.items() if u != 1 or i == 3}
    return spark.createDataFrame([(u, i, r) for (u, i), r in rows.items()], "user int, item int, rating double")


def _matrix(factors):
    return np.array([r.features for r in factors.orderBy("id").collect()])


@pytest.mark.parametrize("at_once", [als.RATINGS_AT_ONCE, 10])
def test_summed_fit_equals_the_library(spark, ratings, monkeypatch, at_once):
    monkeypatch.setattr(als, "RATINGS_AT_ONCE", at_once)
    got = als.fit(ratings, 12, 4, 0.1, 5, 42)
    monkeypatch.setattr(als, "SUMMED_ITEMS", 0)
    want = als.fit(ratings, 12, 4, 0.1, 5, 42)
    assert np.allclose(_matrix(got.itemFactors), _matrix(want.itemFactors), atol=1e-4)
    assert np.allclose(_matrix(got.userFactors), _matrix(want.userFactors), atol=1e-4)
    assert got.userFactors.select("id").distinct().count() == 60


def test_a_null_rating_is_refused(spark, ratings):
    bad = ratings.unionByName(spark.createDataFrame([(7, 11, None)], ratings.schema))
    with pytest.raises(Exception, match="(?i)nan|null"):
        als.fit(bad, 12, 4, 0.1, 2, 42)


def _sent(n_users):
    """Bytes that a task over ``n_users`` users sends in an iteration."""
    rng = np.random.default_rng(n_users)
    lists = [sorted(rng.choice(30, 10, replace=False).tolist()) for _ in range(n_users)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(n_users), pa.int32()), pa.array(lists, pa.list_(pa.int32())),
                                        pa.array([[1.0] * 10] * n_users, pa.list_(pa.float32()))],
                                       names=["user", "items", "ratings"])
    return sum(b.nbytes for b in als._equations([batch], rng.random((30, 8)).astype(np.float32), 30, 8, 0.1))


def test_what_a_task_sends_follows_the_items_only():
    assert _sent(20) == _sent(2000)
    assert not list(als._equations([], None, 30, 8, 0.1))
