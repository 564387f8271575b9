"""Model-based operators against brute force on small fixtures."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest

from tarmac.operators import anomaly, churn, forecast


def _tree(rng, depth=3, n_feat=3):
    """A random full binary regression tree in the node-array layout of ``churn``."""
    n = 2 ** (depth + 1) - 1
    t = {"feat": np.full(n, -1), "thr": np.zeros(n), "left": np.full(n, -1), "right": np.full(n, -1),
         "pred": rng.normal(size=n), "count": np.zeros(n)}
    for i in range(2 ** depth - 1):
        t["feat"][i] = rng.integers(n_feat)
        t["thr"][i] = rng.normal()
        t["left"][i], t["right"][i] = 2 * i + 1, 2 * i + 2
    for i in range(n - 1, -1, -1):  # leaf counts random, internal = sum of children
        t["count"][i] = rng.integers(1, 20) if t["left"][i] < 0 else t["count"][t["left"][i]] + t["count"][t["right"][i]]
    return t


def _value(t, x, s, node=0):
    """E[tree | x_S] for one row, plain recursion."""
    if t["left"][node] < 0:
        return t["pred"][node]
    f = t["feat"][node]
    lt, rt = t["left"][node], t["right"][node]
    if f in s:
        return _value(t, x, s, lt if x[f] <= t["thr"][node] else rt)
    cl, cr = t["count"][lt], t["count"][rt]
    return (cl * _value(t, x, s, lt) + cr * _value(t, x, s, rt)) / (cl + cr)


def test_shapley_equals_permutation_definition():
    rng = np.random.default_rng(11)
    trees = [_tree(rng) for _ in range(4)]
    weights = np.array([1.0, 0.3, 0.3, 0.3])
    x = rng.normal(size=(6, 3))
    base, phi = churn.shapley(x, trees, weights)
    for r in range(len(x)):
        f = lambda s: sum(w * _value(t, x[r], set(s)) for w, t in zip(weights, trees))
        want = np.zeros(3)
        for perm in itertools.permutations(range(3)):
            seen = []
            for j in perm:
                want[j] += f(seen + [j]) - f(seen)
                seen.append(j)
        want /= math.factorial(3)
        assert phi[r] == pytest.approx(want, abs=1e-12)
        assert base + phi[r].sum() == pytest.approx(f([0, 1, 2]), abs=1e-12)


def _bushy(rng, features, depth):
    """A tree with repeated features on a path; some children hold no training row."""
    t = {k: [] for k in ["feat", "thr", "left", "right", "pred", "count"]}

    def grow(level, count):
        i = len(t["feat"])
        for k, v in [("feat", -1), ("thr", 0.0), ("left", -1), ("right", -1), ("pred", rng.normal()), ("count", count)]:
            t[k].append(v)
        if level < depth and rng.random() < 0.9:
            part = rng.choice([0.0, 0.25, 0.5, 1.0]) * count
            t["feat"][i], t["thr"][i] = int(rng.integers(features)), rng.normal()
            t["left"][i] = grow(level + 1, part)
            t["right"][i] = grow(level + 1, count - part)
        return i
    grow(0, 64.0)
    return {k: np.array(v) for k, v in t.items()}


def _plain(t, x, s, i=0):
    if t["feat"][i] < 0:
        return t["pred"][i]
    a, b, f = t["left"][i], t["right"][i], t["feat"][i]
    if f in s:
        return _plain(t, x, s, a if x[f] <= t["thr"][i] else b)
    ca, cb = t["count"][a], t["count"][b]
    wa = ca / (ca + cb) if ca + cb > 0 else 0.5
    return wa * _plain(t, x, s, a) + (1 - wa) * _plain(t, x, s, b)


@pytest.mark.parametrize("features, depth", [(1, 3), (3, 6), (12, 7)])
def test_shapley_of_deep_trees_equals_all_coalitions(features, depth):
    rng = np.random.default_rng(features)
    trees = [_bushy(rng, features, depth) for _ in range(3)]
    weights = np.array([1.0, 0.3, 0.3])
    x = rng.normal(size=(2, features))
    base, phi = churn.shapley(x, trees, weights)
    for r in range(len(x)):
        f = {s: sum(w * _plain(t, x[r], s) for w, t in zip(weights, trees))
             for k in range(features + 1) for s in map(frozenset, itertools.combinations(range(features), k))}
        want = np.zeros(features)
        for s, v in f.items():
            for i in set(range(features)) - s:
                share = math.factorial(len(s)) * math.factorial(features - len(s) - 1) / math.factorial(features)
                want[i] += share * (f[s | {i}] - v)
        assert phi[r] == pytest.approx(want, abs=1e-9)
        assert base == pytest.approx(f[frozenset()], abs=1e-9)


def test_path_lengths_equal_plain_walk():
    rng = np.random.default_rng(5)
    x_train = rng.normal(size=(64, 2))
    fe, th, le, ri, si = anomaly._grow(x_train, rng, 6)
    tree = {k: np.array(v) for k, v in zip(["feature", "threshold", "left", "right", "size"], [fe, th, le, ri, si])}
    x = rng.normal(size=(40, 2)) * 2
    got = anomaly._path_lengths(x, tree)
    for i, row in enumerate(x):
        node, depth = 0, 0
        while tree["feature"][node] >= 0:
            node = tree["left"][node] if row[tree["feature"][node]] < tree["threshold"][node] else tree["right"][node]
            depth += 1
        want = depth + anomaly.avg_path_length([tree["size"][node]])[0]
        assert got[i] == pytest.approx(want)


def test_avg_path_length_small_values():
    assert anomaly.avg_path_length([0, 1, 2]).tolist() == [0.0, 0.0, 1.0]
    n = 256
    harmonic = sum(1.0 / i for i in range(1, n))
    # c(n) = 2 H(n-1) - 2 (n-1)/n, with H approximated by ln + Euler's constant
    assert anomaly.avg_path_length([n])[0] == pytest.approx(2 * harmonic - 2 * (n - 1) / n, rel=2e-3)


def test_forecast_extends_a_straight_line():
    ds = pd.date_range("2015-01-01", periods=60, freq="MS").to_numpy().astype("datetime64[D]")
    days = (ds - ds[0]).astype(float)
    y = 1000.0 + 2.0 * days
    res = forecast.fit_series(ds, y, periods=6, samples=200)
    fut_days = (res["ds"] - ds[0]).astype(float)
    assert res["yhat"] == pytest.approx(1000.0 + 2.0 * fut_days, rel=0.01)
    assert np.all(res["lower"] <= res["yhat"] + 1e-6) and np.all(res["yhat"] <= res["upper"] + 1e-6)
