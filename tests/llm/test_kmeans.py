"""Orchard search and the clustering against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from samples import SF
from tarmac.llm import kmeans as K

VECTORS = "vec_id long, embedding array<float>, label int"


def plain(rows, k=8, rounds=10, seed=3, dims=64, scale=1024.0):
    """rows: (vec_id, vector); the contract word for word."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in named[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(cents))

    for _ in range(rounds):
        of = {}
        for _, v in kept:
            of.setdefault(nearest(v)[1], []).append(v)
        cents = [[sum(col) // len(of[i]) for col in zip(*of[i])] if i in of else c for i, c in enumerate(cents)]
    last = [(i, *nearest(v)) for i, v in kept]
    inertia = {}
    for _, d, c in last:
        inertia[c] = inertia.get(c, 0) + d
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(map(str, ((i, c, d, inertia[c], sum(inertia.values()), shas[c]) for i, d, c in last)))


def got(df, **options):
    return sorted(map(str, (tuple(r) for r in K.cluster(df, **options).collect())))


def test_given_vectors(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert got(df) == plain([(r.vec_id, r.embedding) for r in df.collect()])


@pytest.mark.parametrize("k,spread", [(2, 3), (7, 2), (40, 6), (40, 400)])
def test_search_is_exact_with_ties(k, spread):
    rnd = np.random.default_rng(k * spread)
    cents = rnd.integers(-spread, spread + 1, (k, 4)).tolist()  # many equal distances and equal centroids
    rows = rnd.integers(-2 * spread, 2 * spread + 1, (500, 4))
    near, far = K.Index(cents).nearest(rows)
    for v, c, d in zip(rows.tolist(), near, far):
        assert (d, c) == min((sum((a - b) ** 2 for a, b in zip(v, x)), i) for i, x in enumerate(cents))


def test_search_beyond_longs():
    cents = [[2 ** 61, 0], [-2 ** 61, 5], [7, 7]]
    rows = np.array([[2 ** 62, -2 ** 62], [-2 ** 62, 3], [1, 2]], np.int64)
    near, far = K.Index(cents).nearest(rows)
    for v, c, d in zip(rows.tolist(), near, far):
        assert (d, c) == min((sum((a - b) ** 2 for a, b in zip(v, x)), i) for i, x in enumerate(cents))


def odd_rows():
    rnd = random.Random(2)
    v = [[rnd.choice([-1.0, 0.0, 0.5, 0.25]) for _ in range(64)] for _ in range(30)]
    rows = [(i, x) for i, x in enumerate(v)] + [(5, v[5]), (5, v[6]), (None, v[7]), (None, None), (40, v[0])]
    rows += [(i, v[0]) for i in range(100, 160)]  # a hot vector
    rows += [(200, []), (201, v[0][:63]), (202, [None] + v[0][1:]), (203, [math.nan] + v[0][1:]),
             (204, [math.inf] + v[0][1:]), (205, [-math.inf] + v[0][1:]), (206, v[0] + [0.0])]
    return rows


def test_odd_rows_clashing_names_and_empty(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS)
    want = plain(rows)
    assert got(df) == want
    assert got(df.withColumns({"cluster": F.lit("x"), "distance": F.lit(1), "v": F.lit(2), "inertia": F.lit(3)})) == want
    assert got(df.limit(0)) == []
    few = rows[:3]
    assert got(spark.createDataFrame([(i, v, 1) for i, v in few], VECTORS)) == plain(few)


def test_huge_components(spark):
    """Beyond 64-bit squares: results are exact, distances stop at the greatest long."""
    rows = [(i, [float(s) * 2.0 ** 44] + [0.0] * 63) for i, s in enumerate((1, -1, 1, 0, 3, -2, 2, 5, 8))]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")
    out = {r.vec_id: r for r in K.cluster(df, k=2, rounds=3).collect()}
    assert len(out) == len(rows) and all(0 <= r.distance <= K.LONGEST for r in out.values())
    assert {r.cluster for r in out.values()} <= {0, 1}
