"""Centroid clustering of integer vectors with Orchard's nearest-neighbour search.

``quantised`` keeps the vectors with exactly ``dims`` finite components and turns a component x into floor(scale * x).
``initial`` takes the vectors whose sha256 of ``<seed>:<vec_id>`` is smallest. A round assigns every vector to its
nearest centroid and replaces each centroid that has vectors by their componentwise floor(sum / count).

Orchard search (``nearest``): each centroid lists the others by rising distance. A vector starts at some centroid and
walks that one's list; a centroid that is closer (or as close with a smaller number) takes over with its own list;
centroids once measured are marked and not measured again. By the triangle inequality a centroid further than twice
the current distance from the current one cannot be as close, so the walk stops strictly beyond that. All vectors of
a batch walk at once in numpy, in exact integers.

Scale: the integers are stored once and read by every round; a round sends k * dims partial sums a task, added by
Spark, and only k centroids pass the driver (bounded by the parameters, not by the data). Vectors are never shuffled,
so a vector that a third of the rows hold makes no hot key. A lost executor repeats its tasks of one round.

Cases: null or short vectors, null or non-finite components: the row is left out. Null vec_ids are rows like any
other, last in the choice of first centroids; of equal ids the lesser vector comes first; with fewer than k vectors
there are as many centroids; an empty table gives an empty result. Components stop at +-2**62 and distances and
inertias at 2**63 - 1, the limits of a long. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import stored

DIMS, SCALE, K, ROUNDS, SEED = 64, 1024.0, 8, 10, 3
LIMIT = 2 ** 62
LONGEST = 2 ** 63 - 1
SAFE = 2 ** 27  # components up to this keep squared distances of 64 components below 2**63


def quantised(vectors: DataFrame, dims: int = DIMS, scale: float = SCALE, column: str = "embedding") -> DataFrame:
    """(vec_id, v): the kept vectors as arrays of ``dims`` longs."""
    xs = F.col(column).cast("array<double>")
    finite = F.forall(xs, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(xs, lambda x: F.floor(F.least(F.greatest(x * scale, F.lit(-float(LIMIT))),
                                                      F.lit(float(LIMIT)))))
    kept = vectors.filter((F.size(xs) == dims) & finite)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def initial(points: DataFrame, k: int = K, seed: int = SEED) -> list[list[int]]:
    """The ``k`` vectors of the smallest sha256 of ``<seed>:<vec_id>``, in that order."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = points.select(name.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return [[int(x) for x in r.v] for r in rows]


class Index:
    """Centroids with their neighbour lists; ``nearest`` is exact, ties go to the smaller number."""

    def __init__(self, centroids: list[list[int]]):
        big = max((abs(x) for c in centroids for x in c), default=0) > SAFE
        self.exact = np.array(centroids, object).reshape(len(centroids), -1)
        self.small = None if big else self.exact.astype(np.int64)
        cents = self.exact if big else self.small
        k = len(centroids)
        self.between = np.empty((k, k), cents.dtype)
        for i in range(k):
            gap = cents - cents[i]
            self.between[i] = (gap * gap).sum(axis=1)
        lists = [np.argsort(row, kind="stable") for row in self.between]
        self.order = np.array([r[r != i] for i, r in enumerate(lists)], np.int64).reshape(k, max(k - 1, 0))

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, squared distance) of each row of ``points`` (int64)."""
        small = self.small is not None and (points.size == 0 or -SAFE <= points.min() and points.max() <= SAFE)
        cents = self.small if small else self.exact
        between = self.between
        rows = points if small else points.astype(object)
        n, k = len(rows), len(cents)

        def measure(which, to):
            gap = rows[which] - cents[to]
            return (gap * gap).sum(axis=1)

        # The walk may start anywhere; near the vector it is short. The component that tells centroids best serves.
        spread = np.asarray(cents, np.float64)
        axis = int(np.argmax(spread.max(axis=0) - spread.min(axis=0)))
        by_axis = np.argsort(spread[:, axis], kind="stable")
        middles = (spread[by_axis, axis][1:] + spread[by_axis, axis][:-1]) / 2
        now = by_axis[np.searchsorted(middles, points[:, axis].astype(np.float64))]
        best = measure(np.arange(n), now)
        seen = np.zeros((n, k), bool)
        seen[np.arange(n), now] = True
        place = np.zeros(n, np.int64)
        walking = np.arange(n) if k > 1 else np.arange(0)
        while len(walking):
            here = now[walking]
            there = self.order[here, place[walking]]
            in_reach = (between[here, there] <= 4 * best[walking]).astype(bool)
            walking, there = walking[in_reach], there[in_reach]  # the others stop: strictly beyond twice the distance
            new = ~seen[walking, there]
            who, to = walking[new], there[new]
            seen[who, to] = True
            far = measure(who, to)
            closer = ((far < best[who]) | ((far == best[who]) & (to < now[who]))).astype(bool)
            place[walking] += 1
            jump = who[closer]
            now[jump], best[jump], place[jump] = to[closer], far[closer], 0
            walking = walking[place[walking] < k - 1]
        return now, best


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), dims)


def _exact_sums(points: np.ndarray) -> list[int]:
    if points.size and max(abs(int(points.min())), abs(int(points.max()))) > SAFE:
        return [int(x) for x in points.astype(object).sum(axis=0)]
    return [int(x) for x in points.sum(axis=0)]


def totals(points: DataFrame, centroids: list[list[int]]) -> dict[int, tuple[int, int, list[int]]]:
    """cluster: (vectors, summed distance, summed components) under ``centroids``; exact."""
    dims = len(centroids[0])

    def run(batches):
        index, held = Index(centroids), {}
        for b in batches:
            rows = _matrix(b.column(0), dims)
            near, far = index.nearest(rows)
            for c in np.unique(near):
                of = near == c
                n, d, s = held.get(int(c), (0, 0, [0] * dims))
                held[int(c)] = (n + int(of.sum()), d + sum(far[of].tolist()),
                                [x + y for x, y in zip(s, _exact_sums(rows[of]))])
        for c, (n, d, s) in held.items():
            # Distances may pass what a decimal holds only if single ones pass a long: those are cut on output.
            vals = [n, min(d, 10 ** 37), *s]
            yield pa.RecordBatch.from_arrays(
                [pa.array([c] * len(vals), pa.int32()), pa.array(range(len(vals)), pa.int32()),
                 pa.array([pa.scalar(x, pa.decimal128(38, 0)).as_py() for x in vals], pa.decimal128(38, 0))],
                names=["c", "pos", "x"])

    sums = (points.select("v").mapInArrow(run, "c int, pos int, x decimal(38,0)")
            .groupBy("c", "pos").agg(F.sum("x").alias("x")).collect())
    out: dict[int, list[int]] = {}
    for r in sums:
        out.setdefault(r.c, [0] * (dims + 2))[r.pos] = int(r.x)
    return {c: (v[0], v[1], v[2:]) for c, v in out.items()}


def fit(points: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> list[list[int]]:
    """Centroids after ``rounds`` rounds; ``points`` (vec_id, v) is read by each and should be stored."""
    centroids = initial(points, k, seed)
    for _ in range(rounds if centroids else 0):
        found = totals(points, centroids)
        centroids = [[s // found[c][0] for s in found[c][2]] if c in found else old
                     for c, old in enumerate(centroids)]
    return centroids


def assign(points: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(vec_id, cluster, distance) of each vector."""
    schema = "vec_id long, cluster int, distance long"
    if not centroids:
        return points.sparkSession.createDataFrame([], schema)
    dims = len(centroids[0])

    def run(batches):
        index = Index(centroids)
        for b in batches:
            near, far = index.nearest(_matrix(b.column(1), dims))
            if far.dtype == object:
                far = np.array([min(int(x), LONGEST) for x in far], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(near.astype(np.int32)), pa.array(far)],
                                             names=["vec_id", "cluster", "distance"])

    return points.select("vec_id", "v").mapInArrow(run, schema)


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS,
            scale: float = SCALE) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each kept vector."""
    points = stored(quantised(vectors, dims, scale), "vectors")
    centroids = fit(points, k, rounds, seed)
    found = totals(points, centroids) if centroids else {}
    whole = min(sum(d for _, d, _ in found.values()), LONGEST)
    about = [(c, min(d, LONGEST), whole, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
             for c, (_, d, _) in found.items()]
    about = points.sparkSession.createDataFrame(
        about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assign(points, centroids).join(F.broadcast(about), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
