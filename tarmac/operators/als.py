"""Implicit-feedback ALS whose item side is solved from summed equations.

``pyspark.ml``'s ALS sends each user's factors to every block of items that the user rated, in each iteration: users x
blocks rows. Where the items are few (``SUMMED_ITEMS``), a task instead solves its users' factors from the broadcast
item factors and adds them into one system of equations per item; a task sends items x (rank^2 / 2 + 2 rank) numbers, and
each item's systems are summed and solved where they meet. Only the item factors, at most ``SUMMED_ITEMS`` rows, pass
through the driver. Beyond that many items ``pyspark.ml``'s own fit is used.

Both minimise the same function in the same steps, from the same start (that of an ALS without iterations), and keep
factors as 32-bit floats between half-steps; they differ in the order of sums only.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.operators.scale import broadcast_rows
from tarmac.session import stored

SUMMED_ITEMS = 4096  # items whose equations a task holds
RATINGS_AT_ONCE = 1 << 17  # ratings whose factors a task gathers at once


class Factors(NamedTuple):
    """(id, features) of users and of items."""

    userFactors: DataFrame
    itemFactors: DataFrame


def fit(ratings: DataFrame, n_items: int, rank: int, reg: float, iterations: int, seed: int) -> Factors:
    """Factors for ``ratings`` (user, item, rating); items are dense from 0, a pair comes once."""
    spark = ratings.sparkSession
    blocks = max(1, spark.sparkContext.defaultParallelism)  # as many as the cluster runs at once
    als = ALS(rank=rank, regParam=reg, maxIter=iterations, implicitPrefs=True, seed=seed,
              userCol="user", itemCol="item", ratingCol="rating", numUserBlocks=blocks, numItemBlocks=blocks,
              coldStartStrategy="drop")
    if iterations and n_items <= min(SUMMED_ITEMS, broadcast_rows(spark)):
        return _fit_summed(ratings, n_items, als)
    model = als.fit(ratings)
    return Factors(model.userFactors, model.itemFactors)


def _fit_summed(ratings: DataFrame, n_items: int, als: ALS) -> Factors:
    spark, rank, reg = ratings.sparkSession, als.getRank(), als.getRegParam()
    value = F.coalesce(F.col("rating").cast("float"), F.lit(float("nan")))  # as null: refused by the fit
    once = ratings.groupBy("user").agg(F.sum(value).alias("rating")).withColumn("item", F.lit(0))
    start = als.copy({als.maxIter: 0, als.numItemBlocks: 1}).fit(once).userFactors
    lists = ratings.groupBy("user").agg(F.collect_list("item").alias("items"), F.collect_list(value).alias("ratings"))
    rows = stored(lists.join(start.select(F.col("id").alias("user"), F.col("features").alias("start")), "user"), "als")
    found, size = None, n_items
    for _ in range(als.getMaxIter()):
        shared = None if found is None else spark.sparkContext.broadcast(found)

        def add(batches, shared=shared):
            yield from _equations(batches, None if shared is None else shared.value, size, rank, reg)

        def solve(key, table):
            return _solved(key, table, rank, reg)

        given = rows.select("items", "ratings", *([] if shared else ["start"]))
        solved = given.mapInArrow(add, "item int, sums binary").groupBy("item") \
            .applyInArrow(solve, "item int, features array<float>").toArrow().sort_by("item")
        found = np.array(solved.column("features").to_pylist(), np.float32).reshape(size, rank)
        if shared:
            shared.destroy()
    last = spark.sparkContext.broadcast(found)

    def users(batches):
        for b in batches:
            for part in _slices(b):
                x = _user_factors(part, last.value, reg)
                yield pa.RecordBatch.from_arrays([part.column("user"), _lists(x)], names=["id", "features"])

    items = spark.createDataFrame([(i, x) for i, x in enumerate(found.tolist())], "id int, features array<float>")
    asked = rows.select("user", "items", "ratings").mapInArrow(users, "id int, features array<float>")
    return Factors(stored(asked, "als-users"), items)


def _lists(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists."""
    ends = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.float32).ravel()))


def _slices(batch: pa.RecordBatch):
    """Parts of a batch with few ratings each (more only where one user has them)."""
    ends = np.cumsum(np.array(batch.column("items").value_lengths()))
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + RATINGS_AT_ONCE, "right")))
        yield batch.slice(at, to - at)
        at = to


def _flat(batch: pa.RecordBatch):
    """Per user the number of ratings; per rating the item, its confidence beyond 1 and its weighted preference."""
    sizes = np.array(batch.column("items").value_lengths())
    items = batch.column("items").flatten().to_numpy(zero_copy_only=False)
    rating = batch.column("ratings").flatten().to_numpy(zero_copy_only=False).astype(float)
    more = np.abs(rating)
    return sizes, items, more, np.where(rating > 0, 1 + more, 0.0)


def _solve(a: np.ndarray, b: np.ndarray, liked: np.ndarray, reg: float) -> np.ndarray:
    """Solutions of ridge systems; without any liked item (b = 0) the solution is 0, even of a singular one."""
    a = a + np.where(liked > 0, reg * liked, 1.0)[:, None, None] * np.eye(a.shape[1])
    return np.linalg.solve(a, b[:, :, None])[:, :, 0].astype(np.float32)


def _user_factors(batch: pa.RecordBatch, found: np.ndarray, reg: float) -> np.ndarray:
    """The factors of the batch's users, given those of all items."""
    sizes, items, more, wanted = _flat(batch)
    known = np.vstack([found, np.zeros((1, found.shape[1]))]).astype(float)  # the last row fills up short lists
    base = known.T @ known
    starts = np.cumsum(sizes) - sizes
    order, out, at = np.argsort(sizes, kind="stable"), np.empty((len(sizes), found.shape[1]), np.float32), 0
    while at < len(order):  # users with lists of about the same length
        to = at + 1
        while to < len(order) and to - at < 1024 and sizes[order[to]] <= sizes[order[at]] + 8:
            to += 1
        some = order[at:to]
        place = np.arange(sizes[some[-1]])
        real = place < sizes[some][:, None]
        place = np.where(real, starts[some][:, None] + place, 0)
        y = known[np.where(real, items[place], len(found))]
        c, w = np.where(real, more[place], 0.0), np.where(real, wanted[place], 0.0)
        out[some] = _solve(np.matmul((y * c[:, :, None]).transpose(0, 2, 1), y) + base,
                           np.matmul(w[:, None, :], y)[:, 0], (w > 0).sum(axis=1), reg)
        at = to
    return out


def _equations(batches, found: np.ndarray | None, n_items: int, rank: int, reg: float):
    """One system of equations per item over all users of the task: upper triangle, right side, number of likes."""
    a, b, liked = np.zeros((n_items, rank, rank)), np.zeros((n_items, rank)), np.zeros(n_items)
    base, seen = np.zeros((rank, rank)), False
    for batch in batches:
        for part in _slices(batch):
            seen = True
            if found is None:
                x = np.array(part.column("start").flatten(), np.float32).reshape(-1, rank)
            else:
                x = _user_factors(part, found, reg)
            x = x.astype(float)
            base += x.T @ x
            sizes, items, more, wanted = _flat(part)
            order = np.argsort(items, kind="stable")
            items, more, wanted = items[order], more[order], wanted[order]
            x = x[np.repeat(np.arange(len(sizes)), sizes)[order]]
            cuts = np.r_[np.flatnonzero(np.r_[True, items[1:] != items[:-1]]), len(items)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                i, s = items[lo], x[lo:hi]
                a[i] += (s * more[lo:hi, None]).T @ s
                b[i] += wanted[lo:hi] @ s
            liked += np.bincount(items[wanted > 0], minlength=n_items)
    if seen:
        up = np.triu_indices(rank)
        for at in range(0, n_items, 256):
            to = min(n_items, at + 256)
            rows = np.hstack([(a[at:to] + base)[:, up[0], up[1]], b[at:to], liked[at:to, None]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, to, dtype=np.int32)),
                                              pa.array([r.tobytes() for r in rows], pa.binary())],
                                             names=["item", "sums"])


def _solved(key, table: pa.Table, rank: int, reg: float) -> pa.Table:
    """An item's factors from the equations of all tasks, which are summed in an order of their own."""
    rows = np.array([np.frombuffer(x) for x in table.column("sums").to_pylist()])
    rows = np.sort(rows, axis=0).sum(axis=0)
    up, half = np.triu_indices(rank), rank * (rank + 1) // 2
    a = np.zeros((rank, rank))
    a[up] = rows[:half]
    a = a + np.triu(a, 1).T
    x = _solve(a[None], rows[None, half:half + rank], rows[-1:], reg)
    return pa.table({"item": pa.array([key[0].as_py()], pa.int32()), "features": _lists(x)})
