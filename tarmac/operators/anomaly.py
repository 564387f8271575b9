"""Isolation forest anomaly flags.

Liu, Ting & Zhou (2008): each of ``n_trees`` trees is grown on a sample of
psi = min(max_samples, n) rows by random axis-parallel splits up to height
ceil(log2 psi); a row's score is 2^(-E[h(x)] / c(psi)), where h is its path
length (plus c(leaf size) at an unfinished leaf). Rows whose score is strictly
above the (1 - contamination) percentile of all scores are flagged.

Spark plan:

* samples: every row draws a hash-based uniform per tree (``xxhash64`` of
  key, tree and seed, so independent of partitioning); only draws under an
  oversampling threshold are exploded, and a per-tree ``row_number`` keeps the
  psi smallest -- at most ~4 psi rows per tree are ever materialised;
* growing: ``groupBy(tree).applyInPandas`` -- one small task per tree;
* scoring: the trees (n_trees x < 2 psi nodes) are the only thing collected;
  they are broadcast and every row is scored in ``mapInPandas`` batches;
* threshold: exact percentile of the scores (``scale.exact_quantiles``).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.functions.columns import money_sum, month_key, month_start
from tarmac.operators.scale import exact_quantiles

EULER_GAMMA = 0.5772156649015329
NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, size long"


def avg_path_length(n) -> np.ndarray:
    """c(n): mean path length of an unsuccessful search in a BST of n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    two = n == 2
    big = n > 2
    out[two] = 1.0
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER_GAMMA) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def _grow(x: np.ndarray, rng: np.random.Generator, max_depth: int):
    """Grow one isolation tree; returns parallel node lists."""
    feature, threshold, left, right, size = [], [], [], [], []

    def build(idx: np.ndarray, depth: int) -> int:
        node = len(feature)
        feature.append(-1)
        threshold.append(0.0)
        left.append(-1)
        right.append(-1)
        size.append(len(idx))
        if depth >= max_depth or len(idx) <= 1:
            return node
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if usable.size == 0:
            return node
        f = int(usable[rng.integers(usable.size)])
        t = float(rng.uniform(lo[f], hi[f]))
        go_left = sub[:, f] < t
        feature[node], threshold[node] = f, t
        left[node] = build(idx[go_left], depth + 1)
        right[node] = build(idx[~go_left], depth + 1)
        return node

    build(np.arange(len(x)), 0)
    return feature, threshold, left, right, size


def _path_lengths(x: np.ndarray, tree: dict) -> np.ndarray:
    node = np.zeros(len(x), dtype=np.int64)
    depth = np.zeros(len(x), dtype=float)
    feat, thr, left, right, size = tree["feature"], tree["threshold"], tree["left"], tree["right"], tree["size"]
    active = feat[node] >= 0
    while active.any():
        n = node[active]
        f = feat[n]
        go_left = x[active, f] < thr[n]
        node[active] = np.where(go_left, left[n], right[n])
        depth[active] += 1
        active = feat[node] >= 0
    return depth + avg_path_length(size[node])


def isolation_forest(features: DataFrame, key: str, cols: list[str], n_trees: int = 100,
                     max_samples: int = 256, contamination: float = 0.10, seed: int = 42) -> DataFrame:
    """Add ``anomaly_score`` (unrounded) and ``is_anomaly`` to ``features``."""
    spark = features.sparkSession
    features = features.persist()  # read by the count, the sampling and the scoring
    n = features.count()
    if n == 0:
        return features.withColumn("anomaly_score", F.lit(None).cast("double")) \
            .withColumn("is_anomaly", F.lit(False))
    psi = int(min(max_samples, n))
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    keep = min(1.0, 4.0 * psi / n)

    def u(t):
        h = F.xxhash64(F.col(key).cast("string"), t, F.lit(seed))
        return (F.pmod(h, F.lit(1 << 52)).cast("double") / float(1 << 52))

    feats = features.select(F.col(key), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)])
    draws = feats.select("*", F.explode(F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)),
                                                 lambda t: u(t) < keep)).alias("tree"))
    draws = draws.withColumn("_u", u(F.col("tree")))
    pick = Window.partitionBy("tree").orderBy("_u", F.col(key).cast("string"))
    sample = draws.withColumn("_rn", F.row_number().over(pick)).filter(F.col("_rn") <= psi)
    xcols = [f"_x{i}" for i in range(len(cols))]

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_u", kind="mergesort")
        t = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([seed, t])
        fe, th, le, ri, si = _grow(pdf[xcols].to_numpy(dtype=float), rng, max_depth)
        return pd.DataFrame({"tree": t, "node": np.arange(len(fe), dtype=np.int32), "feature": fe,
                             "threshold": th, "left": le, "right": ri, "size": si})

    nodes = sample.select("tree", "_u", *xcols).groupBy("tree").applyInPandas(grow, NODE_SCHEMA)
    pdf = nodes.toPandas()  # n_trees x (< 2 psi) rows: the model
    trees = []
    for _, g in pdf.sort_values(["tree", "node"]).groupby("tree"):
        trees.append({k: g[k].to_numpy() for k in ["feature", "threshold", "left", "right", "size"]})
    bc = spark.sparkContext.broadcast(trees)
    c_psi = float(avg_path_length([psi])[0])
    out_schema = T.StructType(features.schema.fields + [T.StructField("anomaly_score", T.DoubleType())])

    def score(batches):
        forest = bc.value
        for pdf_ in batches:
            x = pdf_[cols].to_numpy(dtype=float)
            h = np.zeros(len(x))
            for tr in forest:
                h += _path_lengths(x, tr)
            pdf_["anomaly_score"] = np.power(2.0, -(h / max(len(forest), 1)) / c_psi) if c_psi > 0 else 0.5
            yield pdf_

    scored = features.mapInPandas(score, out_schema).persist()
    cut = exact_quantiles(scored, {"anomaly_score": [1.0 - contamination]})["anomaly_score"][0]
    return scored.withColumn("is_anomaly", F.col("anomaly_score") > F.lit(cut))


def monthly_features(sales: DataFrame) -> DataFrame:
    """Revenue and units per month (the anomaly features)."""
    return (sales.filter(F.col("Date").isNotNull())
            .groupBy(month_start("Date").alias("_m"))
            .agg(money_sum("Revenue").alias("revenue"), F.sum(F.col("Units_Sold").cast("long")).alias("units"))
            .select(month_key("_m").alias("month"), "revenue", "units"))


def monthly_anomalies(sales: DataFrame, contamination: float = 0.10, seed: int = 42,
                      n_trees: int = 100) -> DataFrame:
    """M4: month, revenue, units, is_anomaly, anomaly_score (4 digits)."""
    feats = monthly_features(sales)
    res = isolation_forest(feats, "month", ["revenue", "units"], n_trees=n_trees,
                           contamination=contamination, seed=seed)
    return res.select("month", F.round("revenue", 2).alias("revenue"), "units", "is_anomaly",
                      F.round("anomaly_score", 4).alias("anomaly_score")).orderBy("month")


def flagged(anomalies: DataFrame) -> DataFrame:
    """Flagged rows only."""
    return anomalies.filter(F.col("is_anomaly"))


def anomaly_summary(anomalies: DataFrame) -> DataFrame:
    """A22 + A23: flagged and normal counts, mean score of flagged rows (0 if none)."""
    return anomalies.agg(
        F.count_if(F.col("is_anomaly")).alias("flagged"),
        F.count_if(~F.col("is_anomaly")).alias("normal"),
        F.round(F.coalesce(F.avg(F.when(F.col("is_anomaly"), F.col("anomaly_score"))), F.lit(0.0)), 4)
        .alias("mean_flagged_score"),
    )


def customer_month_anomalies(sales: DataFrame, contamination: float = 0.10, seed: int = 42,
                             n_trees: int = 100) -> DataFrame:
    """M4 on a feature table that grows with the data: revenue and units per
    (customer, month). Trees see psi = 256 hashed samples each; every row is scored."""
    feats = (sales.filter(F.col("Date").isNotNull() & F.col("Customer").isNotNull())
             .groupBy("Customer", month_start("Date").alias("_m"))
             .agg(money_sum("Revenue").alias("revenue"), F.sum(F.col("Units_Sold").cast("long")).alias("units"))
             .select(F.concat_ws("|", "Customer", month_key("_m")).alias("key"),
                     F.col("Customer").alias("customer"), month_key("_m").alias("month"), "revenue", "units"))
    res = isolation_forest(feats, "key", ["revenue", "units"], n_trees=n_trees,
                           contamination=contamination, seed=seed)
    return res.select("customer", "month", F.round("revenue", 2).alias("revenue"), "units", "is_anomaly",
                      F.round("anomaly_score", 4).alias("anomaly_score"))
