"""Churn scoring with per-customer attribution (M1a-f, A20, A21, P5, P7).

* label (M1a): Recency above its exact 60th percentile; above the median if
  that leaves one class. The label is a function of a feature, so the fit is
  near-trivial -- kept as the reference defines it.
* model (M1b): standardised (Recency, Frequency, Monetary) -> gradient-boosted
  trees (``pyspark.ml`` ``GBTClassifier``: 200 trees, depth 4, step 0.05,
  subsampling 0.8, seed 42) in a ``Pipeline``; in-sample probability. With one
  class only, the probability is Recency / max(Recency) (M1c).
* attribution (M1e): exact Shapley values of the features with path-dependent
  conditional expectations (a split on a feature outside the coalition averages
  both children by their training counts). The trees are read from the saved
  model's node table (the public ML persistence format), cut into leaf paths,
  broadcast, and evaluated in ``mapInPandas`` batches, once for all rows that
  lie between the same thresholds (``attribute``). A path costs the square of
  its distinct features, at any number of features of the model (see
  ``shapley``). Values are in log-odds units: base + sum(phi) = logit(probability).
* importance (M1d): the model's gain importances and mean |phi| per feature.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.operators.scale import exact_quantiles, maybe_broadcast
from tarmac.schema import RISK_HIGH, RISK_MEDIUM
from tarmac.session import scratch_path, stored

FEATURES = ["Recency", "Frequency", "Monetary"]
# Rows below which a further partition of the fit costs more than it saves, and that one partition may hold.
FIT_ROWS, MOST_FIT_ROWS = 25_000, 500_000


def churn_label(base: DataFrame) -> tuple[DataFrame, float]:
    """Add ``label``; returns (frame, threshold used)."""
    q = exact_quantiles(base, {"Recency": [0.6, 0.5]})["Recency"]
    labelled = base.withColumn("label", (F.col("Recency") > F.lit(q[0])).cast("double"))
    counts = labelled.agg(F.count_if(F.col("label") == 1).alias("pos"), F.count(F.lit(1)).alias("n")).first()
    if 0 < counts["pos"] < counts["n"]:
        return labelled, q[0]
    return base.withColumn("label", (F.col("Recency") > F.lit(q[1])).cast("double")), q[1]


def _read_trees(spark, path: str) -> tuple[list[dict], np.ndarray]:
    """Node arrays per tree and the tree weights from a saved GBT model."""
    data = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.rawCount", "nodeData.leftChild",
        "nodeData.rightChild", "nodeData.split.featureIndex",
        F.get(F.col("nodeData.split.leftCategoriesOrThreshold"), 0).alias("threshold")).toPandas()
    meta = spark.read.parquet(f"{path}/treesMetadata")
    if "treeID" not in meta.columns:  # stored as an unnamed (treeID, metadata, weight) tuple
        meta = meta.toDF("treeID", "metadata", "weights")
    meta = meta.select("treeID", "weights").toPandas()
    weights = meta.sort_values("treeID")["weights"].to_numpy(dtype=float)
    trees = []
    for _, g in data.sort_values(["treeID", "id"]).groupby("treeID"):
        n = int(g["id"].max()) + 1
        arr = {k: np.zeros(n) for k in ["pred", "count", "thr"]}
        arr["left"] = np.full(n, -1, dtype=np.int64)
        arr["right"] = np.full(n, -1, dtype=np.int64)
        arr["feat"] = np.full(n, -1, dtype=np.int64)
        ids = g["id"].to_numpy()
        arr["pred"][ids] = g["prediction"].to_numpy()
        arr["count"][ids] = g["rawCount"].to_numpy()
        arr["left"][ids] = g["leftChild"].to_numpy()
        arr["right"][ids] = g["rightChild"].to_numpy()
        internal = g["leftChild"].to_numpy() >= 0
        arr["feat"][ids[internal]] = g["featureIndex"].to_numpy()[internal]
        arr["thr"][ids[internal]] = g["threshold"].to_numpy()[internal]
        trees.append(arr)
    return trees, weights


def leaf_paths(tree: dict) -> list[tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(value, features, shares, low, high) of each leaf: for each distinct feature on the way to it the product of the
    training shares of the children taken, and the interval (low, high] that the splits leave."""
    out = []
    stack = [(0, {})]
    while stack:
        node, way = stack.pop()
        f = int(tree["feat"][node])
        if f < 0:
            feats = sorted(way)
            share, low, high = (np.array([way[k][i] for k in feats], dtype=float) for i in range(3))
            out.append((float(tree["pred"][node]), np.array(feats, dtype=np.int64), share, low, high))
            continue
        kids = tree["left"][node], tree["right"][node]
        counts = [tree["count"][k] for k in kids]
        total = sum(counts)
        thr = tree["thr"][node]
        share, low, high = way.get(f, (1.0, -np.inf, np.inf))
        for k, c, bounds in zip(kids, counts, [(low, min(high, thr)), (max(low, thr), high)]):
            stack.append((k, {**way, f: (share * (c / total if total > 0 else 0.5), *bounds)}))
    return out


def _extend(poly: np.ndarray, share: float, inside: np.ndarray) -> np.ndarray:
    """poly * (share + inside y), row by row; column k of poly is the coefficient of y^k."""
    out = np.zeros((len(poly), poly.shape[1] + 1))
    out[:, :-1] = share * poly
    out[:, 1:] += inside[:, None] * poly
    return out


def _unwind(poly: np.ndarray, share: float, inside: np.ndarray) -> np.ndarray:
    """poly / (share + inside y), row by row; ``share`` is above 0."""
    out = np.empty((len(poly), poly.shape[1] - 1))
    carry = np.zeros(len(poly))
    for k in range(poly.shape[1] - 1, 0, -1):
        carry = poly[:, k] - share * carry
        out[:, k - 1] = np.where(inside, carry, poly[:, k - 1] / share)
    return out


def shapley(x: np.ndarray, trees: list[dict], weights: np.ndarray,
            paths: list[list] | None = None) -> tuple[float, np.ndarray]:
    """(base, phi[n, m]) of the weighted tree sum, in the model's margin units.

    A leaf of value v is reached under a coalition with the weight prod over the features of its path: 1 or 0 for a
    member (x in the interval or not), the training share for the others. The sum over all coalitions of one size is a
    coefficient of prod(share_j + inside_j y), so the path's polynomial is extended by each feature once, and
    each feature's value needs it unwound by that feature only. A share of 0 cannot be divided by; the product of the
    others is then built anew.
    """
    phi = np.zeros(x.shape)
    base = 0.0
    for w, found in zip(weights, paths if paths is not None else [leaf_paths(t) for t in trees]):
        for value, feats, shares, low, high in found:
            d = len(feats)
            base += w * value * float(np.prod(shares))
            if not d or not len(x):
                continue
            inside = (x[:, feats] > low) & (x[:, feats] <= high)
            poly = np.ones((len(x), 1))
            for j in range(d):
                poly = _extend(poly, shares[j], inside[:, j])
            sizes = np.array([math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d) for k in range(d)])
            for j in range(d):
                if shares[j] > 0:
                    rest = _unwind(poly, shares[j], inside[:, j])
                else:
                    rest = np.ones((len(x), 1))
                    for k in range(d):
                        if k != j:
                            rest = _extend(rest, shares[k], inside[:, k])
                phi[:, feats[j]] += w * value * (inside[:, j] - shares[j]) * (rest @ sizes)
    return (base if len(x) else 0.0), phi


def fit_partitions(rows: int, cores: int) -> int:
    """Partitions of the fit's ``rows``: ``FIT_ROWS`` rows each, at most one a core, unless they then exceed
    ``MOST_FIT_ROWS``."""
    return max(1, min(cores, -(-rows // FIT_ROWS)), -(-rows // MOST_FIT_ROWS))


def attribute(rows: DataFrame, trees: list[dict], weights: np.ndarray) -> DataFrame:
    """Customer, base_value, shap_*: the attributions of each row of ``rows`` (Customer, ``_x`` the model's features).

    The trees tell rows apart only by the side of their thresholds. Rows that lie between the same thresholds (a model of
    few features has few such cells: at most the bins of the fit to the power of the features) are attributed once, by
    any of their values, and joined to the result.
    """
    spark = rows.sparkSession
    bc = spark.sparkContext.broadcast(([leaf_paths(t) for t in trees], weights))
    places, shaps = [f"_at_{i}" for i in range(len(FEATURES))], [f"shap_{f.lower()}" for f in FEATURES]
    out_schema = T.StructType([T.StructField(c, T.IntegerType()) for c in places]
                              + [T.StructField(c, T.DoubleType()) for c in ["base_value", *shaps]])

    def values(batches):
        paths, wt = bc.value
        for pdf in batches:
            x = np.array(pdf["_x"].tolist(), dtype=float).reshape(len(pdf), len(FEATURES))
            base_v, phi = shapley(x, [], wt, paths)
            out = pdf[places].assign(base_value=2.0 * base_v)
            for i, c in enumerate(shaps):
                out[c] = 2.0 * phi[:, i]  # Spark's logistic margin is half the log-odds
            yield out

    edges = [np.concatenate([t["thr"][t["feat"] == i] for t in trees]) for i in range(len(FEATURES))]
    placed = rows.select("Customer", "_x", *[_passed(F.get("_x", i), edges[i]).alias(c)
                                             for i, c in enumerate(places)]).persist()
    cells = placed.groupBy(*places).agg(*[F.min(F.get("_x", i)).alias(f"_x_{i}") for i in range(len(FEATURES))]) \
        .repartition(spark.sparkContext.defaultParallelism) \
        .select(*places, F.array(*[f"_x_{i}" for i in range(len(FEATURES))]).alias("_x"))
    found = cells.mapInPandas(values, out_schema).persist()  # counted, then joined
    return placed.join(maybe_broadcast(found), places).select("Customer", "base_value", *shaps)


def _passed(x: F.Column, thresholds: np.ndarray) -> F.Column:
    """How many of the distinct ``thresholds`` lie below ``x``."""
    return sum(((x > F.lit(float(t))).cast("int") for t in np.unique(thresholds)), F.lit(0))


def train_churn(rfm_table: DataFrame, max_iter: int = 200, max_depth: int = 4, step_size: float = 0.05,
                subsampling: float = 0.8, seed: int = 42) -> dict[str, DataFrame]:
    """Fit the churn model on an RFM table (``rfm_scores`` output); returns
    DataFrames ``scores`` (per customer, unrounded), ``attribution`` and ``importance``."""
    spark = rfm_table.sparkSession
    base = rfm_table.persist()
    labelled, _ = churn_label(base)
    labelled = labelled.persist()
    rows, classes = labelled.agg(F.count(F.lit(1)), F.count_distinct(F.coalesce("label", F.lit(-1.0)))).first()
    if classes < 2:  # M1c: no model can be fitted
        mx = labelled.agg(F.max("Recency")).first()[0] or 1
        scores = labelled.withColumn("churn_prob", F.col("Recency") / F.lit(float(mx)))
        empty = spark.createDataFrame([], "Customer string, base_value double, " +
                                      ", ".join(f"shap_{f.lower()} double" for f in FEATURES))
        imp = spark.createDataFrame([(f, 0.0, 0.0) for f in FEATURES],
                                    "feature string, importance double, shap_mean double")
        return {"scores": scores, "attribution": empty, "importance": imp}
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="raw_features")
    scaler = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)
    gbt = GBTClassifier(featuresCol="features", labelCol="label", maxIter=max_iter, maxDepth=max_depth,
                        stepSize=step_size, subsamplingRate=subsampling, seed=seed)
    # a tree costs several jobs over all partitions, so there are no more than its rows are worth
    parts = fit_partitions(rows, spark.sparkContext.defaultParallelism)
    train = labelled.select(*FEATURES, "label").repartition(parts)
    model = Pipeline(stages=[assembler, scaler, gbt]).fit(train)
    scored = model.transform(labelled).withColumn("churn_prob", vector_to_array("probability")[1])

    gbt_model = model.stages[-1]
    path = scratch_path(spark, "churn-gbt")
    gbt_model.write().overwrite().save(path)
    trees, weights = _read_trees(spark, path)
    feat = scored.select("Customer", vector_to_array("features").alias("_x"))
    attribution = stored(attribute(feat, trees, weights), "churn-attribution")  # worked out once, however often it is read
    mean_abs = attribution.agg(*[F.avg(F.abs(f"shap_{f.lower()}")).alias(f) for f in FEATURES]).first()
    importances = gbt_model.featureImportances.toArray().tolist()
    imp = spark.createDataFrame(
        [(f, float(importances[i]), float(mean_abs[f])) for i, f in enumerate(FEATURES)],
        "feature string, importance double, shap_mean double")
    return {"scores": scored.drop("raw_features", "features", "rawPrediction", "probability", "prediction"),
            "attribution": attribution, "importance": imp}


def risk(prob) -> F.Column:
    p = F.col(prob) if isinstance(prob, str) else prob
    return F.when(p >= RISK_HIGH, "High").when(p >= RISK_MEDIUM, "Medium").otherwise("Low")


def churn_table(scores: DataFrame) -> DataFrame:
    """M1f: per customer risk (decided before rounding), probability 3 digits, Monetary 0 digits."""
    return scores.select(
        F.col("Customer").alias("customer"), F.col("Region").alias("region"),
        F.col("Recency").alias("recency"), F.col("Frequency").alias("frequency"),
        F.round("Monetary", 0).alias("monetary"), F.col("Segment").alias("segment"),
        F.round("churn_prob", 3).alias("churn_prob"), risk("churn_prob").alias("risk"),
    ).orderBy(F.desc("churn_prob"), "customer")


def attribution_table(attribution: DataFrame, customer: str | None = None) -> DataFrame:
    """M1e (+P7): attributions (4 digits) sorted by customer; one customer when given
    (empty when unknown)."""
    a = attribution if customer is None else attribution.filter(F.col("Customer") == customer)
    return a.select(F.col("Customer").alias("customer"), F.round("base_value", 4).alias("base_value"),
                    *[F.round(f"shap_{f.lower()}", 4).alias(f"shap_{f.lower()}") for f in FEATURES]) \
        .orderBy("customer")


def churn_check(model: dict[str, DataFrame], digits: float = 1e-6) -> DataFrame:
    """Counts over all customers: rows, and rows that break a rule (probability within 0 to 1; base + sum of the
    attributions = logit of the probability; every customer attributed once)."""
    scores, parts = model["scores"], model["attribution"]
    p = F.col("churn_prob")
    total = sum((F.col(f"shap_{f.lower()}") for f in FEATURES), F.col("base_value"))
    each = parts.groupBy("Customer").agg(F.count(F.lit(1)).alias("parts"), F.max(total).alias("margin"))
    rows = scores.select("Customer", p).join(each, "Customer", "left")

    def broken(ok):
        return F.count_if(~F.coalesce(ok, F.lit(False)))
    return rows.agg(F.count(F.lit(1)).alias("customers"), broken(p.between(0, 1)).alias("bad_probability"),
                    broken(F.col("parts") == 1).alias("bad_count"),
                    broken(F.abs(F.col("margin") - F.ln(p / (1 - p))) <= digits).alias("bad_sum"))


def importance_table(importance: DataFrame) -> DataFrame:
    """M1d: importance and mean |phi| (4 digits), importance descending."""
    return importance.select("feature", F.round("importance", 4).alias("importance"),
                             F.round("shap_mean", 4).alias("shap_mean")).orderBy(F.desc("importance"), "feature")


def risk_counts(table: DataFrame) -> DataFrame:
    """High and Medium counts (the rest is Low)."""
    return table.agg(F.count_if(F.col("risk") == "High").alias("high_risk_count"),
                     F.count_if(F.col("risk") == "Medium").alias("medium_risk_count"))


def filter_risk(table: DataFrame, level: str) -> DataFrame:
    """P5: customers of one risk level."""
    return table.filter(F.col("risk") == level)


def probability_histogram(table: DataFrame, bins: int = 10) -> DataFrame:
    """Counts in ``bins`` equal bins of the probability; the top bin is closed; empty bins 0."""
    spark = table.sparkSession
    b = F.least(F.lit(bins - 1), F.floor(F.col("churn_prob") * bins).cast("int"))
    counts = table.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (grid.join(F.broadcast(counts), "bin", "left")
            .select("bin", F.format_string("%d–%d%%", F.col("bin") * (100 // bins), (F.col("bin") + 1) * (100 // bins))
                    .alias("range"), F.coalesce("count", F.lit(0)).cast("long").alias("count"))
            .orderBy("bin"))
