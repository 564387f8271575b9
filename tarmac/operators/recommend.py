"""Product recommendations by implicit-feedback ALS (M2a-c, A25, J7, J8).

* interactions (A25): per (customer, product) log1p of summed revenue -- one
  aggregate with map-side combine;
* index maps (J8): dense 0-based ids over the sorted distinct names
  (``scale.ordered_row_id``: a window under the size bound, range-partitioned
  two-phase ids above it); joined back with a broadcast only under the bound;
* model (M2a): implicit ALS (rank 32, reg 0.1, 30 iterations, seed 42), see
  ``als``: few items are solved from equations summed per task, many by
  ``pyspark.ml.recommendation.ALS``;
* recommendations (M2b, J7): the products' factors are dealt into blocks of
  ``spark.tarmac.broadcastRows`` at most; a task multiplies a batch of customers
  with a block, masks what each customer has bought and keeps that block's best
  n, so at most customers x n x blocks rows leave the product and one customer
  who bought everything costs the others nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions.columns import money_sum
from tarmac.operators import als
from tarmac.operators.scale import broadcast_rows, maybe_broadcast, ordered_row_id


def interactions(sales: DataFrame) -> DataFrame:
    """Customer, product, rating = log1p(summed revenue)."""
    return (sales.filter(F.col("Customer").isNotNull() & F.col("Product_Name").isNotNull())
            .groupBy(F.col("Customer").alias("customer"), F.col("Product_Name").alias("product"))
            .agg(F.log1p(money_sum("Revenue")).alias("rating")))


def entity_index(names: DataFrame, name_col: str, id_col: str) -> DataFrame:
    """Dense 0-based ids over the sorted distinct names."""
    distinct = names.select(name_col).filter(F.col(name_col).isNotNull()).distinct()
    return ordered_row_id(distinct, [F.col(name_col).asc()], id_col, start=0) \
        .select(name_col, F.col(id_col).cast("int").alias(id_col))


def train_recommender(sales: DataFrame, rank: int = 32, reg: float = 0.1, iterations: int = 30,
                      seed: int = 42) -> dict:
    """Fit ALS; returns the model, index maps and the rated pairs."""
    inter = interactions(sales).persist()
    users = entity_index(inter, "customer", "user").persist()
    items = entity_index(inter, "product", "item").persist()
    data = inter.join(maybe_broadcast(users), "customer").join(maybe_broadcast(items), "product") \
        .select("user", "item", "rating", "customer", "product").persist()
    model = als.fit(data.select("user", "item", "rating"), items.count(), rank, reg, iterations, seed)
    return {"model": model, "users": users, "items": items, "rated": data}


TILE = 4096  # customers x products scored at once, at most this many of each


def masked_top_n(users: DataFrame, items: DataFrame, bought: DataFrame, n: int, block: int | None = None) -> DataFrame:
    """(user, item, score): per user the ``n`` items of the greatest products of factors among those not ``bought``.

    ``users`` (id, features), ``items`` (id, features), ``bought`` (user, item); ids of items are dense from 0. Ties go
    to the smaller item. A block of items is the only thing broadcast, ``block`` rows (the broadcast bound) at most.
    """
    spark = users.sparkSession
    block = block or broadcast_rows(spark)
    last = items.agg(F.max("id")).first()[0]
    if last is None:
        return spark.createDataFrame([], "user int, item int, score float")
    held = bought.groupBy("user").agg(F.sort_array(F.collect_list("item")).alias("held"))
    asked = users.select(F.col("id").alias("user"), "features").join(held, "user", "left")
    tops = None
    for low in range(0, last + 1, block):
        part = items.filter((F.col("id") >= low) & (F.col("id") < low + block)).orderBy("id").toArrow()
        ids = part.column("id").to_numpy()
        matrix = np.array(part.column("features").to_pylist(), np.float32).reshape(len(ids), -1)
        shared = spark.sparkContext.broadcast((ids, matrix))

        def run(batches, shared=shared):
            ids, matrix = shared.value
            for b in batches:
                for at in range(0, b.num_rows, TILE):
                    yield _best(b.slice(at, TILE), ids, matrix, n)

        found = asked.mapInArrow(run, "user int, item int, score float")
        tops = found if tops is None else tops.unionByName(found)
    return tops


def _best(batch: pa.RecordBatch, ids: np.ndarray, matrix: np.ndarray, n: int) -> pa.RecordBatch:
    """The best ``n`` unbought items of the block for each user of the batch, tile by tile."""
    users = np.array(batch.column("user"))
    features = np.array(batch.column("features").to_pylist(), np.float32).reshape(len(users), -1)
    lists = batch.column("held")
    count = np.array(lists.value_lengths().fill_null(0))
    owner, held = np.repeat(np.arange(len(users)), count), lists.flatten().to_numpy(zero_copy_only=False)
    rows, cols, score = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))
    for at in range(0, len(ids), TILE):
        some = ids[at:at + TILE]
        product = features @ matrix[at:at + TILE].T
        place = np.searchsorted(some, held)
        inside = place < len(some)
        inside[inside] = some[place[inside]] == held[inside]
        product[owner[inside], place[inside]] = -np.inf
        # Ties go to the smaller item, so every score equal to the n-th stays until items are compared.
        keep = min(n, len(some))
        least = -np.partition(-product, keep - 1, axis=1)[:, keep - 1:keep]
        r, c = np.nonzero((product >= least) & (product > -np.inf))
        rows, cols, score = (np.concatenate(x) for x in ((rows, r), (cols, some[c]), (score, product[r, c])))
        order = np.lexsort((cols, -score, rows))
        rows, cols, score = rows[order], cols[order], score[order]
        first = np.searchsorted(rows, rows)
        best = np.arange(len(rows)) - first < n
        rows, cols, score = rows[best], cols[best], score[best]
    return pa.RecordBatch.from_arrays([pa.array(users[rows].astype(np.int32)), pa.array(cols.astype(np.int32)),
                                       pa.array(score.astype(np.float32))], names=["user", "item", "score"])


def recommend(trained: dict, n: int = 5, customers: DataFrame | None = None) -> DataFrame:
    """Top ``n`` unseen products per customer (all customers, or those in
    ``customers``, a one-column DataFrame of names); score 4 digits. Unknown
    customers give no rows."""
    model, users, items, rated = trained["model"], trained["users"], trained["items"], trained["rated"]
    asked, bought = model.userFactors, rated.select("user", "item")
    if customers is not None:
        subset = users.join(customers.select(F.col(customers.columns[0]).alias("customer")), "customer", "left_semi")
        asked = asked.join(subset.select(F.col("user").alias("id")), "id", "left_semi")
        bought = bought.join(subset.select("user"), "user", "left_semi")
    unseen = masked_top_n(asked, model.itemFactors, bought, n)
    w = Window.partitionBy("user").orderBy(F.desc("score"), "item")
    top = unseen.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return (top.join(maybe_broadcast(users), "user").join(maybe_broadcast(items), "item")
            .select("customer", "product", F.round(F.col("score").cast("double"), 4).alias("score"), "rank")
            .orderBy("customer", "rank"))


def recommend_for(trained: dict, customer: str, n: int = 5) -> DataFrame:
    """M2b for one customer."""
    spark = trained["users"].sparkSession
    who = spark.range(1).select(F.lit(customer).alias("customer"))
    return recommend(trained, n, who)


def customer_list(sales: DataFrame) -> DataFrame:
    """Sorted distinct customers."""
    return sales.select(F.col("Customer").alias("customer")).filter(F.col("customer").isNotNull()) \
        .distinct().orderBy("customer")
