"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and share ``share`` times all words; a
target stops at ``most`` times the source's size and the excess goes to the others by weight (water filling).

Schedule: slot i takes the golden-ratio point frac((i + 1) / phi), which the cumulative targets map to a source;
slots are ranked within their source, and rank k is the k-th block of ``block`` words of that source's stream. The
stream is the source's documents in keyed-hash order, repeated up to ``most`` times; the last block is cut so that
a source gives its target to the word. The few blocks that a source lacks after the last slot are appended.

Scale: stream offsets and slot ranks come from two-level sums (hash buckets, slot chunks), so a source with a third
of the rows is spread over all tasks; blocks meet documents in an equi-join on (source, block), evenly filled.
Windows over whole sources see one row per (source, bucket), per (source, chunk) or per source.

Cases: null text has size 0; null source is a source of its own, last; null doc_id and repeated rows are rows like
any other; sizes of 0 take nothing; an empty table gives an empty result; other columns are ignored or kept.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.common import WORD_RE, replace_columns, row_hash, stored

WEIGHTS = (5, 2, 1)
PHI = 0.6180339887498949
BLOCK = 256
CHUNK = 4096  # slots ranked together
CELLS = 1024  # cells of the unit interval in the map from points to sources
SEED = "mix"
_WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def sized(documents: DataFrame) -> DataFrame:
    """``documents`` plus size, the words of the text."""
    return (replace_columns(documents, ["size"])
            .withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD_RE)), F.lit(0)).cast("long")))


def targets(sizes: DataFrame, share: float = 1.5, most: int = 2, weights=WEIGHTS) -> DataFrame:
    """(source, source_size, target, quota, lo, hi) of every source in ``sizes`` (source, size).

    quota is the target rounded to words; [lo, hi) is its place in the cumulative quotas. One row per source.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    src = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
           .withColumn("w", weight.cast("long")))
    by_need = (Window.partitionBy(F.lit(0)).orderBy(F.col("source_size") / F.col("w"),
                                                    F.col("source").asc_nulls_last()))
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    total = F.lit(float(share)) * F.sum("source_size").over(whole)
    level = ((total - float(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
             / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))))
    src = src.withColumn("level", level).withColumn("full", F.col("level") * F.col("w") > most * F.col("source_size"))
    open_level = F.min(F.when(~F.col("full"), F.struct(F.col("source_size") / F.col("w"), "level"))).over(whole)
    src = src.withColumn("open", open_level["level"])
    target = F.when(F.col("full"), F.col("source_size") * float(most)).otherwise(F.col("open") * F.col("w"))
    src = src.select("source", "source_size", target.alias("target"))
    src = src.withColumn("quota", F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * most))
    upto = by_name.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return src.withColumn("hi", F.sum("quota").over(upto)).withColumn("lo", F.col("hi") - F.col("quota"))


def schedule(goal: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, source, rank): the order in which the blocks of the sources are read.

    rank k stands for words [k * block, min((k + 1) * block, quota)) of the source's repeated stream.
    """
    spark = goal.sparkSession
    total = goal.agg(F.sum("quota")).first()[0] or 0
    n_slots = -(-total // block)
    x = (F.col("slot") + 1) * F.lit(PHI)
    points = (spark.range(n_slots).withColumnRenamed("id", "slot")
              .withColumn("x", x - F.floor(x)).withColumn("at", F.col("x") * float(total or 1))
              .withColumn("cell", F.floor(F.col("x") * CELLS)))
    width = float(total or 1) / CELLS
    cells = (goal.filter("quota > 0")
             .withColumn("cell", F.explode(F.sequence(F.greatest(F.floor(F.col("lo") / width) - 1, F.lit(0)),
                                                      F.floor(F.col("hi") / width) + 1))))
    hit = (points.join(cells, "cell").filter("at >= lo AND at < hi")
           .select("slot", "source", "quota", F.floor(F.col("slot") / CHUNK).alias("chunk")))
    counts = hit.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("source").alias("s2"), F.col("chunk").alias("c2"),
                         F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = (hit.withColumn("r", F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1)
              .join(base, F.col("source").eqNullSafe(F.col("s2")) & (F.col("chunk") == F.col("c2")))
              .select("slot", "source", (F.col("before") + F.col("r")).alias("rank"), "quota")
              .filter(F.col("rank") * block < F.col("quota")).drop("quota"))
    # What a source still lacks after the last slot: at most the discrepancy of the point set.
    had = counts.groupBy("source").agg(F.sum("n").alias("had")).withColumnRenamed("source", "s3")
    lacking = (goal.join(had, F.col("source").eqNullSafe(F.col("s3")), "left")
               .withColumn("need", F.ceil(F.col("quota") / block))
               .withColumn("had", F.coalesce("had", F.lit(0))).filter("need > had")
               .select("source", "lo", F.explode(F.sequence(F.col("had"), F.col("need") - 1)).alias("rank")))
    late = lacking.select((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("rank", "lo")) - 1 + n_slots)
                          .alias("slot"), "source", "rank")
    return ranked.unionByName(late)


def stream(rows: DataFrame, seed: str = SEED) -> DataFrame:
    """``rows`` (doc_id, source, size, tie, ...) plus start: the row's offset in its source's keyed-hash order."""
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    keyed = rows.withColumn("key", key).withColumn("bucket", F.substring("key", 1, 3))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col("source").alias("s2"), F.col("bucket").alias("b2"),
                       F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = (Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "tie")
              .rowsBetween(Window.unboundedPreceding, -1))
    return (keyed.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .join(base, F.col("source").eqNullSafe(F.col("s2")) & (F.col("bucket") == F.col("b2")))
            .withColumn("start", F.col("before") + F.col("inner"))
            .drop("s2", "b2", "before", "inner", "key", "bucket"))


def mix(rows: DataFrame, share: float = 1.5, most: int = 2, block: int = BLOCK, seed: str = SEED) -> DataFrame:
    """One row per scheduled piece: doc_id, start (names the row within its source), source, size, source_size,
    target, slot, epoch, word_lo, word_hi; rows that no slot reaches have one row with null slot.

    ``rows`` has doc_id, source, size and tie (any value that tells rows of equal doc_id and size apart).
    """
    rows = stored(rows.select("doc_id", "source", "size", "tie"), "mix-sizes")
    goal = stored(targets(rows, share, most), "mix-targets")
    plan = schedule(goal, block)
    small = goal.select(F.col("source").alias("s4"), "source_size", "target", "quota")
    placed = (stream(rows, seed).join(small, F.col("source").eqNullSafe(F.col("s4"))).drop("s4")
              .withColumn("row", F.xxhash64("doc_id", "source", "start", "size")))
    epochs = (placed.filter("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
              .withColumn("from", F.col("start") + F.col("epoch") * F.col("source_size"))
              .filter(F.col("from") < F.col("quota")).withColumn("to", F.least(F.col("from") + F.col("size"), "quota"))
              .withColumn("rank", F.explode(F.sequence(F.floor(F.col("from") / block),
                                                       F.floor((F.col("to") - 1) / block)))))
    plan = plan.select("slot", F.col("source").alias("s5"), F.col("rank").alias("k"))
    pieces = (epochs.join(plan, F.col("source").eqNullSafe(F.col("s5")) & (F.col("rank") == F.col("k")))
              .withColumn("word_lo", F.greatest(F.col("rank") * block, "from") - F.col("from"))
              .withColumn("word_hi", F.least((F.col("rank") + 1) * block, "to") - F.col("from")))
    cols = ["doc_id", "source", "start", "size", "tie", "source_size", "target", "slot", "epoch", "word_lo", "word_hi"]
    pieces = pieces.select(*cols)
    idle = (placed.filter(~((F.col("size") > 0) & (F.col("start") < F.col("quota"))))
            .select("doc_id", "source", "start", "size", "tie", "source_size", "target",
                    *[F.lit(None).cast("long").alias(c) for c in cols[7:]]))
    return pieces.withColumn("epoch", F.col("epoch").cast("long")).unionByName(idle)


def row_key() -> Column:
    """A key of the row's doc_id, source and text, never null; rows with equal keys are interchangeable."""
    part = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in ("doc_id", "source", "text")]
    return F.md5(F.concat_ws("\u0001", *part))


def taken(documents: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per document row."""
    rows = sized(documents).select("doc_id", "source", "size", row_key().alias("tie"))
    pieces = mix(rows, **options)
    key = ["doc_id", "source", "start", "size", "tie", "source_size", "target"]
    # Repeated rows of size 0 share all of the key: count them, then give each its row.
    out = pieces.groupBy(*key).agg(F.coalesce(F.sum(F.col("word_hi") - F.col("word_lo")), F.lit(0)).alias("taken"),
                                   F.sum(F.col("slot").isNull().cast("int")).alias("idle"))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest("idle", F.lit(1)).cast("int"))))
    return out.select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """The mixed corpus with the columns of ``documents``: of each document and pass the words taken, one row each.

    A pass that takes all words gives the text as it is; the pass that the target cuts gives the words taken, from
    the first to the last, as they stand in the text. n_chars, if there is such a column, is that text's. Rows are
    told apart by all their columns.
    """
    hashes = row_hash(documents)
    key = F.concat_ws("|", row_key(), F.hex(hashes["a"]), F.hex(hashes["b"]))
    rows = sized(documents.select("doc_id", "source", "text", key.alias("tie"))).select("doc_id", "source", "size", "tie")
    passes = (mix(rows, **options).filter("slot IS NOT NULL").groupBy("tie", "start", "size", "epoch")
              .agg(F.min("word_lo").alias("lo"), F.max("word_hi").alias("hi"))
              .groupBy("tie").agg(F.collect_list(F.struct("lo", "hi", "size")).alias("__passes"))
              .withColumnRenamed("tie", "__key"))
    cols = documents.columns
    keyed = documents.withColumn("__key", key)
    one = keyed.withColumn("__copy", F.row_number().over(Window.partitionBy("__key").orderBy("__key")))
    both = one.filter("__copy = 1").join(passes, "__key").select(*[f"`{c}`" for c in cols], F.explode("__passes")
                                                                .alias("__p"))
    whole = (F.col("__p.lo") == 0) & (F.col("__p.hi") == F.col("__p.size"))
    flat = both.select(*[f"`{c}`" for c in cols], F.when(whole, F.lit(-1)).otherwise(F.col("__p.lo")).alias("__lo"),
                       F.col("__p.hi").alias("__hi"))
    at_text = cols.index("text")
    at_chars = cols.index("n_chars") if "n_chars" in cols else None

    def cut(batches):
        for b in batches:
            los, his = b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()
            if all(lo < 0 for lo in los):
                yield b.select(cols)
                continue
            texts = b.column(at_text).to_pylist()
            arrays = list(b.columns[:-2])
            new = [t if lo < 0 else words_between(t, lo, hi) for t, lo, hi in zip(texts, los, his)]
            arrays[at_text] = pa.array(new, arrays[at_text].type)
            if at_chars is not None:
                n = [c if lo < 0 else len(t) for c, lo, t in zip(arrays[at_chars].to_pylist(), los, new)]
                arrays[at_chars] = pa.array(n, arrays[at_chars].type)
            yield pa.RecordBatch.from_arrays(arrays, names=cols)

    return flat.mapInArrow(cut, documents.schema)


def words_between(text: str, lo: int, hi: int) -> str:
    """The text from its word ``lo`` to its word ``hi`` - 1."""
    found = list(_WORD.finditer(text))
    return text[found[lo].start():found[hi - 1].end()] if hi > lo else ""
