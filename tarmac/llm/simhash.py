"""SimHash document fingerprints and their search by permuted block tables, in DataFrame functions only.

Fingerprint: the distinct words of the ASCII-lower-cased text are the terms; a term weighs the square of its length
in characters (at most ``LONGEST``), so that function words hardly vote. Each term votes with its weight for or
against each of ``BITS`` bits by its hash (XXH64, one seed for each 64 bits); a bit is 1 if the votes for it are
more than half of all. Two votes are summed in one long (32 bits each, enough for 16 million terms of full weight
in one text), so a fingerprint is a grouped sum of 32 longs for 64 bits: it combines in each task, and no Python runs.

Search: a fingerprint is cut into ``blocks`` parts. Two fingerprints within ``radius`` bits agree in blocks - radius
parts at least; for each choice of that many parts there is a table keyed by their hash. Queries meet the distinct
fingerprints in an equi-join on (table, key); the full distance is then checked and a pair counts in its first table.
A row of a table is the fingerprint's longs and the key, nothing else is shuffled.

Cases: null text counts as empty, which has fingerprint 0; a null doc_id comes first in the order; equal ids
are ordered by text; repeated rows are rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.common import LOWER, UPPER

BITS = 128
LONGEST = 16
LANES = 0x100000001  # bits 0 and 32


def terms(text: Column) -> Column:
    """The distinct words of a text."""
    return F.array_remove(F.array_distinct(F.split(F.translate(text, UPPER, LOWER), "[\\x20\\x09-\\x0D]+")), "")


def _hashes(term: Column, bits: int) -> list[Column]:
    return [F.xxhash64(term) if k == 0 else F.xxhash64(term, F.lit(k)) for k in range(bits // 64)]


def fingerprints(rows: DataFrame, keys: list[str], text: str = "text", bits: int = BITS) -> DataFrame:
    """``keys`` (which name a row each) plus fp, an array of bits / 64 longs, for every row."""
    words = bits // 64
    exploded = rows.select(*keys, F.explode_outer(terms(F.coalesce(F.col(text), F.lit("")))).alias("term"))
    length = F.when(F.col("term").isNull(), 0).otherwise(F.least(F.length("term"), F.lit(LONGEST)))
    voted = exploded.select(*keys, (length * length).cast("long").alias("w"),
                            *[h.alias(f"h{k}") for k, h in enumerate(_hashes(F.col("term"), bits))])
    sums = [F.sum(F.shiftrightunsigned(f"h{k}", i).bitwiseAND(F.lit(LANES)) * F.col("w")).alias(f"v{k}_{i}")
            for k in range(words) for i in range(32)]
    votes = voted.groupBy(*keys).agg(F.sum("w").alias("w"), *sums)
    low = F.lit(0xFFFFFFFF)
    fp = []
    for k in range(words):
        one = None
        for i in range(32):
            v = F.col(f"v{k}_{i}")
            for lane, bit in ((v.bitwiseAND(low), i), (F.shiftrightunsigned(v, 32), i + 32)):
                mark = F.when(lane * 2 > F.col("w"), F.lit(1 << bit if bit < 63 else -(1 << 63))).otherwise(F.lit(0))
                one = mark if one is None else one.bitwiseOR(mark)
        fp.append(one)
    return votes.select(*keys, F.array(*fp).alias("fp"))


def fp_hex(fp: Column, bits: int = BITS) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(fp[k]), 16, "0") for k in range(bits // 64)]))


def distance(a: Column, b: Column, bits: int = BITS) -> Column:
    out = None
    for k in range(bits // 64):
        d = F.bit_count(a[k].bitwiseXOR(b[k]))
        out = d if out is None else out + d
    return out


def likeness(a: Column, b: Column, bits: int = BITS) -> Column:
    """Estimate of the weighted cosine of two texts' terms, 0 to 1: cos(pi * distance / bits)."""
    return F.greatest(F.lit(0.0), F.cos(distance(a, b, bits) * F.lit(3.141592653589793 / bits)))


def _table_keys(words: list[Column], bits: int, blocks: int, radius: int) -> list[Column]:
    """The key of a fingerprint (its longs) in each table: a hash of the chosen parts, a long."""
    cuts = [bits * k // blocks for k in range(blocks + 1)]
    parts = [((1 << cuts[k + 1]) - 1) ^ ((1 << cuts[k]) - 1) for k in range(blocks)]
    keys = []
    for pick in combinations(range(blocks), blocks - radius):
        chosen = sum(parts[k] for k in pick)
        masks = [(chosen >> (64 * w)) & 0xFFFFFFFFFFFFFFFF for w in range(len(words))]
        keys.append(F.xxhash64(*[word.bitwiseAND(F.lit(m if m < 1 << 63 else m - (1 << 64)))
                                 for word, m in zip(words, masks) if m]))
    return keys


def within(queries: DataFrame, table: DataFrame, radius: int = 3, blocks: int = 6, bits: int = BITS) -> DataFrame:
    """(fp, near_fp, bits_apart): for each distinct ``fp`` of queries all distinct ``fp`` of table within ``radius``."""
    words = range(bits // 64)

    def listed(df, name):
        longs = df.select("fp").distinct().select(*[F.col("fp")[k].alias(f"{name}{k}") for k in words])
        keys = _table_keys([F.col(f"{name}{k}") for k in words], bits, blocks, radius)
        return longs.select(*longs.columns, F.posexplode(F.array(*keys)).alias("t", "key"))

    met = listed(queries, "a").join(listed(table, "b"), ["t", "key"])
    one, two = ([F.col(f"{name}{k}") for k in words] for name in "ab")
    met = met.withColumn("bits_apart", sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(one[1:], two[1:])),
                                           F.bit_count(one[0].bitwiseXOR(two[0]))))
    # The first table in which the two have one key is the one that reports the pair.
    agree = zip(_table_keys(one, bits, blocks, radius), _table_keys(two, bits, blocks, radius))
    first = F.coalesce(*[F.when(x == y, F.lit(t)) for t, (x, y) in enumerate(agree)])
    return (met.filter(F.col("bits_apart") <= radius).filter(F.col("t") == first)
            .select(F.array(*one).alias("fp"), F.array(*two).alias("near_fp"), "bits_apart"))


def _ordered(documents: DataFrame, a_bucket: int = 1024) -> DataFrame:
    """(bucket, rn, doc_id, text, next_text, real): rows in ascending doc_id, dealt to buckets of near ids.

    A bucket ends with a copy of the first row of the next one (``real`` false), so that its last row finds its
    successor without a window over the whole table; the bounds are approximate quantiles of the ids.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"),
                            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = docs.count()
    wanted = max(1, min(4096, n // a_bucket))
    marks = [k / wanted for k in range(1, wanted)]
    bounds = docs.agg(F.percentile_approx("doc_id", marks, 10 * max(wanted, 100))).first()[0] if marks else None
    bounds = sorted(set(bounds or []))
    bound = F.array(*[F.lit(x) for x in bounds]) if bounds else None
    bucket = (F.size(F.filter(bound, lambda x: x < F.col("doc_id"))) if bounds else F.lit(0))
    dealt = docs.withColumn("bucket", F.when(F.col("doc_id").isNull(), 0).otherwise(bucket))
    # The least row of every bucket: ids first, texts only of those rows (equal ids: the least text).
    ids = dealt.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("real_id"), "doc_id")).alias("m"))
    ids = ids.select("bucket", "m.doc_id")
    around = Window.partitionBy(F.lit(0)).orderBy("bucket")
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = ids.select(F.col("doc_id").alias("first_id"), F.coalesce(F.lag("bucket").over(around),
                                                                      F.last("bucket").over(whole)).alias("to"))
    heads = (docs.join(F.broadcast(before), F.col("doc_id").eqNullSafe(F.col("first_id")))  # <= 4096 rows
             .groupBy("to", "doc_id").agg(F.min("text").alias("text")))
    rows = dealt.select("bucket", "doc_id", "text", F.lit(True).alias("real")).unionByName(
        heads.select(F.col("to").alias("bucket"), "doc_id", "text", F.lit(False).alias("real")))
    inside = Window.partitionBy("bucket").orderBy(F.col("real").desc(), F.col("doc_id").asc_nulls_first(), "text")
    return (rows.withColumn("rn", F.row_number().over(inside)).withColumn("next_text", F.lead("text").over(inside)))


def edited(text: Column, following: Column) -> Column:
    """The last floor(n / 2) characters replaced by as many first ones (or all) of the following text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def neighbours(documents: DataFrame, radius: int = 3, blocks: int = 6, bits: int = BITS) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    n_within (rows whose doc_id is divisible by 20: documents, itself left out, within ``radius`` bits; else null).
    """
    rows = _ordered(documents)
    key = ["bucket", "rn", "real", "doc_id", "n_chars", "edited_sha256"]
    change = edited(F.col("text"), F.col("next_text"))
    both = (rows.withColumn("edited", F.when(F.col("real"), change))
            .select("bucket", "rn", "real", "doc_id", F.length("text").cast("long").alias("n_chars"),
                    F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                    F.explode(F.when(F.col("real"), F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("t")),
                                                            F.struct(F.lit(1).alias("v"), F.col("edited").alias("t"))))
                              .otherwise(F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("t"))))).alias("x"))
            .select(*key, "x.v", F.col("x.t").alias("text")))
    fps = fingerprints(both, [*key, "v"], "text", bits)
    # Both fingerprints of a row, then the next row's, inside its bucket.
    paired = fps.groupBy("bucket", "rn").agg(
        *[F.first(c).alias(c) for c in key[2:5]], F.max("edited_sha256").alias("edited_sha256"),
        F.max(F.when(F.col("v") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("v") == 1, F.col("fp"))).alias("efp"))
    from tarmac.llm.common import stored
    inside = Window.partitionBy("bucket").orderBy("rn")
    done = stored(paired.withColumn("next_fp", F.lead("fp").over(inside)).filter("real"), "fingerprints")
    asked = done.filter(F.col("doc_id") % 20 == 0).select("fp")
    copies = done.groupBy("fp").agg(F.count("*").alias("n"))
    found = (within(asked, copies, radius, blocks, bits)
             .join(copies.withColumnRenamed("fp", "near_fp"), "near_fp").groupBy("fp").agg(F.sum("n").alias("n")))
    out = done.join(found, "fp", "left")
    return out.select("doc_id", "n_chars", "edited_sha256", fp_hex(F.col("fp"), bits).alias("fingerprint"),
                      fp_hex(F.col("efp"), bits).alias("edited_fingerprint"),
                      likeness(F.col("fp"), F.col("efp"), bits).alias("near_edited"),
                      likeness(F.col("fp"), F.col("next_fp"), bits).alias("near_next"),
                      F.when(F.col("doc_id") % 20 == 0, F.col("n") - 1).alias("n_within"))
