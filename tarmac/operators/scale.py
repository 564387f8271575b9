"""Order-dependent primitives that stay distributed: running totals, row ids and
exact quantiles.

A window without ``partitionBy`` moves every row into one task. These helpers
use it only behind a proven size bound (``bounded``); above the bound they run
in two phases over range partitions:

1. ``repartitionByRange`` on the order key + ``sortWithinPartitions``, then a
   reliable ``checkpoint`` so both phases see the same partitions (and a lost
   executor does not re-draw the range bounds);
2. per-partition totals (one row per partition), their prefix sums over that
   tiny frame, broadcast back and added to the in-partition running values.

Ranks run over (value, count) rows, which a partial aggregate makes before any
shuffle, so a value that most rows share is one row there. Quantiles are selected
by rounds of counts over key prefixes (``select_ranks``), the same way at any size.
"""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.session import ensure_checkpoint_dir, stored

# Rows a single task may hold for a global window / exact percentile map.
SMALL_ROWS = 1_000_000
# Rows of a lookup table (products, classes, edges) we allow ourselves to broadcast.
BROADCAST_ROWS = 250_000
_POS_BITS = (1 << 33) - 1  # low bits of monotonically_increasing_id = position in partition


def small_rows(spark) -> int:
    """Row bound for single-task windows / exact percentile maps (``spark.tarmac.smallRows``)."""
    return int(spark.conf.get("spark.tarmac.smallRows", str(SMALL_ROWS)))


def broadcast_rows(spark) -> int:
    """Row bound for broadcasting a lookup table (``spark.tarmac.broadcastRows``)."""
    return int(spark.conf.get("spark.tarmac.broadcastRows", str(BROADCAST_ROWS)))


def bounded(df: DataFrame, limit: int | None = None) -> bool:
    """True when ``df`` has at most ``limit`` rows (a partial count; no row leaves its task)."""
    if limit is None:
        limit = small_rows(df.sparkSession)
    return df.count() <= limit


def fits_broadcast(df: DataFrame) -> bool:
    return bounded(df, broadcast_rows(df.sparkSession))


def maybe_broadcast(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint when its checked size allows, else unchanged (shuffle join)."""
    return F.broadcast(df) if fits_broadcast(df) else df


def heavy_keys(df: DataFrame, key: str) -> DataFrame:
    """The values of ``key`` that hold more than their even share of a task, as a one-column table ``key``.

    With p shuffle partitions a value is heavy above 1/p of the rows, so there are fewer than p of them. A sketch of
    frequent items, of which each task sends one, names all that may be heavy: it counts a value too high by at most
    1/(6p) of the rows and holds every one above that. Only their rows are counted exactly; no value is shuffled for it.
    """
    spark, parts = df.sparkSession, _parts(df)
    named = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("__k"))
    items = min(16 * parts, 1_000_000)  # the most that the sketch takes
    seen = named.agg(F.expr(f"approx_top_k(__k, {min(2 * parts, items)}, {items})").alias("top"),
                     F.count(F.lit(1)).alias("n")).first()
    schema = df.select(key).schema
    maybe = [(t["item"],) for t in seen.top or [] if t["count"] * parts > seen.n]  # counts are never too low
    if not maybe:
        return spark.createDataFrame([], schema)
    found = spark.createDataFrame(maybe, schema).withColumnRenamed(key, "__k")
    counts = named.join(F.broadcast(found), "__k").groupBy("__k").agg(F.count(F.lit(1)).alias("__n"))
    rows = [(r["__k"],) for r in counts.filter(F.col("__n") * parts > seen.n).collect()]
    return spark.createDataFrame(rows, schema)


def lookup_join(df: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``df`` left-joined to the table ``right`` by ``key``, of which ``right`` has each value once.

    A table within the checked bound is broadcast. Beyond it the join is split: rows of heavy values (and of null,
    which would all hash to one task) stay where they are and meet their few rows of ``right`` in a broadcast; the
    others meet in a shuffle, in which no value has more than an even share. Both parts are put together.
    """
    if fits_broadcast(right):
        return df.join(F.broadcast(right), key, "left")
    heavy = heavy_keys(df, key)
    hot_right = right.join(F.broadcast(heavy), key, "left_semi")
    is_hot = heavy.withColumn("__hot", F.lit(True))
    marked = df.join(F.broadcast(is_hot), key, "left")
    hot = marked.filter(F.col("__hot") | F.col(key).isNull()).drop("__hot").join(F.broadcast(hot_right), key, "left")
    rest = marked.filter(F.col("__hot").isNull() & F.col(key).isNotNull()).drop("__hot")
    return hot.unionByName(rest.join(right.hint("shuffle_hash"), key, "left"))


def _parts(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def _ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return (df.repartitionByRange(_parts(df), *order)
            .sortWithinPartitions(*order)
            .checkpoint(eager=True))


def running_total(df: DataFrame, order: list[Column], value: str, out: str,
                  total_out: str | None = None, small: bool | None = None) -> DataFrame:
    """Add the inclusive running sum of ``value`` in ``order`` (a total order:
    include a tie-break) as ``out``, and optionally the grand total as ``total_out``.
    """
    if small is None:
        small = bounded(df)
    if small:
        w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        res = df.withColumn(out, F.sum(value).over(w))
        if total_out:
            res = res.withColumn(total_out, F.sum(value).over(Window.partitionBy()))
        return res
    ranged = _ranged(df, order)
    kind = df.schema[value].dataType  # a decimal sum widens; back to its own type, sums of two keep every digit

    def summed(w=None):
        s = F.sum(value) if w is None else F.sum(value).over(w)
        return s.cast(kind) if isinstance(kind, T.DecimalType) else s

    local = ranged.withColumn("__rt_pid", F.spark_partition_id())
    w_local = Window.partitionBy("__rt_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = local.withColumn("__rt_local", summed(w_local))
    totals = ranged.groupBy(F.spark_partition_id().alias("__rt_pid")).agg(summed().alias("__rt_ptot"))
    w_off = Window.orderBy("__rt_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "__rt_pid",
        F.coalesce(F.sum("__rt_ptot").over(w_off), F.lit(0)).cast(totals.schema["__rt_ptot"].dataType).alias("__rt_off"),
        F.sum("__rt_ptot").over(Window.partitionBy()).alias("__rt_grand"),
    )
    res = local.join(F.broadcast(offsets), "__rt_pid").withColumn(out, F.col("__rt_off") + F.col("__rt_local"))
    if total_out:
        res = res.withColumn(total_out, F.col("__rt_grand"))
    return res.drop("__rt_pid", "__rt_local", "__rt_off", "__rt_grand")


def ordered_row_id(df: DataFrame, order: list[Column] | None, out: str = "row_id",
                   start: int = 1, small: bool | None = None) -> DataFrame:
    """Dense consecutive ids ``start, start+1, ...`` in ``order`` (a total order).

    With ``order=None`` the ids follow the current partition order of ``df``.
    """
    if small is None:
        small = bounded(df)
    if small and order:
        return df.withColumn(out, F.row_number().over(Window.orderBy(*order)) + F.lit(start - 1))
    if small:  # read order = (partition, position), captured before the single-task window
        mid = df.withColumn("__rt_mid", F.monotonically_increasing_id())
        return (mid.withColumn(out, F.row_number().over(Window.orderBy("__rt_mid")) + F.lit(start - 1))
                .drop("__rt_mid"))
    def placed(fixed):
        return fixed.withColumn("__rt_pid", F.spark_partition_id()) \
            .withColumn("__rt_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_POS_BITS)))

    if order:  # stored with their places, as sorted columns are far smaller than checkpointed rows
        local = stored(placed(df.repartitionByRange(_parts(df), *order).sortWithinPartitions(*order)), "row-ids")
    else:
        ensure_checkpoint_dir(df.sparkSession)
        local = placed(df.checkpoint(eager=True))
    counts = local.groupBy("__rt_pid").agg(F.count(F.lit(1)).alias("__rt_n"))
    w_off = Window.orderBy("__rt_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__rt_pid", F.coalesce(F.sum("__rt_n").over(w_off), F.lit(0)).alias("__rt_off"))
    return (local.join(F.broadcast(offsets), "__rt_pid")
            .withColumn(out, F.col("__rt_off") + F.col("__rt_pos") + F.lit(start))
            .drop("__rt_pid", "__rt_pos", "__rt_off"))


def _interp(points: dict[int, float], n: int, q: float) -> float:
    h = (n - 1) * q
    lo, hi = math.floor(h), math.ceil(h)
    a, b = points[lo], points[hi]
    return a + (h - lo) * (b - a)


def file_order_id(scan: DataFrame, out: str = "row_id", start: int = 0) -> DataFrame:
    """Add dense ids in file order (path, then place in the file) to a frame as it was read from files.

    Spark deals splits to tasks by size, so the order of tasks is not that of the files. A row's file, its split's
    first byte and its place in the split come from the scan. The splits' row counts (one row for each) give every split
    its offset; no row is sorted, stored or moved.
    """
    keyed = scan.select("*", F.col("_metadata.file_path").alias("__path"),
                        F.col("_metadata.file_block_start").alias("__start"),
                        F.monotonically_increasing_id().alias("__place"))
    splits = keyed.groupBy("__path", "__start").agg(F.count(F.lit(1)).alias("__n"), F.min("__place").alias("__first"))
    files = splits.groupBy("__path").agg(F.sum("__n").alias("__rows"))
    before = Window.orderBy("__path").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    files = files.select("__path", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__files"))
    inside = Window.partitionBy("__path").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("__before", F.coalesce(F.sum("__n").over(inside), F.lit(0))).join(files, "__path")
    offsets = offsets.select("__path", "__start", (F.col("__files") + F.col("__before") - F.col("__first") + start)
                             .alias("__offset"))
    return (keyed.join(offsets, ["__path", "__start"]).withColumn(out, F.col("__offset") + F.col("__place"))
            .drop("__path", "__start", "__place", "__offset"))


# Bits of the key that one round of the selection tells apart, and rows that the last round may bring to the driver.
KEY_BITS, SELECT_ROWS = 16, 100_000


def order_key(c: Column) -> Column:
    """A long whose order is that of the double ``c``: its bits, those of negative numbers turned round."""
    bits = F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"),
                           F.coalesce(c.cast("double"), F.lit(0.0)) + F.lit(0.0)).cast("long")
    key = F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit((1 << 63) - 1)))
    return F.when(c.isNotNull(), key)


def _value(key: int) -> float:
    bits = key if key >= 0 else key ^ ((1 << 63) - 1)
    return struct.unpack("<d", struct.pack("<q", bits))[0]


def select_ranks(df: DataFrame, wanted, keys: dict[str, Column]) -> dict[str, tuple[int, dict[int, float]]]:
    """Per column: (rows, {0-based rank: value}) for the ranks that ``wanted(column, rows)`` names.

    Radix selection: a round counts rows by the next ``KEY_BITS`` bits of the key (at most 2**KEY_BITS counts for each
    rank reach the driver, summed in the tasks before they meet) and keeps, for each rank, the prefix it falls into.
    Once the prefixes that are left hold at most ``SELECT_ROWS`` rows, or all bits are known, their values are counted
    one by one. No row is sorted or stored, and the rounds are at most 64 / KEY_BITS.
    """
    cols = list(keys)
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), k.alias("k"))
                                         for i, k in enumerate(keys.values())])).alias("x")).select("x.c", "x.k")
    long = long.filter(F.col("k").isNotNull())
    rows: dict[int, int] = {}
    ranks: dict[tuple[int, int], list[tuple[int, int]]] = {}  # (column, prefix): [(rank, rank within the prefix)]
    shift = 64
    while shift:
        held = None
        if ranks:
            held = F.lit(False)
            for c in {c for c, _ in ranks}:
                prefixes = [p for d, p in ranks if d == c]
                held |= (F.col("c") == c) & F.shiftright("k", shift).isin(prefixes)
        inside = long if held is None else long.filter(held)
        if ranks and sum(sizes[at] for at in ranks) <= SELECT_ROWS:
            step = shift  # the few rows that are left: all bits at once
        else:
            step = min(KEY_BITS, shift)
        shift -= step
        found = inside.groupBy("c", F.shiftright("k", shift).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
        counts: dict[tuple[int, int], list[tuple[int, int]]] = {}
        above = shift + step
        for r in found:
            counts.setdefault((r.c, r.p >> step if above < 64 else 0), []).append((r.p, r.n))
        if not ranks:
            rows = {c: sum(n for _, n in v) for (c, _), v in counts.items()}
            ranks = {(c, 0): [(k, k) for k in sorted(set(wanted(cols[c], n)))] for c, n in rows.items()}
        inner: dict[tuple[int, int], list[tuple[int, int]]] = {}
        sizes = {}
        for (c, p), targets in ranks.items():
            before, left = 0, sorted(targets, key=lambda t: t[1])
            for q, n in sorted(counts[c, p]):
                while left and left[0][1] < before + n:
                    rank, at = left.pop(0)
                    inner.setdefault((c, q), []).append((rank, at - before))
                    sizes[c, q] = n
                before += n
        ranks = inner
    out = {c: (0, {}) for c in cols}
    for c, n in rows.items():
        out[cols[c]] = n, {rank: _value(p) for (d, p), t in ranks.items() if d == c for rank, _ in t}
    return out


def exact_quantiles(df: DataFrame, probs: dict[str, list[float]]) -> dict[str, list[float]]:
    """Linear-interpolation quantiles (numpy's default) per column: ``{col: probs}``, by ``select_ranks``."""
    probs = {c: p for c, p in probs.items() if p}
    if not probs:
        return {}

    def wanted(c, n):
        return {p for q in probs[c] for p in (math.floor((n - 1) * q), math.ceil((n - 1) * q))}

    found = select_ranks(df, wanted, {c: order_key(F.col(c)) for c in probs})
    return {c: [_interp(at, n, q) for q in probs[c]] if n else [] for c, (n, at) in found.items()}


def average_rank_pct(df: DataFrame, value: str, out: str, small: bool | None = None) -> DataFrame:
    """pandas ``rank(pct=True)`` (average rank of ties divided by the row count).

    Distributed form: distinct values with counts, running count in value order,
    joined back on the value.
    """
    if small is None:
        small = bounded(df)
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_cnt")).filter(F.col(value).isNotNull())
    run = running_total(counts, [F.col(value).asc()], "_cnt", "_cum", "_all", small=small)
    ranks = run.select(value, ((F.col("_cum") - (F.col("_cnt") - 1) / 2.0) / F.col("_all")).alias(out))
    return df.join(ranks, value, "left")
