"""Phrase collocations from depth-truncated suffix trees, partitioned by word prefix (after ERA).

1. ``word_counts``: occurrences of every (lang, word), counted per task, then added. A word is known by a 64-bit hash
   of lang and word from here on; ``words`` proves that no two words share one, and takes another seed if they do.
2. ``suffixes``: a phrase with ``least`` occurrences holds only words with as many, so a suffix (a word and up to four
   after it in its piece) ends before the first rarer word. Equal suffixes of a task are counted together. A suffix
   belongs to a prefix: its first word, or, where that has more occurrences than fit a group's memory budget, the
   words up to the first that has not (vertical partitioning). Prefixes are dealt into groups of about half of ``BUDGET``
   suffixes, and a task sends each group one packed block. A node above the prefixes, all of whose words are too
   frequent for one group, is counted by the tasks and sent as a leaf of its own to the node's group.
3. ``subtree``: each group is sorted and its depth-truncated suffix trees are cut out of the order: a node is a run of
   equal first words and its count the sum of the leaves below; a node above the prefixes has its own leaf.
4. ``score``: the cuts of each phrase meet the counts of both parts in joins; decimal arithmetic is exact.

Which words are frequent, and which too frequent for a group, the tasks know from two bit maps of fixed size. A wrong
hit there costs a few more suffixes or a longer prefix, never a count. In a block the ``KNOWN`` most frequent words
are numbers that all tasks know, the others numbers in the block's own list of hashes. Python workers hold one flush
or one group.

Cases: null text is empty; null lang is ``und``; null or repeated doc_ids do not matter, every row counts; an empty
table or no phrase that often gives an empty result; long texts are read in parts cut at spaces; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.common import LOWER, UPPER, stored, utf8

LEAST = 100  # occurrences of a candidate
WORDS = 5  # words of the longest phrase
TOP = 2000  # phrases of a lang
BUDGET = 2_000_000  # suffixes a group may hold
FLUSH = 1_000_000  # words a task gathers before it sends them
HELD = 500_000  # distinct words a task remembers
PART = 1 << 20  # bytes of a text split at once
KNOWN = 1 << 17  # words whose numbers all tasks know
BITS = 22  # bit maps of 2**BITS bits
CODE = 21  # bits of a word's number within a flush; three words fill a sort key
_TABLE = bytes.maketrans((UPPER + ".,;:!?\x0b\x0c\r\t").encode(), (LOWER + "\n" * 9 + " ").encode())


def parts(text: bytes):
    """The words of a text, bytes, in parts; a line feed stands between pieces, empty strings mean nothing."""
    text, at = text.translate(_TABLE), 0
    while at < len(text):
        end = text.find(b" ", at + PART)
        end = len(text) if end < 0 else end
        yield text[at:end].replace(b"\n", b" \n ").split(b" ")
        at = end


def hasher(lang: str, seed: int):
    """A word's hash (unsigned, never 0) in ``lang``."""
    import xxhash

    own, digest = xxhash.xxh64_intdigest(lang.encode(), seed), xxhash.xxh64_intdigest
    return lambda word: digest(word, own) or 1


def texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), utf8().alias("text"))


def word_counts(documents: DataFrame, seed: int = 0) -> DataFrame:
    """(h, lang, word binary, f) of every word of every lang."""
    def run(batches):
        from collections import Counter

        held, size = {}, 0

        def rows():
            for lang, counts in held.items():
                counts.pop(b"", None)
                counts.pop(b"\n", None)
                h = hasher(lang, seed)
                keys = np.array([h(w) for w in counts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array([lang] * len(counts), pa.string()),
                     pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
                    names=["h", "lang", "word", "f"])

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                counts = held.setdefault(lang, Counter())
                before = len(counts)
                for words in parts(text.as_py()):
                    counts.update(words)
                size += len(counts) - before
                if size > HELD:
                    yield from rows()
                    held, size = {}, 0
        yield from rows()

    counted = texts(documents).mapInArrow(run, "h long, lang string, word binary, f long")
    # The task's counts are its partial sums: they go straight to the words' partitions.
    return counted.repartition("h").groupBy("h", "lang", "word").agg(F.sum("f").alias("f"))


def words(documents: DataFrame) -> tuple[DataFrame, int]:
    """``word_counts`` stored, with the seed under which no two words share a hash."""
    for seed in range(8):
        found = stored(word_counts(documents, seed), "phrase-words")
        if found.groupBy("h").count().filter("count > 1").isEmpty():
            return found, seed
    raise ArithmeticError("no seed tells all words apart")


def bit_map(hashes: DataFrame, bits: int = BITS) -> np.ndarray:
    """2**bits bits (as uint64) with the bit of every ``h`` set; at most 2**bits / 64 rows reach the driver."""
    cells = (hashes.select(F.shiftrightunsigned("h", 6).bitwiseAND((1 << bits - 6) - 1).alias("cell"),
                           F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"))
             .groupBy("cell").agg(F.bit_or("bit").alias("bit")).toArrow())
    out = np.zeros(1 << bits - 6, np.uint64)
    out[cells.column("cell").to_numpy()] = cells.column("bit").to_numpy().view(np.uint64)
    return out


def _marked(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    cell = (h >> np.uint64(6)) & np.uint64(len(bits) - 1)
    return (bits[cell.astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1) == 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sorted_runs(rows: np.ndarray, times: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``rows`` (words x suffixes of numbers below ``top``) in order, with their summed ``times``."""
    keys = []
    if top < 1 << CODE:
        for i in range(0, len(rows), 3):
            key = np.zeros(rows.shape[1], np.int64)
            for r in rows[i:i + 3]:
                key = key << CODE | r
            keys.append(key)
    else:
        keys = list(rows)
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = False
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    starts = np.flatnonzero(new)
    return rows[:, order[starts]], np.add.reduceat(times[order], starts) if len(starts) else times[:0]


class _Codes(dict):
    """Word -> number among the frequent words of the flush, 0 for a break, -1 for nothing."""

    def __init__(self, lang: str, seed: int, frequent: np.ndarray, hashes: list):
        super().__init__({b"": -1, b"\n": 0})
        self.hash, self.frequent, self.hashes = hasher(lang, seed), frequent, hashes
        self.mask = len(frequent) - 1

    def __missing__(self, word):
        h = self.hash(word)
        code = 0
        if int(self.frequent[h >> 6 & self.mask]) >> (h & 63) & 1:
            code = len(self.hashes)
            self.hashes.append(h)
        self[word] = code
        return code


class Known:
    """Numbers from 1 for the most frequent words, the most frequent first; 0 stands for the end of a suffix."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.concatenate([np.zeros(1, np.uint64), hashes])
        self.order = np.argsort(self.hashes, kind="stable")
        self.sorted = self.hashes[self.order]

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 where it has none."""
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        return np.where(self.sorted[at] == h, self.order[at], -1)


def _planes(x: np.ndarray) -> bytes:
    """uint32 numbers byte by byte: the high ones, mostly zero, together."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplaned(body: bytes, n: int, at: int) -> np.ndarray:
    return np.frombuffer(body, np.uint8, 4 * n, at).reshape(4, n).T.copy().view("<u4")[:, 0].astype(np.int64)


def packed(codes: np.ndarray, hashes: list, hot: np.ndarray, known: Known, groups: int, length: int):
    """(group, suffixes, words, block) of the suffixes of a run of word numbers."""
    codes = codes[codes >= 0]
    padded = np.concatenate([codes, np.zeros(length, codes.dtype)]).astype(np.int64)
    rows = np.stack([padded[i:len(codes) + i] for i in range(length)])
    for i in range(1, length):
        rows[i][rows[i - 1] == 0] = 0
    rows = rows[:, (rows[0] > 0) & (rows[1] > 0)]  # a lone word says nothing beyond its count
    if not rows.shape[1]:
        return
    rows, times = _sorted_runs(rows, np.ones(rows.shape[1], np.int64), len(hashes))
    h = np.array(hashes, np.uint64)
    often = _marked(hot, h)
    often[0] = False
    # Nodes whose words are all too frequent: each becomes one leaf, in place of the suffixes that end there.
    over, tops = np.ones(rows.shape[1], bool), []
    for i in range(length - 1):
        over &= often[rows[i]]
        if i and over.any():
            part = rows[:, over].copy()
            part[i + 1:] = 0
            tops.append(_sorted_runs(part, times[over], len(hashes)))
    ended = (often[rows] | (rows == 0)).all(axis=0) & (rows[-1] == 0)
    rows = np.concatenate([rows[:, ~ended], *(r for r, _ in tops)], axis=1)
    times = np.concatenate([times[~ended], *(t for _, t in tops)])
    key, longer = _mix(h[rows[0]]), often[rows[0]]
    for i in range(1, length):
        longer &= rows[i] > 0
        key[longer] = _mix(key[longer] ^ (h[rows[i][longer]] * np.uint64(0x9E3779B97F4A7C15)))
        longer &= often[rows[i]]
    number = known.numbers(h)
    group = (key % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    ends = np.flatnonzero(np.diff(group[order], append=-1)) + 1
    press, at = zstandard.ZstdCompressor(level=3).compress, 0
    for end in ends.tolist():
        of = order[at:end]
        places = number[rows[:, of]]
        rare, at_rare = np.unique(rows[:, of][places < 0], return_inverse=True)
        places[places < 0] = len(known.hashes) + at_rare
        block = h[rare].astype("<u8").tobytes() + _planes(places.ravel()) + _planes(times[of])
        yield int(group[of[0]]), end - at, len(rare), press(block)
        at = end


def suffixes(documents: DataFrame, seed: int, frequent: np.ndarray, hot: np.ndarray, known: np.ndarray, groups: int,
             length: int = WORDS, flush: int = FLUSH) -> DataFrame:
    """(grp, n, m, block): the counted suffixes of each task, by group of prefixes."""
    sc = documents.sparkSession.sparkContext
    maps = sc.broadcast((frequent, hot, known))

    def run(batches):
        often, over, top = maps.value
        top = Known(top)
        hashes, dicts, runs, size = [0], {}, [], 0

        def rows():
            found = list(packed(np.concatenate(runs), hashes, over, top, groups, length)) if runs else []
            cols = list(zip(*found)) or [[]] * 4
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                names=["grp", "n", "m", "block"])

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                codes = dicts.get(lang)
                if codes is None:
                    codes = dicts[lang] = _Codes(lang, seed, often, hashes)
                for found in parts(text.as_py()):
                    runs.append(np.fromiter(map(codes.__getitem__, found), np.int32, len(found)))
                    size += len(found)
                runs.append(np.zeros(1, np.int32))
                if size > flush:
                    yield rows()
                    runs, size = [], 0
                    if sum(map(len, dicts.values())) > HELD:
                        hashes, dicts = [0], {}
        yield rows()

    return texts(documents).mapInArrow(run, "grp long, n long, m long, block binary")


def subtree(blocks: list, hot: np.ndarray, top: Known, least: int,
            length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Nodes with ``least`` or more of a group's trees by depth from 2: (hashes, depth x nodes; counts)."""
    expand = zstandard.ZstdDecompressor().decompress
    names, places, times, held = [top.hashes], [], [], len(top.hashes)
    for n, m, block in blocks:
        body = expand(block)
        names.append(np.frombuffer(body, "<u8", m))
        at = _unplaned(body, n * length, 8 * m)
        at[at >= len(top.hashes)] += held - len(top.hashes)
        places.append(at.reshape(length, n))
        times.append(_unplaned(body, n, 8 * m + 4 * n * length))
        held += m
    places, names = np.concatenate(places, axis=1), np.concatenate(names)
    used, places = np.unique(places, return_inverse=True)
    known, number = np.unique(np.concatenate([np.zeros(1, np.uint64), names[used]]), return_inverse=True)
    rows, total = _sorted_runs(number[1:][places.reshape(length, -1)], np.concatenate(times), len(known))
    often = _marked(hot, known)
    often[0] = False
    out, new, over = [], np.zeros(rows.shape[1], bool), np.ones(rows.shape[1], bool)
    new[:1] = True
    for depth in range(1, length + 1):
        row = rows[depth - 1]
        new[1:] |= row[1:] != row[:-1]
        over &= often[row]
        if depth == 1:
            continue
        starts = np.flatnonzero(new)
        count = np.add.reduceat(total, starts)
        if depth < length:  # a node above the prefixes: its own leaf, first in order, if it is in this group
            own = np.where(rows[depth, starts] == 0, total[starts], 0)
            count = np.where(over[starts], own, count)
        keep = (row[starts] > 0) & (count >= least)
        out.append((known[rows[:depth, starts[keep]]], count[keep]))
    return out


def phrases(documents: DataFrame, seed: int, found: DataFrame, least: int = LEAST, length: int = WORDS,
            budget: int = BUDGET, flush: int = FLUSH, known: int = KNOWN) -> DataFrame:
    """(words array<long>, a): every phrase of 2 to ``length`` words with ``least`` occurrences, as word hashes."""
    often = found.filter(F.col("f") >= least)
    total = often.agg(F.sum("f")).first()[0] or 0
    spark = documents.sparkSession
    groups = max(-(-2 * total // budget), int(spark.conf.get("spark.sql.shuffle.partitions")))
    frequent = bit_map(often)
    hot = bit_map(often.filter(F.col("f") > max(budget // 16, 1)))
    top = often.orderBy(F.col("f").desc(), "h").limit(known).select("h").toArrow().column("h").to_numpy().view(np.uint64)
    blocks = suffixes(documents, seed, frequent, hot, top, groups, length, flush)
    maps = spark.sparkContext.broadcast((hot, top))

    def build(table):
        over, words = maps.value
        nodes = subtree(list(zip(*(table.column(c).to_pylist() for c in ("n", "m", "block")))), over, Known(words),
                        least, length)
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, h.size + 1, len(h)), pa.int32()),
                                          pa.array(np.ascontiguousarray(h.T).ravel().view(np.int64)))
                 for h, _ in nodes]
        return pa.table({"words": pa.chunked_array(lists, pa.list_(pa.int64())),
                         "a": pa.chunked_array([pa.array(c) for _, c in nodes], pa.int64())})

    return blocks.groupBy("grp").applyInArrow(build, "words array<long>, a long")


def score(found: DataFrame, counted: DataFrame, least: int = LEAST) -> DataFrame:
    """(words, a, l, r, n, score, lang) of the candidates that no longer one with as many occurrences holds.

    ``found`` is the stored word table, ``counted`` the stored phrases. Of a phrase inside a longer one with the same
    count, the phrases between the two have that count as well, so one word more on either side is enough to look at.
    """
    often = found.filter(F.col("f") >= least)
    sizes = found.groupBy("lang").agg(F.sum("f").alias("n"))
    known = counted.unionByName(often.select(F.array("h").alias("words"), F.col("f").alias("a")))
    longer = (counted.filter(F.size("words") > 2)
              .select(F.explode(F.array(F.expr("slice(words, 1, size(words) - 1)"),
                                        F.expr("slice(words, 2, size(words) - 1)"))).alias("words"),
                      F.col("a").alias("within")).groupBy("words").agg(F.max("within").alias("within")))
    left = counted.join(longer, "words", "left").filter(F.coalesce(100 * F.col("within") < 100 * F.col("a"),
                                                                   F.lit(True))).drop("within")
    left = (left.join(often.select(F.col("h").alias("__h"), "lang"), F.col("words")[0] == F.col("__h")).drop("__h")
            .join(sizes, "lang"))
    cuts = left.select("*", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": F.expr("slice(words, 1, k)"),
                             "rest": F.expr("slice(words, k + 1, size(words) - k)")})
    cuts = (cuts.join(known.select(F.col("words").alias("first"), F.col("a").alias("l")), "first")
            .join(known.select(F.col("words").alias("rest"), F.col("a").alias("r")), "rest"))
    value = F.expr("cast(1000 * cast(a as decimal(19,0)) * cast(n as decimal(19,0))"
                   " div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) as long)")
    best = F.min(F.struct(value.alias("score"), "k", "l", "r"))
    return (cuts.groupBy("words", "a", "n", "lang").agg(best.alias("cut"))
            .select("words", "a", "cut.l", "cut.r", "n", "cut.score", "lang"))


def mine(documents: DataFrame, least: int = LEAST, length: int = WORDS, top: int = TOP, budget: int = BUDGET,
         flush: int = FLUSH, known: int = KNOWN) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` collocations of each lang."""
    found, seed = words(documents)
    counted = stored(phrases(documents, seed, found, least, length, budget, flush, known), "phrase-counts")
    scored = score(found, counted, least)
    spelled = (scored.select("*", F.posexplode("words").alias("at", "h"))
               .join(found.filter(F.col("f") >= least).select("h", F.col("word").cast("string").alias("word")), "h")
               .groupBy("words", "a", "l", "r", "n", "score", "lang")
               .agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("spelling")))
    named = spelled.withColumn("phrase", F.concat_ws(" ", F.transform("spelling", lambda s: s["word"])))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    return (named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
