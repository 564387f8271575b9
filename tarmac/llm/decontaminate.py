"""Benchmark decontamination with a generalised suffix automaton.

The normalised test items (ASCII-lower-cased words of letters, digits and non-ASCII bytes) are put into one
generalised suffix automaton over word ids. Documents stream through it word by word; the automaton keeps the
length of the longest item substring that ends at each word. A length of ``window`` or more means that the last
``window`` words are a window of an item; an item shorter than the window must match whole, which the lengths of
the short items tell. The automaton is built in each Python worker from the items' words, which are broadcast in
blocks of at most ``BLOCK_WORDS`` words, so its size is bounded; a larger benchmark takes one pass over the texts
for every ``BLOCKS_A_PASS`` blocks.

Cases: null text has no words (never contaminated); repeated item ids are one item; items without words are
ignored; null item ids are ignored; an empty benchmark gives zero hits; extra columns pass through unless an output column has
their name.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.llm.common import add_arrays, extended, replace_columns, set_aside, utf8

BLOCK_WORDS = 100_000  # item words in one broadcast automaton (some 50 MB in a worker)
BLOCKS_A_PASS = 4
# Upper case to lower case, every other ASCII byte that is no letter or digit to a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
               for c in range(256))
OUT = {"n_words": T.LongType(), "n_hit": T.LongType(), "n_items": T.LongType(),
       "hit_items": T.ArrayType(T.StringType()), "hit_spans": T.ArrayType(T.ArrayType(T.LongType()))}


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Automaton:
    """Generalised suffix automaton of word-id sequences, with the window index for attribution."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.owners: dict[tuple, set[str]] = {}
        short = set()
        for name, words in items:
            seq = [self.ids.setdefault(w, len(self.ids)) for w in words]
            last = 0
            for c in seq:
                last = self._extend(last, c)
            if len(seq) < window:
                short.add(len(seq))
                self.owners.setdefault(tuple(seq), set()).add(name)
            for i in range(len(seq) - window + 1):
                self.owners.setdefault(tuple(seq[i:i + window]), set()).add(name)
        self.short = sorted(short, reverse=True)

    def _clone(self, p: int, q: int, c: int) -> int:
        n = len(self.length)
        self.length.append(self.length[p] + 1)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.link[q] = n
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = n
            p = self.link[p]
        return n

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, c)
        cur = len(self.length)
        self.length.append(self.length[last] + 1)
        self.next.append({})
        self.link.append(0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, c)
        return cur

    def match_lengths(self, ids: list) -> list[int]:
        """Length of the longest item substring ending at each position (None ids match nothing)."""
        nxt, link, length = self.next, self.link, self.length
        state = run = 0
        out = []
        add = out.append
        for c in ids:
            if c is None:
                state = run = 0
            else:
                to = nxt[state].get(c)
                if to is not None:
                    state = to
                    run += 1
                else:
                    while state and c not in nxt[state]:
                        state = link[state]
                    run = length[state]
                    to = nxt[state].get(c)
                    if to is None:
                        state = run = 0
                    else:
                        state = to
                        run += 1
            add(run)
        return out

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Disjoint hit spans [from, to) in word positions, and the items that have an occurring window."""
        ids = list(map(self.ids.get, words))
        least = min(self.window, self.short[-1] if self.short else self.window)
        runs = self.match_lengths(ids)
        if not runs or max(runs) < least:
            return [], set()
        spans, names = [], set()
        owners, window = self.owners, self.window
        for j in np.flatnonzero(np.array(runs) >= least).tolist():
            run, widest = runs[j], 0
            for n in ([window] if run >= window else []) + [s for s in self.short if s <= run]:
                got = owners.get(tuple(ids[j + 1 - n:j + 1]))
                if got:
                    widest = max(widest, n)
                    names |= got
            if widest:
                lo = j + 1 - widest
                while spans and spans[-1][1] >= lo:
                    lo = min(lo, spans.pop()[0])
                spans.append((lo, j + 1))
        return spans, names


@lru_cache(maxsize=BLOCKS_A_PASS)
def _automaton(items: tuple, window: int) -> Automaton:
    return Automaton([(n, list(w)) for n, w in items], window)


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS):
    """The distinct items as lists of (item_id, words), in blocks of at most ``block_words`` words (or one item)."""
    block, size = [], 0
    rows = (benchmark.select(F.col("item_id").cast("string").alias("i"), utf8().alias("t"))
            .filter("i IS NOT NULL").distinct().toLocalIterator())
    for row in rows:
        words = tuple(words_of(bytes(row["t"])))
        if not words:
            continue
        if block and size + len(words) > block_words:
            yield tuple(block)
            block, size = [], 0
        block.append((row["i"], words))
        size += len(words)
    if block:
        yield tuple(block)


def _merged(spans):
    out = []
    for lo, hi in sorted(map(list, spans)):
        if out and lo <= out[-1][1]:
            out[-1] = [out[-1][0], max(hi, out[-1][1])]
        else:
            out.append([lo, hi])
    return out


def mark(documents: DataFrame, benchmark: DataFrame, window: int = 13,
         block_words: int = BLOCK_WORDS) -> DataFrame:
    """``documents`` plus n_words, n_hit, n_items, hit_items (sorted ids) and hit_spans (word positions)."""
    spark = documents.sparkSession
    blocks = [spark.sparkContext.broadcast(b) for b in item_blocks(benchmark, block_words)]
    out = replace_columns(documents, [*OUT, "__utf8"])
    for at in range(0, max(len(blocks), 1), BLOCKS_A_PASS):
        out = _mark_pass(out, blocks[at:at + BLOCKS_A_PASS], window)
    return out


def _mark_pass(frame: DataFrame, blocks: list, window: int) -> DataFrame:
    """One pass over the texts; adds to the hits of the passes before."""
    base = replace_columns(frame, OUT)
    again = "hit_spans" in frame.columns
    cols = base.columns
    names_in = [*cols, *(["hit_items", "hit_spans"] if again else [])]

    def run(batches):
        for batch in batches:
            words = [words_of(t) for t in batch.column("__utf8").to_pylist()]
            spans = batch.column("hit_spans").to_pylist() if again else [[] for _ in words]
            names = [set(x) for x in batch.column("hit_items").to_pylist()] if again else [set() for _ in words]
            for b in blocks:
                auto = _automaton(b.value, window)
                for i, w in enumerate(words):
                    got, who = auto.hits(w)
                    if got:
                        spans[i] += got
                        names[i] |= who
            spans = [_merged(s) for s in spans]
            body = batch.select(cols)
            yield add_arrays(body, n_words=pa.array(map(len, words), pa.int64()),
                             n_hit=pa.array([sum(hi - lo for lo, hi in s) for s in spans], pa.int64()),
                             n_items=pa.array(map(len, names), pa.int64()),
                             hit_items=pa.array([sorted(n) for n in names], pa.list_(pa.string())),
                             hit_spans=pa.array(spans, pa.list_(pa.list_(pa.int64()))))

    given = frame.select(*[f"`{c}`" for c in names_in]).withColumn("__utf8", utf8())
    return given.mapInArrow(run, extended(base.schema, **OUT))


def contaminated(percent: int = 5):
    """Hit words reach ``percent`` of all words."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * percent)


def items_digest():
    return F.sha2(F.array_join("hit_items", ","), 256)


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = 13, percent: int = 5) -> DataFrame:
    """The documents that are not contaminated; columns as given, also those named as the marks."""
    given, back = set_aside(documents, [*OUT, "__utf8"])
    return mark(given, benchmark, window).filter(~contaminated(percent)).select(*back)


def cut_spans(documents: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """``mark`` plus clean_text: the text without its hit word spans (the rest byte for byte)."""
    marked = mark(documents, benchmark, window)

    def run(batches):
        for batch in batches:
            texts, spans = batch.column(batch.num_columns - 1).to_pylist(), batch.column("hit_spans").to_pylist()
            yield add_arrays(batch.select(batch.schema.names[:-1]),
                             clean_text=pa.array([_cut(t, s) for t, s in zip(texts, spans)]))

    base = replace_columns(marked, ["clean_text", "__utf8"])
    return base.withColumn("__utf8", utf8()).mapInArrow(run, extended(base.schema, clean_text=T.StringType()))


def _cut(text: bytes, spans) -> str:
    if not spans:
        return text.decode("utf-8", "replace")
    flat = text.translate(_TABLE)
    at, pos = [], 0
    for w in flat.split():
        pos = flat.index(w, pos)
        at.append((pos, pos + len(w)))
        pos += len(w)
    out, last = [], 0
    for lo, hi in spans:
        out.append(text[last:at[lo][0]])
        last = at[hi - 1][1]
    return b"".join([*out, text[last:]]).decode("utf-8", "replace")


def sha256_hex(ids) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
