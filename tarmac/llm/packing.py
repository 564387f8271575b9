"""Packing documents into as few token sequences as possible by a configuration linear program.

1. ``pieces``: texts become token ids (a public BPE vocabulary, an end id after each), documents longer than a sequence
   are cut, and every piece is stored with its length, its task and its number among the task's pieces of that length.
2. ``configurations``: the program sees the histogram of lengths only, at most ``length`` rows. A configuration says
   how many pieces of each length share a sequence; the program covers all pieces with the least sum of
   configurations. Multiplicative weights solve it: each length has a price that falls exponentially with the share of
   it that is covered; a knapsack dynamic program over the capacity finds the dearest configuration around every length
   at once, and those near the dearest of all gain weight.
3. ``rounded``: configurations are used as often as their whole weights say, then once each by falling fraction as long
   as pieces of their lengths remain; what is left goes to configurations built from the longest piece down, each
   used as often as it can be. Every piece gets a place. Multiplicative weights stop near the optimum, so what is left
   is about half of a large input; the figures are in README.
4. ``pack``: pieces of a length are numbered over all tasks by prefix sums of the tasks' counts, and the number says
   which configuration, which copy of it and which place is the piece's.

Scale: only the histogram and the plan pass the driver. The plan has at most ``most`` configurations and some for each
length, whatever the number of pieces; tasks look pieces up in it by binary search. Rows of one length (a third of all,
say) are never brought together: numbers come from (length, task) counts.

Cases: null or empty text is the end id alone, of length 1; null and repeated doc_ids and repeated rows are documents
like any other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.common import stored

VOCABULARY = "word_bpe_49k.json"  # of public_tokenizers
LENGTH = 2048
END = 0
CACHE = 400_000  # words a worker remembers as they stand in texts
STEMS = 1_200_000  # words a worker remembers as they were encoded
TOGETHER = 2000  # words encoded by one call
ROUNDS = 120  # of multiplicative weights
NEAR = 0.01  # configurations within this of the dearest gain weight
MOST = 20_000  # configurations kept of the program's solution
# Control characters that Python takes for white space and the vocabulary's split pattern does not.
_NOT_SPACE = "\x1c\x1d\x1e\x1f"
_POINTS = ".,;:!?"
_SIGN_POINT = re.compile(r"(?:[^\w\s]|_)[.,;:!?]")
_MARK = "\x01"
_LATIN = "\u0250"  # the letters before it are composed ones

_workers: dict[str, Tokenizer] = {}


class Tokenizer:
    """Ids of texts by the vocabulary's library, with a memory of words.

    The vocabulary drops white space and no token spans it, so a text's ids are those of its words. A letter or digit
    and a point after it are apart as well: an unknown word ``end.`` is looked up as ``end`` and ``.``, and ASCII letters
    by their lower case, which the vocabulary takes anyway. Unknown words are encoded together, a token of its own
    between them; those of Latin small letters only need no normalising or splitting and pass the bare model. Texts
    with characters that would break this are encoded as they are.
    """

    def __init__(self, name: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer as Library
        from tokenizers import pre_tokenizers as split

        self.library = Library.from_file(name if os.path.isabs(name) else public_tokenizers.path(name))
        self.bare = Library(self.library.model)
        self.bare.pre_tokenizer = split.Sequence([split.WhitespaceSplit(),
                                                  split.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.known: dict[str, bytes] = {}  # words as they stand in texts
        self.stems: dict[str, bytes] = {}  # what has been encoded

    def plain(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _together(self, library, mark: str, words: list[str]) -> None:
        sign = library.encode(mark, add_special_tokens=False).ids
        for at in range(0, len(words), TOGETHER):
            some = words[at:at + TOGETHER]
            joined = f" {mark} ".join(some)
            ids = np.array(library.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ids == sign[0]) if len(sign) == 1 else ()
            if len(cuts) != len(some) - 1:  # another vocabulary: the mark is not one token of its own
                self.stems.update((s, self.plain(s)) for s in some)
                continue
            body, ends = ids.tobytes(), (4 * cuts).tolist()
            for s, a, b in zip(some, [-4, *ends], [*ends, len(body)]):
                self.stems[s] = body[a + 4:b]

    def _learn(self, stems) -> None:
        bare, full = [], []
        for s in stems:
            if s.isalpha() and (s.isascii() or max(s) < _LATIN) and s == s.lower():
                bare.append(s)
            elif _MARK in s or "<" in s:
                self.stems[s] = self.plain(s)
            else:
                full.append(s)
        self._together(self.bare, "!", bare)
        self._together(self.library, _MARK, full)

    def _split(self, text: str) -> list[str] | None:
        if any(c in text for c in _NOT_SPACE):
            return None
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text.split()
        # Without marks to compose and signs before a point, points can be set apart and letters made small at once.
        if not _SIGN_POINT.search(text):
            text = text.lower()
            for p in _POINTS:
                if p in text:
                    text = text.replace(p, " " + p)
        return text.split()

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian uint32."""
        split = list(map(self._split, texts))
        known, stems = self.known, self.stems
        if len(known) > CACHE:
            known.clear()
        if len(stems) > STEMS:
            stems.clear()
        whole, halves, missing = [], [], set()
        for w in set().union(*(w for w in split if w)).difference(known):
            s = w.rstrip(_POINTS)
            low = s.lower() if s.isascii() else s
            if low and low != w and (len(s) == len(w) or s[-1].isascii() and s[-1].isalnum()):
                halves.append((w, low, w[len(s):]))
                missing.add(low)
            else:
                whole.append(w)
        missing.update(whole)
        missing.update({p for _, _, p in halves if p})
        self._learn(missing.difference(stems))
        for w in whole:
            known[w] = stems[w]
        for w, a, b in halves:
            known[w] = stems[a] + stems[b] if b else stems[a]
        return [self.plain(t) if w is None else b"".join(map(known.__getitem__, w)) for t, w in zip(texts, split)]


def _tokenizer(name: str) -> Tokenizer:
    if name not in _workers:
        _workers[name] = Tokenizer(name)
    return _workers[name]


def pieces(documents: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, nth): nth numbers the task's pieces of one length."""
    def run(batches):
        from pyspark import TaskContext

        task, tok, seen = TaskContext.get().partitionId(), _tokenizer(vocabulary), np.zeros(length + 1, np.int64)
        last, size = np.array([end], "<u4").tobytes(), 4 * length

        def rows(ids, texts):
            out = []
            for doc, body in zip(ids, tok.ids(texts)):
                body += last
                for n, at in enumerate(range(0, len(body), size)):
                    part = body[at:at + size]
                    k = len(part) // 4
                    out.append((doc, n, at // 4, k, zlib.crc32(part), task, int(seen[k])))
                    seen[k] += 1
            cols = list(zip(*out)) or [[]] * 7
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                              names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

        for b in batches:
            ids, texts, held = [], [], 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids.append(doc)
                texts.append(text.as_py())
                held += len(texts[-1])
                if held > 1 << 20:
                    yield rows(ids, texts)
                    ids, texts, held = [], [], 0
            yield rows(ids, texts)

    src = documents.select(F.col("doc_id").cast("long").alias("doc_id"),
                           F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return src.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long")


def _knapsack(price: np.ndarray, sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(value, choice) by capacity 0..room: the dearest multiset of ``sizes`` that fits, and one size of it (0: none)."""
    value, choice = np.zeros(room + 1), np.zeros(room + 1, np.int64)
    for c in range(1, room + 1):
        fit = sizes[:np.searchsorted(sizes, c, "right")]
        value[c], choice[c] = value[c - 1], -1  # -1: as with one less room
        if len(fit):
            worth = value[c - fit] + price[:len(fit)]
            best = len(fit) - 1 - int(np.argmax(worth[::-1]))  # of equals the longest: short pieces fill later gaps
            if worth[best] >= value[c]:
                value[c], choice[c] = worth[best], fit[best]
    return value, choice


def _around(size: int, choice: np.ndarray, room: int) -> tuple[int, ...]:
    """The knapsack's configuration that holds a piece of ``size``, lengths falling."""
    items, free = [size], room - size
    while free > 0:
        s = int(choice[free])
        if s > 0:
            items.append(s)
        free -= max(s, 1)
    return tuple(sorted(items, reverse=True))


def configurations(sizes, counts, room: int = LENGTH, rounds: int = ROUNDS, near: float = NEAR,
                   most: int = MOST) -> dict[tuple[int, ...], float]:
    """{configuration (falling lengths): weight}: a fractional cover of ``counts`` pieces of ``sizes``."""
    sizes, counts = np.asarray(sizes, np.int64), np.asarray(counts, np.float64)
    weight: dict[tuple[int, ...], float] = {}
    if not len(sizes):
        return weight
    covered = np.zeros(len(sizes))  # share of each length
    at = {int(s): i for i, s in enumerate(sizes)}
    rate = np.log(len(sizes) + 1.0) + 1.0
    for _ in range(rounds):
        price = sizes * np.exp(-rate * (covered - covered.min()))
        value, choice = _knapsack(price, sizes, room)
        whole = price + value[room - sizes]
        chosen: dict[tuple[int, ...], None] = {}
        for i in np.flatnonzero(whole >= (1 - near) * whole.max()).tolist():
            chosen[_around(int(sizes[i]), choice, room)] = None
        use = np.zeros(len(sizes))
        for p in chosen:
            for s in p:
                use[at[s]] += 1
        # So much that no share grows by more than a part of what a price's exponent can bear.
        step = float((counts[use > 0] / use[use > 0]).min()) / rate
        for p in chosen:
            weight[p] = weight.get(p, 0.0) + step
        covered += step * use / counts
    scale = float(sizes @ counts) / sum(x * sum(p) for p, x in weight.items())
    best = sorted(weight.items(), key=lambda e: (-e[1], e[0]))[:most]
    return {p: x * scale for p, x in best}


def rounded(sizes, counts, weight: dict[tuple[int, ...], float], room: int = LENGTH) -> list[tuple[tuple, int]]:
    """[(configuration, sequences)] that hold every piece once.

    Configurations that waste more than the program's mean may better be left to the last step; both ways are tried.
    """
    whole = sum(weight.values())
    mean = int(room - sum(x * sum(p) for p, x in weight.items()) / whole) if whole else 0
    plans = [_rounded(sizes, counts, [p for p in weight if room - sum(p) <= most], weight, room)
             for most in sorted({mean, room})]
    return min(plans, key=lambda plan: sum(n for _, n in plan))


def _rounded(sizes, counts, order, weight, room):
    left = {int(s): int(n) for s, n in zip(sizes, counts) if n > 0}
    plan: dict[tuple[int, ...], int] = {}

    def use(p, times):
        if times > 0:
            plan[p] = plan.get(p, 0) + times
            for s in p:
                left[s] -= times

    def possible(p):
        return min(left.get(s, 0) // p.count(s) for s in set(p))

    for p in sorted(order, key=lambda p: (-weight[p], p)):
        use(p, min(int(weight[p]), possible(p)))
    for p in sorted(order, key=lambda p: (int(weight[p]) - weight[p], p)):
        use(p, min(1, possible(p)))
    # The rest: the longest piece and, again and again, the longest that fits beside it.
    rest = sorted(s for s, n in left.items() if n)
    while rest:
        items, free, i = {}, room, len(rest) - 1
        while i >= 0:
            s = rest[i]
            n = min(free // s, left[s])
            if n:
                items[s] = n
                free -= n * s
            i = min(i, bisect.bisect_right(rest, free)) - 1
        use(tuple(s for s, n in items.items() for _ in range(n)), min(left[s] // n for s, n in items.items()))
        rest = [s for s in rest if left[s]]
    return list(plan.items())


def _places(plan: list[tuple[tuple, int]], room: int):
    """The plan by length: where a length's ranks begin, and per entry of a length its first rank, copies in a
    sequence, first sequence and offset."""
    first, rows = 0, []
    for p, times in plan:
        offset = 0
        for s in dict.fromkeys(p):
            n = p.count(s)
            rows.append((s, n, times, first, offset))
            offset += n * s
        first += times
    rows.sort(key=lambda r: (r[0], r[3]))
    size, each, times, sequence, offset = (np.array(c, np.int64) for c in (zip(*rows) if rows else [[]] * 5))
    upto = np.cumsum(each * times)
    low = upto - each * times
    begin = np.zeros(room + 1, np.int64)
    known, at = np.unique(size, return_index=True)
    begin[known] = low[at]
    return begin, low, each, sequence, offset


def pack(documents: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY, end: int = END,
         rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    cut = stored(pieces(documents, length, vocabulary, end), "pieces")
    by_task = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    counted = by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most ``length`` rows
    counts = {r.length: r.n for r in counted}
    short = sorted(s for s in counts if s < length)
    weight = configurations(short, [counts[s] for s in short], length, rounds)
    plan = rounded(short, [counts[s] for s in short], weight, length)
    plan += [((length,), counts[length])] if length in counts else []
    spark = documents.sparkSession
    table = spark.sparkContext.broadcast(_places(plan, length))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = by_task.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))

    def place(batches):
        begin, low, each, sequence, offset = table.value
        for b in batches:
            size, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            e = np.searchsorted(low, begin[size] + rank, "right") - 1
            copy, nth = np.divmod(begin[size] + rank - low[e], each[e])
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(sequence[e] + copy), pa.array(offset[e] + nth * size)],
                names=[*b.schema.names[:5], "sequence_id", "offset"])

    ranked = cut.join(before, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32",
                                                         (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, "
                                    "sequence_id long, offset long")
