"""Language-model scoring by prediction by partial matching (PPM) over the running text.

A text is its ASCII-lower-cased words, each spelled as its bytes and a closing space, then one end symbol; a space and
start marks before it are context only. Contexts are the last 6 to 0 bytes, across words. Every context of the training
texts is kept, with the count of each symbol at each of its places. A symbol is coded from the longest context down: one
that was seen n times after a context, of whose symbols u are not yet excluded, with counts that sum to m, has
probability n / (m + u); else the escape u / (m + u) is coded, the symbols of the context are excluded from the shorter
ones and the next shorter context is asked (no escape where all 256 symbols are known). Below order 0 the symbols that
are left are equally likely. The probabilities after any context sum to one.

A gram is a symbol with its 6 bytes of context in one long, the nearest byte first, so that grams of one context are
neighbours. Scale: documents are dealt into blocks of ``BLOCK_BYTES``. Each block sends its distinct grams, with their
counts in its training rows, to the task that its last three bytes of context name; there the counts of all blocks meet,
so all longer contexts of a gram are in that task, and the costs go back to the block. Shorter contexts (at most 2 ** 24
counts, whatever the input) are broadcast. What a task holds are the packed requests for its grams and their distinct
ones. Words and their counts, for the base score, go the same way, to the task that their crc32 names.

Cases: null text counts as empty and is one end symbol; a null doc_id is a training row; repeated rows are scored
each; with no training rows the end has probability one half, the other symbols share the rest and the base score is 0;
an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import compress, groupby
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import stored, utf8

ORDER = 6  # bytes of context; a gram is a long, so no more
SYMBOLS = 256
MARK = 10  # no word holds a line feed: in contexts the places before the text, as a symbol its end
BLOCK_BYTES, BLOCK_DOCS = 16 << 20, 1 << 16
CHUNK = 1 << 20  # bytes that are looked at together
PART_BYTES = 6 << 20  # of compressed text, for each task that counts grams
PACK_BYTES = 1 << 17  # of the texts that are compressed together
ZSTD = 9
BLOCKS = "block long, doc_id array<long>, held_out array<boolean>, sizes binary, text binary"
REQUESTS = "part int, block long, grams binary, counts binary, words binary, word_counts binary"
ANSWERS = "block long, grams binary, costs binary, words binary, word_counts binary"
RESULT = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
          "score double")


def names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def running(text: bytes) -> bytes:
    """Start marks, the spelled words and the end; the first ``ORDER`` bytes are context only."""
    return b"\n" * (ORDER - 1) + b" ".join([b"", *text.lower().split(), b""]) + b"\n"


def grams_of(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The grams of all symbols of the running ``texts``, and where each text's begin (a text has one at least)."""
    a = np.frombuffer(b"".join(texts), np.uint8)
    lens = np.array([len(t) for t in texts], np.int64)
    n = len(a) - ORDER
    out = a[ORDER:].astype(np.int64)
    for back in range(1, ORDER + 1):
        near = a[ORDER - back:ORDER - back + n].astype(np.int64) if back <= order else np.int64(MARK)
        out |= near << (8 * (ORDER + 1 - back))
    use = np.ones(len(a), bool)
    starts = np.cumsum(lens) - lens
    use[(starts[:, None] + np.arange(ORDER)).ravel()] = False
    return out[use[ORDER:]], starts - ORDER * np.arange(len(texts))


def chunks(rows, most: int = CHUNK):
    """Lists of ``rows``, whose last value is a text, of about ``most`` bytes and few rows."""
    held, n = [], 0
    for r in rows:
        held.append(r)
        n += len(r[-1])
        if n >= most or len(held) >= 4096:
            yield held
            held, n = [], 0
    if held:
        yield held


def summed(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams, sorted, with the sums of their counts."""
    if not len(grams):
        return grams, counts
    order = np.argsort(grams, kind="stable")
    grams, counts = grams[order], counts[order]
    first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
    return grams[first], np.add.reduceat(counts, first)


def squeezed(data: bytes) -> bytes:
    """Compressed, with the size before: shuffles need not compress."""
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=ZSTD).compress(data, asbytes=True)


def whole(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def packed(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of whole numbers, byte by byte, which compresses well."""
    planes = np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return squeezed(planes.tobytes())


def unpacked(data: bytes, width: int) -> np.ndarray:
    data = whole(data)
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.reshape(-1).view("<i8")


def sorted_grams(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, ORDER + 1))


def blocks(documents: DataFrame, held_out: Column) -> DataFrame:
    """(block, doc_id, held_out, sizes, text): the running texts in blocks of neighbours, a row for some neighbours."""
    def run(batches):
        from pyspark import TaskContext

        place, size, docs = TaskContext.get().partitionId() << 32, 0, 0
        for some in chunks(((d, h, running(t)) for d, h, t in rows_of(batches, ["doc_id", "held_out", "text"])),
                           PACK_BYTES):
            ids, flags, texts = zip(*some)
            if size >= BLOCK_BYTES or docs >= BLOCK_DOCS:
                place, size, docs = place + 1, 0, 0
            sizes = np.array([len(t) for t in texts], np.int64)
            size, docs = size + int(sizes.sum()), docs + len(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([place], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                 pa.array([flags], pa.list_(pa.bool_())), pa.array([packed(sizes, 8)], pa.binary()),
                 pa.array([squeezed(b"".join(texts))], pa.binary())], names=names(BLOCKS))

    src = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"),
                           utf8().alias("text"))
    return stored(src.mapInArrow(run, BLOCKS), "ppm-blocks")


def texts_of(sizes: bytes, data: bytes) -> list[bytes]:
    ends, data = np.cumsum(unpacked(sizes, 8)).tolist(), whole(data)
    return [data[a:z] for a, z in zip([0, *ends], ends)]


def rows_of(batches, columns):
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in columns))


def by_block(batches):
    """(block, its rows (held_out, text)) of neighbours; a block that was read in two tasks comes twice."""
    for block, rows in groupby(rows_of(batches, ["block", "held_out", "sizes", "text"]), key=lambda r: r[0]):
        yield block, (x for _, out, sizes, data in rows for x in zip(out, texts_of(sizes, data)))


def requests_of(texts: DataFrame, parts: int, order: int = ORDER) -> DataFrame:
    """(part, block, grams, counts, words, word_counts): the distinct grams and words of each block, with their counts
    in its training rows."""
    def run(batches):
        for block, rows in by_block(batches):
            found, counts = np.empty(0, np.int64), np.empty(0, np.int64)
            held, words = [], Counter()
            for some in chunks(rows):
                for learn in (True, False):
                    texts = [t for out, t in some if out != learn]
                    if texts:
                        uniq, n = np.unique(grams_of(texts, order)[0], return_counts=True)
                        held.append((uniq, n if learn else np.zeros(len(n), np.int64)))
                    for t in texts:
                        if learn:
                            words.update(t.split())
                        else:
                            words.update(dict.fromkeys(t.split(), 0))
                if sum(len(h[0]) for h in held) > 4 * CHUNK:
                    found, counts = summed(*(np.concatenate(x) for x in zip((found, counts), *held)))
                    held = []
            found, counts = summed(*(np.concatenate(x) for x in zip((found, counts), *held)))
            # A multiplicative hash of the last three bytes of context.
            part = (((found >> 32) * 0x9E3779B1 & 0xFFFFFFFF) * parts >> 32).astype(np.int32)
            at = np.argsort(part, kind="stable")
            found, counts, part = found[at], counts[at], part[at]
            spelled = defaultdict(list)
            for w in words:
                spelled[crc32(w) % parts].append(w)
            for lo in range(0, parts, 256):  # parts of a batch
                number = sorted({*np.unique(part[slice(*np.searchsorted(part, (lo, lo + 256)))]).tolist(),
                                 *(p for p in range(lo, min(lo + 256, parts)) if p in spelled)})
                begin, end = np.searchsorted(part, number), np.searchsorted(part, number, "right")
                own = [sorted(spelled.get(p, ())) for p in number]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number, pa.int32()), pa.array(np.full(len(number), block, np.int64)),
                     pa.array([packed(np.diff(found[a:z], prepend=0), ORDER + 1) for a, z in zip(begin, end)],
                              pa.binary()),
                     pa.array([packed(counts[a:z], 4) for a, z in zip(begin, end)], pa.binary()),
                     pa.array([squeezed(b" ".join(ws)) for ws in own], pa.binary()),
                     pa.array([packed(np.array([words[w] for w in ws], np.int64), 4) for ws in own], pa.binary())],
                    names=names(REQUESTS))

    return stored(texts.mapInArrow(run, REQUESTS), "ppm-requests")


def by_part(requests: DataFrame, parts: int) -> DataFrame:
    return requests.repartition(parts, "part").sortWithinPartitions("part")


def word_totals(requests: DataFrame, parts: int) -> tuple[int, int]:
    """The words of the training rows: all and distinct ones."""
    def run(batches):
        for _, rows in groupby(rows_of(batches, ["part", "words", "word_counts"]), key=lambda r: r[0]):
            seen, n = set(), 0
            for _, words, counts in rows:
                counts = unpacked(counts, 4)
                n += int(counts.sum())
                seen.update(compress(whole(words).split(), (counts > 0).tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([len(seen)])], names=["n", "kinds"])

    got = by_part(requests.select("part", "words", "word_counts"), parts).mapInArrow(run, "n long, kinds long")
    return tuple(got.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "kinds")]).first())


def shorter(pairs: np.ndarray) -> np.ndarray:
    """(context, symbol) pairs without their farthest byte of context."""
    return (pairs >> 16) << 8 | pairs & 0xFF


class Level:
    """Pairs of a context of one order and a symbol, with the context's sums and what it excludes from the next."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray):
        self.pairs, self.counts = pairs, counts  # sorted; the counts may be 0
        self.first = np.flatnonzero(np.r_[True, pairs[1:] >> 8 != pairs[:-1] >> 8]) if len(pairs) else np.empty(0, int)
        self.of = np.repeat(np.arange(len(self.first)), np.diff(np.r_[self.first, len(pairs)]))
        self.total, self.kinds = self._sums(counts), self._sums((counts > 0).astype(np.int64))
        self.excluded = np.zeros(len(self.first), np.int64)  # counts after the shorter context of the symbols seen here

    def _sums(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.first) if len(self.first) else np.empty(0, np.int64)

    def exclude(self, below: np.ndarray) -> None:
        self.excluded = self._sums(np.where(self.counts > 0, below, 0))

    def rows(self) -> tuple[np.ndarray, ...]:
        """counts, total, kinds, excluded of each pair."""
        return self.counts, self.total[self.of], self.kinds[self.of], self.excluded[self.of]

    def look_up(self, pairs: np.ndarray) -> tuple[np.ndarray, ...]:
        """The same for other sorted pairs, 0 where unknown."""
        def found(known, wanted, values):
            if not len(known):
                return [np.zeros(len(wanted), np.int64) for _ in values]
            at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
            return [np.where(known[at] == wanted, v[at], 0) for v in values]

        return (*found(self.pairs, pairs, [self.counts]),
                *found(self.pairs[self.first] >> 8, pairs >> 8, [self.total, self.kinds, self.excluded]))


def low_levels(requests: DataFrame) -> list[Level]:
    """The levels of orders 0, 1 and 2, from all training rows; at most 2 ** 24 counts."""
    def run(batches):
        held = (np.empty(0, np.int64), np.empty(0, np.int64))
        for data, counts in rows_of(batches, ["grams", "counts"]):
            grams, n = sorted_grams(data), unpacked(counts, 4)
            grams, n = grams[n > 0], n[n > 0]
            held = summed(np.concatenate([held[0], (grams >> 40) << 8 | grams & 0xFF]), np.concatenate([held[1], n]))
        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], names=["pair", "n"])

    got = requests.select("grams", "counts").mapInArrow(run, "pair long, n long").groupBy("pair") \
        .agg(F.sum("n").alias("n")).toArrow()
    levels = [Level(*summed(got.column("pair").to_numpy(), got.column("n").to_numpy()))]
    for _ in range(2):
        top = levels[0]
        low = Level(*summed(shorter(top.pairs), top.counts))
        top.exclude(low.counts[np.searchsorted(low.pairs, shorter(top.pairs))])
        levels.insert(0, low)
    return levels


def gram_costs(grams: np.ndarray, counts: np.ndarray, low: list[Level]) -> np.ndarray:
    """log10 probability of each gram's symbol after its context.

    ``grams`` are sorted and distinct and hold all that have a count in training texts for their last three bytes.
    """
    rows: list[tuple] = []  # by order from the longest: counts, total, kinds, excluded of its pairs
    ups: list[np.ndarray] = []  # where a pair's shorter pair is among those of the next order
    pairs, n = grams, counts
    levels = []
    for k in range(ORDER, -1, -1):
        if k >= 3:
            levels.append(Level(pairs, n))
        else:
            rows_low = low[k].look_up(pairs)
            levels.append(rows_low)
            n = rows_low[0]
        if k:
            less, up = np.unique(shorter(pairs), return_inverse=True)
            ups.append(up)
            sums = np.bincount(up, weights=n, minlength=len(less)).astype(np.int64)  # whole numbers below 2 ** 53
            pairs, n = less, sums
    for i, level in enumerate(levels):
        if isinstance(level, Level):
            after = levels[i + 1]
            below = after.counts if isinstance(after, Level) else after[0]
            level.exclude(below[ups[i]])
            rows.append(level.rows())
        else:
            rows.append(level)
    known = rows[-1][2]  # of order 0
    ends = (pairs & 0xFF) == MARK
    cost = np.where(known > 0, -np.log10(np.maximum(SYMBOLS - known, 1)),
                    np.where(ends, np.log10(0.5), np.log10(0.5 / (SYMBOLS - 1))))
    for k in range(ORDER + 1):  # the order; its rows are asked from those of the next longer one, which excludes
        i = ORDER - k
        here = rows[i]
        n, total, kinds = (x[ups[i - 1]] if i else x for x in here[:3])
        below = cost[ups[i - 1]] if i else cost
        gone, taken = (rows[i - 1][2], rows[i - 1][3]) if i else (0, 0)
        left, new = total - taken, kinds - gone
        weight = np.maximum(left + np.where(kinds < SYMBOLS, new, 0), 1)
        escaped = np.where(new > 0, np.log10(np.maximum(new, 1) / weight), 0.0) + below
        cost = np.where(n > 0, np.log10(np.maximum(n, 1) / weight), escaped)
    return cost


def answers(requests: DataFrame, low: list[Level], parts: int) -> DataFrame:
    """(block, grams, costs, words, word_counts): the requests with the costs of their grams and the words' counts in
    all training rows."""
    shared = requests.sparkSession.sparkContext.broadcast(low)

    def run(batches):
        for _, rows in groupby(rows_of(batches, names(REQUESTS)), key=lambda r: r[0]):
            asked, held, known = [], [], Counter()
            grams, counts = np.empty(0, np.int64), np.empty(0, np.int64)
            for _, block, data, n, words, times in rows:
                asked.append((block, data, words))
                known.update(dict(zip(whole(words).split(), unpacked(times, 4).tolist())))
                held.append((sorted_grams(data), unpacked(n, 4)))
                if sum(len(h[0]) for h in held) > CHUNK + len(grams):
                    grams, counts = summed(*(np.concatenate(x) for x in zip((grams, counts), *held)))
                    held = []
            grams, counts = summed(*(np.concatenate(x) for x in zip((grams, counts), *held)))
            costs = gram_costs(grams, counts, shared.value)
            for block, data, words in asked:
                c = np.array([known[w] for w in whole(words).split()], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), pa.array([data], pa.binary()),
                     pa.array([squeezed(costs[np.searchsorted(grams, sorted_grams(data))].tobytes())], pa.binary()),
                     pa.array([words], pa.binary()), pa.array([packed(c, 8)], pa.binary())], names=names(ANSWERS))

    return by_part(requests, parts).mapInArrow(run, ANSWERS)


def score_documents(documents: DataFrame, folds: int = 10, order: int = ORDER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    The model learns from the rows whose crc32(doc_id) modulo ``folds`` is not 0 and scores all rows.
    """
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))
    texts = blocks(documents, out)
    size, learnt = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)),
                             F.coalesce(F.sum(F.size(F.filter("held_out", lambda out: ~out))), F.lit(0))).first()
    parts = max(2 * documents.sparkSession.sparkContext.defaultParallelism, size // PART_BYTES)
    requests = requests_of(texts, parts, order)
    answered = answers(requests, low_levels(requests), parts)
    n, kinds = word_totals(requests, parts)
    tokens, kinds = n + learnt, kinds + (learnt > 0)

    def base(c):
        return np.log10((np.asarray(c, float) + 0.1) / (tokens + 0.1 * (kinds + 1)))

    def run(batches):
        block, known, found = None, {}, []
        grams = cost = None

        def scored(rows):
            """Documents of one block."""
            nonlocal grams, cost
            if grams is None:
                grams, first = np.unique(np.concatenate([sorted_grams(g) for g, _ in found]), return_index=True)
                cost = np.concatenate([np.frombuffer(whole(c)) for _, c in found])[first]
                found.clear()
            for some in chunks(rows):
                texts = [t for _, _, t in some]
                own, starts = grams_of(texts, order)
                uniq, back = np.unique(own, return_inverse=True)
                score = np.add.reduceat(cost[np.searchsorted(grams, uniq)][back], starts)
                spelled = [t.split() for t in texts]
                lens = np.array([len(ws) for ws in spelled], np.int64)
                c = np.fromiter((known[w] for ws in spelled for w in ws), np.int64, int(lens.sum()))
                where = np.repeat(np.arange(len(texts)), lens)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d for d, _, _ in some], pa.int64()), pa.array([h for _, h, _ in some], pa.bool_()),
                     pa.array(lens + 1),
                     pa.array(np.bincount(where, weights=c > 0, minlength=len(texts)).astype(np.int64) + (learnt > 0)),
                     pa.array(np.full(len(texts), tokens, np.int64)),
                     pa.array(np.bincount(where, weights=base(c), minlength=len(texts)) + base(learnt)),
                     pa.array(score)], names=names(RESULT))

        for (number, is_text), rows in groupby(rows_of(batches, all_names), key=lambda r: r[:2]):
            if number != block:
                block, known, found, grams = number, {}, [], None
            if is_text:
                yield from scored(x for r in rows for x in zip(r[2], r[3], texts_of(r[4], r[5])))
            else:
                for *_, data, costs, words, counts in rows:
                    found.append((data, costs))
                    known.update(zip(whole(words).split(), unpacked(counts, 8).tolist()))

    all_names = ["block", "is_text", "doc_id", "held_out", "sizes", "text", "grams", "costs", "words", "word_counts"]
    sent = texts.withColumn("is_text", F.lit(True)) \
        .unionByName(answered.withColumn("is_text", F.lit(False)), allowMissingColumns=True)
    return sent.repartition(parts, "block").sortWithinPartitions("block", "is_text").mapInArrow(run, RESULT)
