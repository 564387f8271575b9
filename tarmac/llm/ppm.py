"""Language-model scoring by word counts, with prediction by partial matching for the spelling of words only.

This is not PPM over the running text: no context crosses a word boundary, and rare spelling contexts are cut. That
model, by which op7_lm_score scores, is in ``ppm_text``; ``score_documents`` here leads to it. The model of this module
is no query's.

A text is its ASCII-lower-cased words, each spelled as its bytes and a closing space, then one end symbol. The trie of
byte contexts is pretrained on the training texts; a word's probability goes from long contexts to short ones:

1. The context of the text's class and the word's bytes so far, anchored at the space that opens the word, without
   depth limit. A known word is one such path, whose code telescopes to its count in the class. The estimated escape
   is mu / (n + mu): n tokens of the class, mu the number of words that a training text is expected to bring anew.
2. The same path without the class: the word's count in all training texts, each count less the discount
   ``d`` = t1 / (t1 + 2 t2) (t1, t2: words seen once, twice); what is taken from all counts is the escape.
3. Byte by byte in contexts of at most ``ORDER`` bytes back to the opening space, counted once for each distinct word,
   since that is how unknown words look: the longest known context comes first, with escape probability u / (n + u)
   (u symbols seen n times) to the next shorter one and with exclusion of the symbols that the longer contexts know;
   below order 0 the symbols that are left are equally likely.

A class is a kind of text (in mixed corpora, a language): one of ``CLASSES`` word distributions over the commonest
words, found by hard expectation-maximisation over all training texts from the words that most often lead a text. The
class of a text is the likeliest by its common words and is coded first. The probabilities of all words and the end
sum to one in every class.

Scale. Words that are at least ``HOT`` of all tokens (1 / HOT words at most) are broadcast with their probabilities.
For every other word a task sends one row per block of documents with its places, counts and classes there; the rows
of a word meet in one task, in order, where its counts by class are summed and its places are scored. No document text
is shuffled, a hot word never reaches one task, and all sums combine in each task first: a task sends one packed row for
each block, and what a block receives is bounded by its own words. Of the spelling contexts those
are kept that hold ``KEEP`` of all coded symbols at least: no more than 1 / KEEP an order, whatever the input, so they
can be broadcast.

Cases: null text counts as empty and is one end symbol; a null doc_id is a training row; repeated rows are scored
each; with no training rows the end has probability one half, every symbol is equally likely and the base score is
0; an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass
from itertools import count
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm import ppm_text
from tarmac.llm.common import stored, utf8

ORDER = 6
KEEP = 2e-6
HOT = 5e-6
COMMON = 1e-4  # of all tokens: the words that tell classes apart
CLASSES = 8
ROUNDS = 6  # of expectation-maximisation
OWN = 0.7  # share of the spelling in the escape of a class, against the counts of all texts
SYMBOLS = 256
BLOCK_DOCS = 4096  # 12 bits of a place; 3 bits are its class, one bit tells training rows
BLOCK_TOKENS = 4_000_000


class Trie:
    """Contexts with the counts of the symbols after them; codes words."""

    def __init__(self, contexts: dict[bytes, dict[int, int]], order: int = ORDER):
        self.contexts, self.order = contexts, order
        self._known: dict[tuple[bytes, int], float] = {}

    def cost(self, context: bytes, symbol: int) -> float:
        """log10 probability of ``symbol`` after ``context`` (its last ``order`` bytes count)."""
        key = (context, symbol)
        out = self._known.get(key)
        if out is None:
            if len(self._known) > 1_000_000:
                self._known.clear()
            out = self._known[key] = self._cost(context, symbol)
        return out

    def _cost(self, context: bytes, symbol: int) -> float:
        total, gone = 0.0, set()
        for k in range(len(context), -1, -1):
            seen = self.contexts.get(context[len(context) - k:])
            if not seen:
                continue
            left = {s: c for s, c in seen.items() if s not in gone}
            if not left:
                continue
            n, u = sum(left.values()), len(left)
            rest = SYMBOLS - len(gone) - u  # with nothing left to escape to, no escape is coded
            whole = n + (u if rest else 0)
            if symbol in left:
                return total + log10(left[symbol] / whole)
            total += log10(u / whole)
            gone |= left.keys()
        return total - log10(SYMBOLS - len(gone))

    def word(self, word: bytes) -> float:
        spelled, order, cost = b" " + word, self.order, self.cost
        out = 0.0
        for i, symbol in enumerate(word):
            out += cost(spelled[max(0, i + 1 - order):i + 1], symbol)
        return out + cost(spelled[-order:], 32)


@dataclass
class Classes:
    """Hard mixture of word distributions over the common words (ids below ``len(costs)``)."""

    costs: np.ndarray  # (common words, classes): 1024 * natural logarithm of the probability, rounded
    prior: np.ndarray  # the same of the classes

    def of(self, ids: np.ndarray, times: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Class of each text; text i has ids[ends[i]:ends[i + 1]]. Integer sums: the same in any order."""
        n = len(ends) - 1
        known = ids < len(self.costs)
        row = np.repeat(np.arange(n), np.diff(ends))[known]
        ids, times = ids[known], times[known].astype(np.float64)
        sums = np.stack([np.bincount(row, weights=self.costs[ids, k] * times, minlength=n)
                         for k in range(len(self.prior))], axis=1)  # whole numbers below 2 ** 53: exact
        return np.argmax(sums + self.prior, axis=1)


@dataclass
class Rates:
    """The numbers that, with a word's counts and spelling, give its probability."""

    tokens: int  # of the training texts, ends included
    kinds: int  # distinct tokens
    discount: float
    class_tokens: np.ndarray
    class_texts: np.ndarray

    def base(self, c):
        return np.log10((np.asarray(c, float) + 0.1) / (self.tokens + 0.1 * (self.kinds + 1)))

    @property
    def new(self) -> np.ndarray:
        """mu of each class."""
        return np.maximum(self.class_tokens * (self.discount * self.kinds / max(self.tokens, 1)), 1.0)

    def words(self, by_class: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """log10 probability by class, for words with these counts by class and log10 spelling probabilities."""
        spelling = 10.0 ** np.maximum(spelled, -300.0)
        if not self.tokens:
            return np.repeat((spelled + log10(0.5))[:, None], by_class.shape[1], axis=1)
        c = by_class.sum(axis=1)
        overall = (np.maximum(c - self.discount, 0.0) + self.discount * self.kinds * spelling) / self.tokens
        escaped = OWN * spelling + (1 - OWN) * overall
        # A long unknown word: its spelling can be smaller than a double.
        tiny = spelled < -300.0
        out = np.log10((by_class + self.new * escaped[:, None]) / (self.class_tokens + self.new))
        return np.where((tiny & (c == 0))[:, None], out + (spelled + 300.0)[:, None], out)

    def end(self) -> np.ndarray:
        """log10 probability of the end by class."""
        if not self.tokens:
            return np.full(len(self.class_texts), log10(0.5))
        overall = max(self.class_texts.sum() - self.discount, 0.0) / self.tokens
        return np.log10((self.class_texts + self.new * (1 - OWN) * max(overall, 1e-300))
                        / (self.class_tokens + self.new))

    def class_cost(self) -> np.ndarray:
        n = len(self.class_texts)
        return np.log10((self.class_texts + 1.0) / (self.class_texts.sum() + n))


@dataclass
class Model:
    contexts: dict
    order: int
    hot: list[bytes]  # words by falling count
    hot_counts: np.ndarray  # of the hot words, by class
    classes: Classes
    rates: Rates


def _sums(key: bytes, values):
    return pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(values, pa.int64())], names=["word", "c"])


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over the ``text`` bytes."""
    def run(batches):
        held = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                held.update(t.lower().split())
                if len(held) > 400_000:
                    yield _sums(list(held.keys()), list(held.values()))
                    held.clear()
        yield _sums(list(held.keys()), list(held.values()))

    return texts.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def context_counts(counts: DataFrame, order: int = ORDER, keep: float = KEEP) -> dict:
    """Contexts of up to ``order`` bytes with their symbols' counts over distinct words, rare contexts left out."""
    def run(batches):
        held = Counter()

        def out():
            keys = list(held.keys())
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.binary()), pa.array([k[1] for k in keys], pa.int32()),
                 pa.array(list(held.values()), pa.int64())], names=["context", "symbol", "n"])

        for b in batches:
            for w in b.column(0).to_pylist():
                spelled = b" " + w + b" "
                held.update([(spelled[max(0, i - order):i], spelled[i]) for i in range(1, len(spelled))])
            if len(held) > 400_000:
                yield out()
                held.clear()
        yield out()

    longest = stored(counts.select("word").mapInArrow(run, "context binary, symbol int, n long")
                     .groupBy("context", "symbol").agg(F.sum("n").alias("n")), "ppm-longest")
    total = longest.agg(F.sum("n")).first()[0] or 0
    suffixes = F.explode(F.transform(F.sequence(F.lit(0), F.length("context")),
                                     lambda k: F.substring(F.col("context"), F.length("context") - k + 1, k)))
    every = longest.select(suffixes.alias("context"), "symbol", "n").groupBy("context", "symbol") \
        .agg(F.sum("n").alias("n"))
    kept = every.groupBy("context").agg(F.sum("n").alias("total"),
                                        F.collect_list(F.struct("symbol", "n")).alias("seen")) \
        .filter(F.col("total") >= keep * total)
    out: dict[bytes, dict[int, int]] = {}
    for row in kept.select("context", "seen").toLocalIterator():
        out[bytes(row["context"])] = {s["symbol"]: s["n"] for s in row["seen"]}
    return out


def _vectors(texts: DataFrame, hot: list[bytes]) -> DataFrame:
    """(ids, times, tokens): the hot words of each text, as little-endian uint32, and its words."""
    shared = texts.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(hot)})

    def run(batches):
        get = shared.value.get
        for b in batches:
            ids, times, tokens = [], [], []
            for t in b.column(0).to_pylist():
                words = t.lower().split()
                got, n = np.unique(np.array([i for i in map(get, words) if i is not None], "<u4"), return_counts=True)
                ids.append(got.astype("<u4").tobytes())
                times.append(n.astype("<u4").tobytes())
                tokens.append(len(words))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(times, pa.binary()),
                                              pa.array(tokens, pa.int64())], names=["ids", "times", "tokens"])

    return texts.mapInArrow(run, "ids binary, times binary, tokens long")


def _flat(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, times = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int64)
    return (np.frombuffer(b"".join(ids), "<u4").astype(np.int64), np.frombuffer(b"".join(times), "<u4"), ends)


def _class_sums(vectors: DataFrame, pick, n_classes: int, n_words: int):
    """Counts of words (first ``n_words``) by class, tokens and texts of each class; pick gives texts' classes or -1."""
    def run(batches):
        words = np.zeros((n_words, n_classes), np.int64)
        tokens, texts = np.zeros(n_classes, np.int64), np.zeros(n_classes, np.int64)
        for b in batches:
            ids, times, ends = _flat(b)
            k = pick(ids, times, ends)
            size = b.column(2).to_numpy() + 1
            for c in range(n_classes):
                tokens[c] += size[k == c].sum()
                texts[c] += (k == c).sum()
            each = np.repeat(k, np.diff(ends))
            use = (each >= 0) & (ids < n_words)
            words += np.bincount(ids[use] * n_classes + each[use], weights=times[use],
                                 minlength=n_words * n_classes).astype(np.int64).reshape(n_words, n_classes)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([at, -1 - np.arange(n_classes), -1 - n_classes - np.arange(n_classes)])),
             pa.array(np.concatenate([words.ravel()[at], tokens, texts]))], names=["at", "n"])

    sums = vectors.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    at, n = sums.column("at").to_numpy(), sums.column("n").to_numpy()  # at most classes / HOT + 16 rows
    words = np.zeros(n_words * n_classes, np.int64)
    words[at[at >= 0]] = n[at >= 0]
    rest = np.zeros(2 * n_classes, np.int64)
    rest[-1 - at[at < 0]] = n[at < 0]
    return words.reshape(n_words, n_classes), rest[:n_classes], rest[n_classes:]


def _fitted(words: np.ndarray, texts: np.ndarray) -> Classes:
    p = (words + 0.5) / (words + 0.5).sum(axis=0)
    prior = (texts + 1.0) / (texts.sum() + len(texts))
    return Classes(np.round(1024 * np.log(p)), np.round(1024 * np.log(prior)))


def find_classes(vectors: DataFrame, n_common: int, n_classes: int = CLASSES, rounds: int = ROUNDS) -> Classes:
    """The classes of the texts in ``vectors``."""
    def leading(ids, times, ends):
        """The commonest of the common words of each text (of equal ones the commonest overall), else -1."""
        n = len(ends) - 1
        row = np.repeat(np.arange(n), np.diff(ends))
        use = ids < n_common
        row, ids, times = row[use], ids[use], times[use]
        order = np.lexsort((ids, -times.astype(np.int64), row))
        first = order[np.flatnonzero(np.r_[True, np.diff(row[order]) > 0])] if len(order) else order
        out = np.full(n, -1)
        out[row[first]] = ids[first]
        return out

    def count_leading(batches):
        held = Counter()
        for b in batches:
            held.update(leading(*_flat(b)).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.int64()),
                                          pa.array(list(held.values()), pa.int64())], names=["at", "n"])

    leads = vectors.mapInArrow(count_leading, "at long, n long").filter("at >= 0").groupBy("at") \
        .agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "at").limit(n_classes).collect()
    seeds = np.array([r["at"] for r in leads], np.int64)

    def by_lead(ids, times, ends):
        lead = leading(ids, times, ends)
        hit = lead[:, None] == seeds[None, :]
        return np.where(hit.any(axis=1), hit.argmax(axis=1), -1) if len(seeds) else np.full(len(lead), -1)

    words, _, texts = _class_sums(vectors, by_lead, n_classes, n_common)
    out = _fitted(words, texts)
    for _ in range(rounds):
        words, _, texts = _class_sums(vectors, out.of, n_classes, n_common)
        out = _fitted(words, texts)
    return out


def train(texts: DataFrame, order: int = ORDER, keep: float = KEEP, hot: float = HOT) -> Model:
    """Model of the ``text`` bytes of ``texts``."""
    counts = stored(word_counts(texts), "ppm-words")
    once = [F.coalesce(F.sum((F.col("c") == k).cast("long")), F.lit(0)) for k in (1, 2)]
    n_words, n, t1, t2 = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0)), *once).first()
    discount = min(0.95, max(0.05, t1 / (t1 + 2 * t2))) if t1 else 0.05
    frequent = counts.filter(F.col("c") >= max(hot * n, 1)).toArrow()  # at most 1 / hot rows
    words, c = frequent.column("word").to_pylist(), frequent.column("c").to_pylist()
    by_count = sorted(range(len(words)), key=lambda i: (-c[i], words[i]))
    hot_words = [words[i] for i in by_count]
    n_common = sum(x >= COMMON * n for x in c)
    vectors = stored(_vectors(texts, hot_words), "ppm-vectors")
    classes = find_classes(vectors, n_common)
    hot_counts, class_tokens, class_texts = _class_sums(vectors, classes.of, CLASSES, len(hot_words))
    n_texts = int(class_texts.sum())
    rates = Rates(n + n_texts, n_words + (n_texts > 0), discount, class_tokens, class_texts)
    return Model(context_counts(counts, order, keep), order, hot_words, hot_counts, classes, rates)


KIND = "key binary, block long, places binary, times binary, doc_id array<long>, held_out array<boolean>"
PARTIAL = "block long, sums binary, doc_id array<long>, held_out array<boolean>"  # sums: rows of SUM
SUM = np.dtype([("at", "<u2"), ("n_tokens", "<u4"), ("n_known", "<u4"), ("base", "<f8"), ("score", "<f8")])
RESULT = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
          "score double")


def score(documents: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    The rows that are not ``held_out`` must be the training rows.
    """
    context = documents.sparkSession.sparkContext
    trie, rates, order = Trie(model.contexts, model.order), model.rates, model.order
    spelled = np.array([trie.word(w) for w in model.hot])
    hot_scores = rates.words(model.hot_counts, spelled) if model.hot else np.zeros((1, CLASSES))
    hot_base = rates.base(model.hot_counts.sum(axis=1))
    hot_words = context.broadcast(({w: i for i, w in enumerate(model.hot)}, hot_scores, hot_base, model.classes))
    contexts = context.broadcast(model.contexts)
    end_base, end_known = float(rates.base(rates.class_texts.sum())), int(rates.class_texts.sum() > 0)
    first_cost = rates.end() + rates.class_cost() if rates.tokens else rates.end()
    names = [x.split()[0] for x in KIND.split(", ")]
    part_names = ["block", "sums", "doc_id", "held_out"]

    def postings(batches):
        """Rows of two kinds: with doc_id the sums of a block's documents so far, else the places of a word in a block."""
        from pyspark import TaskContext

        task, place = TaskContext.get().partitionId(), count()
        hot_of, scores, base, classes = hot_words.value

        def block(docs, flags, ids, words, lens):
            number = task << 24 | next(place)
            n_docs = len(docs)
            where = np.repeat(np.arange(n_docs, dtype=np.int64), lens)
            key, times = np.unique(np.array(ids, np.int64) << 12 | where, return_counts=True)
            wid, at = key >> 12, key & 0xFFF
            hot_id = np.array([hot_of.get(w, -1) for w in words], np.int64)[wid] if len(wid) else wid
            h = np.flatnonzero(hot_id >= 0)
            h = h[np.argsort(at[h], kind="stable")]
            ends = np.searchsorted(at[h], np.arange(n_docs + 1))
            k = classes.of(hot_id[h], times[h], ends)
            own = [np.bincount(at[h], weights=times[h] * x, minlength=n_docs) for x in
                   (np.ones(len(h)), base[hot_id[h]] if len(h) else np.zeros(0),
                    scores[hot_id[h], k[at[h]]] if len(h) else np.zeros(0))]
            sums = np.zeros(n_docs, SUM)
            sums["at"], sums["n_tokens"] = np.arange(n_docs), np.asarray(lens) + 1
            sums["n_known"], sums["base"] = own[0] + end_known, own[1] + end_base
            sums["score"] = own[2] + first_cost[k]
            yield pa.RecordBatch.from_arrays(
                [pa.array([b" %d" % number], pa.binary()), pa.array([number]), pa.array([sums.tobytes()], pa.binary()),
                 pa.nulls(1, pa.binary()), pa.array([docs], pa.list_(pa.int64())),
                 pa.array([flags], pa.list_(pa.bool_()))], names=names)
            cold = hot_id < 0
            train = ~np.array(flags, bool)
            wid, at, times = wid[cold], at[cold], times[cold]
            if not len(wid):
                return
            at = (at | k[at] << 12 | train[at].astype(np.int64) << 15).astype("<u2")
            cuts = np.r_[np.flatnonzero(np.r_[True, wid[1:] != wid[:-1]]), len(wid)]
            who = [words[i] for i in wid[cuts[:-1]].tolist()]
            for lo in range(0, len(who), 20_000):
                part = cuts[lo:lo + 20_001]
                m = len(part) - 1
                a, c = at[part[0]:part[-1]], times[part[0]:part[-1]]
                width = 1 if c.max() < 256 else 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(who[lo:lo + m], pa.binary()), pa.array(np.full(m, number)),
                     _slices(a, part - part[0], 2), _slices(c.astype(f"<u{width}"), part - part[0], width),
                     pa.nulls(m, pa.list_(pa.int64())), pa.nulls(m, pa.list_(pa.bool_()))], names=names)

        docs, flags, lens, ids = [], [], [], []
        vocab = defaultdict(count().__next__)
        for b in batches:
            for doc, flag, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                ws = text.lower().split()
                ids.extend(map(vocab.__getitem__, ws))
                docs.append(doc)
                flags.append(flag)
                lens.append(len(ws))
                if len(docs) >= BLOCK_DOCS or len(ids) >= BLOCK_TOKENS:
                    yield from block(docs, flags, ids, list(vocab), lens)
                    docs, flags, lens, ids = [], [], [], []
                    vocab = defaultdict(count().__next__)
        if docs:
            yield from block(docs, flags, ids, list(vocab), lens)

    def scored(batches):
        """Sums of the documents of each block over the words of this task; its rows come sorted by word."""
        coder = Trie(contexts.value, order)
        held, size = [], 0  # (place, known, base, score) of postings
        rows: list = []  # of the last word, which may go on

        def out():
            key = np.concatenate([x[0] for x in held])
            uniq, inv = np.unique(key, return_inverse=True)
            rows = np.zeros(len(uniq), SUM)
            rows["at"] = uniq & 0xFFF
            for i, name in ((1, "n_known"), (2, "base"), (3, "score")):
                rows[name] = np.bincount(inv, weights=np.concatenate([x[i] for x in held]))
            block = uniq >> 12
            cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            m = len(cuts)
            return pa.RecordBatch.from_arrays(
                [pa.array(block[cuts]), _slices(rows, np.r_[cuts, len(rows)], SUM.itemsize),
                 pa.nulls(m, pa.list_(pa.int64())), pa.nulls(m, pa.list_(pa.bool_()))], names=part_names)

        def add(part):
            """Score the postings of whole words."""
            words, blocks, places, times = zip(*part)
            lens = np.array([len(p) // 2 for p in places])
            at = np.frombuffer(b"".join(places), "<u2").astype(np.int64)
            if all(2 * len(t) == len(p) for t, p in zip(times, places)):
                n = np.frombuffer(b"".join(times), "u1").astype(np.float64)
            else:
                n = np.concatenate([np.frombuffer(t, "u1" if 2 * len(t) == len(p) else "<u4").astype(np.float64)
                                    for t, p in zip(times, places)])
            first = [i for i, w in enumerate(words) if not i or w != words[i - 1]]
            which = np.repeat(np.repeat(np.arange(len(first)), np.diff([*first, len(words)])), lens)
            k = at >> 12 & 7
            by_class = np.bincount(which * CLASSES + k, weights=n * (at >> 15), minlength=len(first) * CLASSES)
            by_class = by_class.reshape(-1, CLASSES)
            logs = rates.words(by_class, np.array([coder.word(words[i]) for i in first]))
            c = by_class.sum(axis=1)
            key = np.repeat(np.array(blocks, np.int64), lens) << 12 | at & 0xFFF
            held.append((key, n * (c > 0)[which], n * rates.base(c)[which], n * logs[which, k]))
            return len(at)

        for b in batches:
            own = b.filter(b.column("held_out").is_valid())
            if own.num_rows:
                yield pa.RecordBatch.from_arrays([own.column(c) for c in ("block", "places", "doc_id", "held_out")],
                                                 names=part_names)
            b = b.filter(b.column("held_out").is_null())
            if not b.num_rows:
                continue
            rows += zip(*(b.column(c).to_pylist() for c in names[:4]))
            last = rows[-1][0]
            keep = len(rows)
            while keep and rows[keep - 1][0] == last:
                keep -= 1
            if keep:
                size += add(rows[:keep])
                rows = rows[keep:]
            if size > 2_000_000:
                yield out()
                held, size = [], 0
        if rows:
            add(rows)
        if held:
            yield out()

    def summed(batches):
        """The documents of each block, its partial sums added; the rows come sorted by block."""
        block, docs, flags, sums = None, None, None, None

        def out():
            n = len(docs)
            return pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(flags, pa.bool_()), pa.array(sums[:n, 0].astype(np.int64)),
                 pa.array(sums[:n, 1].astype(np.int64)), pa.array(np.full(n, rates.tokens, np.int64)),
                 pa.array(sums[:n, 2].copy()), pa.array(sums[:n, 3].copy())], names=result_names)

        for b in batches:
            for number, part, d, f in zip(*(b.column(i).to_pylist() for i in range(4))):
                if number != block:
                    if block is not None:
                        yield out()
                    block, sums = number, np.zeros((BLOCK_DOCS, 4))
                if d is not None:
                    docs, flags = d, f
                rows = np.frombuffer(part, SUM)
                for i, name in enumerate(("n_tokens", "n_known", "base", "score")):
                    sums[rows["at"], i] += rows[name]  # a row has each place once
        if block is not None:
            yield out()

    result_names = [x.split()[0] for x in RESULT.split(", ")]
    src = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"),
                           utf8().alias("text"))
    sent = src.mapInArrow(postings, KIND).repartition("key").sortWithinPartitions("key")
    parts = sent.mapInArrow(scored, PARTIAL).repartition("block").sortWithinPartitions("block")
    return parts.mapInArrow(summed, RESULT)


def _slices(data: np.ndarray, ends: np.ndarray, width: int) -> pa.Array:
    """Binary array of data[ends[i]:ends[i + 1]]."""
    offsets = pa.py_buffer((ends * width).astype("<i4").tobytes())
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, offsets, pa.py_buffer(data.tobytes())])


def score_documents(documents: DataFrame, folds: int = 10, order: int = ppm_text.ORDER) -> DataFrame:
    """Train on the rows whose crc32(doc_id) modulo ``folds`` is not 0, score all rows: by PPM over the running text
    (``ppm_text``), not by the model of this module."""
    return ppm_text.score_documents(documents, folds, order)
