"""Toxicity scores after noisy-channel deobfuscation.

Restoring: a written word is read as a noisy image of a clean one. Its character lattice offers, beside each
character itself, the letters that a digit or sign may stand for, one or two letters for a run of the same
character, no letter for a separator, and a word break or nothing for the space between single characters. Viterbi
search finds the path with the least sum of channel costs and code length under a character trigram model, which is
counted over the words of all documents. Words whose lattice has one path only are their own restoration. A word
without any letter can also be meant as it stands (a number, a price): that reading costs ``DIGIT`` once and the code
length of its digits and signs, and the cheaper one counts; its signs that stand for letters and are no punctuation
are not dropped. The search is exact: its states at a position are the last
two characters read, at most the square of the number of characters that the word's lattice can emit. Punctuation at
the edges of a word (``EDGE``) is stripped before, so a word of nothing else is empty.

Scoring: the features of a text are its restored words and their prefixes of three to six letters, present or not.
Features that at least ``LEAST_DOCS`` toxic documents have, and significantly more of the toxic than of the others
(likelihood ratio ``LEAST_RATIO``), enter a logistic regression with a ridge, which gives the score.

Labels come from a sample of at most ``FIT_ROWS`` labelled documents (a hash threshold; all of them while there are
fewer); all other counts cover all rows. The trigram table is bounded by its alphabet, the features by the sample.

Cases: null or empty text has no features, so its score is the regression's intercept; null labels and null doc_ids are not learnt from;
of repeated labels a toxic one wins; without both classes all scores are the share of toxic labels; repeated rows
are scored each; an empty table gives an empty result; extra columns pass through, score columns are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.llm.common import add_arrays, extended, replace_columns, set_aside, stored, tidy

FIT_ROWS = 60_000
LEAST_DOCS = 3  # toxic documents that must have a feature
LEAST_RATIO = 10.8  # chi square at one in a thousand
RIDGE = 0.1
PREFIXES = (3, 4, 5, 6)
REGRESSION_BLOCK = 1_000_000  # features of rows taken at once
ROWS_AT_ONCE = 500  # rows of a batch that are Python objects at once
# Letters that a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y"}
EDGE = ".,;:!?\"'()[]{}<>*_~`-|/\\…«»„“”‘’¡¿"
SUBSTITUTE, DIGIT, DROP, COLLAPSE, COLLAPSE_PAIR, KEEP_RUN, JOIN, BREAK = 1.0, 3.0, 1.5, 0.7, 6.0, 2.0, 0.5, 1.5
# Code lengths in a word without letters: a digit, a sign in a number, another sign.
LITERAL_DIGIT, LITERAL_MARK, LITERAL_SIGN = math.log(10), math.log(13), math.log(50)
MARKS = "+-.,:/%$€£¥#"
_RUN = re.compile(r"(.)\1")
_RUNS = re.compile(r"(.)\1*", re.S)
_RUN3 = re.compile(r"(.)\1\1")
_FADING = re.compile(rf"(?:(?![{re.escape(''.join(LEET))}])[\W_])+\Z")  # closing signs that stand for no letter
_HEAD = re.compile(r"([^\W\d_]{3,})([\W\d_]*)\Z")  # letters, then signs and digits


def _letter(c: str) -> bool:
    return "a" <= c <= "z" or "ß" <= c <= "ſ" and c.isalpha()


@dataclass
class CharModel:
    """Interpolated character trigrams; a word is padded with spaces."""

    grams: dict[str, int]
    _two: dict = field(default_factory=dict)
    _one: dict = field(default_factory=dict)
    _known: dict = field(default_factory=dict)

    def __post_init__(self):
        two, one, ctx1 = Counter(), Counter(), Counter()
        for g, n in self.grams.items():
            two[g[:2]] += n
            one[g[1:]] += n
            ctx1[g[1]] += n
        sym = Counter()
        for g, n in self.grams.items():
            sym[g[2]] += n
        self._two, self._one, self._ctx1, self._sym = two, one, ctx1, sym
        self._total = sum(sym.values())

    def cost(self, context: str, c: str) -> float:
        """Negative natural logarithm of the probability of ``c`` after two characters."""
        key = context + c
        out = self._known.get(key)
        if out is None:
            p0 = (self._sym.get(c, 0) + 0.5) / (self._total + 0.5 * 256)
            n1 = self._ctx1.get(context[1], 0)
            p1 = (self._one.get(key[1:], 0) + 20 * p0) / (n1 + 20)
            p2 = (self.grams.get(key, 0) + 20 * p1) / (self._two.get(context, 0) + 20)
            out = self._known[key] = -math.log(p2)
        return out


def _arcs(noisy: str):
    """For each position the arcs (end, emitted, cost)."""
    n = len(noisy)
    bare = not any(map(str.isalpha, noisy))  # a word without letters: its signs are its letters
    run_end = [0] * n
    for i in range(n - 1, -1, -1):
        run_end[i] = run_end[i + 1] if i + 1 < n and noisy[i + 1] == noisy[i] else i + 1
    out = []
    for i, c in enumerate(noisy):
        start = i == 0 or noisy[i - 1] != c
        r = run_end[i] - i
        if c == " ":
            out.append([(i + 1, "", JOIN), (i + 1, " ", BREAK)])
            continue
        plain = []
        if c.isalpha():
            plain.append((c, 0.0 if r < 3 and start or not start and run_end[i] == i + 1 else KEEP_RUN))
        else:
            plain += [(x, SUBSTITUTE) for x in LEET.get(c, "")]
            if c.isalnum():
                plain.append((c, DIGIT))
        arcs = [(i + 1, e, w) for e, w in plain]
        sign = not c.isalnum() and not (bare and c in LEET and c not in EDGE)  # can be a separator
        if sign:
            arcs.append((i + 1, "", DROP))
            if 0 < i < n - 1:
                arcs.append((i + 1, " ", BREAK))
        if start and r >= 2:
            for e, w in plain:
                base = w if not c.isalpha() else 0.0
                if bare and r > 2:
                    base += 2 * math.log(r)
                arcs.append((run_end[i], e, base + (COLLAPSE if r > 2 else COLLAPSE_PAIR)))
                if r > 2:
                    arcs.append((run_end[i], e + e, base + COLLAPSE + 0.5))
            if sign:
                arcs.append((run_end[i], "", DROP))
        out.append(arcs)
    return out


def cheapest(noisy: str, model: CharModel) -> tuple[float, str]:
    """Cost and text of the cheapest clean reading of ``noisy`` (lower case); it may hold spaces between words."""
    arcs, n, cost_of = _arcs(noisy), len(noisy), model.cost
    cells: list[dict] = [{} for _ in range(n + 1)]
    cells[0]["  "] = (0.0, None, "")
    for i in range(n):
        for context, entry in cells[i].items():
            for j, emitted, w in arcs[i]:
                total, ctx = entry[0] + w, context
                for e in emitted:
                    total += cost_of(ctx, e)
                    ctx = "  " if e == " " else ctx[1] + e
                old = cells[j].get(ctx)
                if old is None or total < old[0]:
                    cells[j][ctx] = (total, entry, emitted)
    total, _, best = min(((e[0] + cost_of(ctx, " "), ctx, e) for ctx, e in cells[n].items()), key=lambda x: x[:2])
    out = []
    while best is not None:
        out.append(best[2])
        best = best[1]
    return total, "".join(reversed(out))


def viterbi(noisy: str, model: CharModel) -> str:
    """The cheapest clean reading of ``noisy``."""
    return cheapest(noisy, model)[1]


def _noisy(word: str) -> str:
    """The part of a written word that is read by the lattice."""
    core = word.strip(EDGE)
    if core.isalpha():
        return core
    noisy = word.lstrip("\"'([{<*_-").rstrip(EDGE) or core
    core = _FADING.sub("", noisy)  # at the end of letters every best path drops them
    return core if core.isalpha() else noisy


def _literal(core: str) -> float:
    """Cost of a word without letters as it stands; a run of more than two is its character and its length."""
    number, out = any(map(str.isalnum, core)), DIGIT
    for m in _RUNS.finditer(core):
        c, r = m[1], len(m[0])
        each = LITERAL_DIGIT if c.isalnum() else LITERAL_MARK if number and c in MARKS else LITERAL_SIGN
        out += min(r * each, each + 2 * math.log(r)) if r > 2 else r * each
    return out


def restored(word: str, model: CharModel) -> str:
    """Clean reading of one written word (lower case, without spaces)."""
    noisy = _noisy(word)
    if noisy.isalpha():
        return viterbi(noisy, model) if _RUN.search(noisy) else noisy
    if any(map(str.isalpha, word)):
        return viterbi(noisy, model)
    core = word.strip(EDGE)
    if not core:
        return ""
    cost, text = cheapest(noisy, model)
    return core if _literal(core) <= cost else text


def readings(word: str) -> list[str]:
    """What the lattice of letters without longer runs than pairs can spell: each pair kept or made one letter."""
    out = [""]
    for part in re.findall(r"(?:(.)\1|(.))", word):
        out = [x + y for x in out for y in ((part[0] * 2, part[0]) if part[0] else (part[1],))]
    return out


def spaced(words: list[str]) -> list[str]:
    """Runs of three and more words of one character, each joined by spaces."""
    sizes = list(map(len, words))
    if sizes.count(1) < 3:
        return []
    single = "".join(["1" if n == 1 else "0" for n in sizes])
    out, at = [], single.find("111")
    while at >= 0:
        end = single.find("0", at)
        end = len(single) if end < 0 else end
        out.append(" ".join(words[at:end]))
        at = single.find("111", end)
    return out


def restore_text(text: str, model: CharModel) -> str:
    """The text in lower case with every word restored and spaced-out words joined."""
    words = text.lower().split()
    out, run = [], []
    for w in [*words, None]:
        if w is not None and len(w) == 1:
            run.append(w)
            continue
        if len(run) >= 3:
            out.append(viterbi(" ".join(run), model))
        else:
            out += [restored(x, model) for x in run]
        run = []
        if w is not None:
            out.append(restored(w, model))
    return " ".join(x for x in out if x)


def features(word: str) -> list[str]:
    return ["=" + word, *["^" + word[:k] for k in PREFIXES if len(word) >= k]]


def _clean_words(text: str, model: CharModel, known: dict) -> set[str]:
    words = text.lower().split()
    out = set()
    for w in set(words):
        got = known.get(w)
        if got is None:
            if len(known) > 300_000:
                known.clear()
            got = known[w] = tuple(restored(w, model).split())
        out.update(got)
    for run in spaced(words):
        out.update(viterbi(run, model).split())
    return out


def _alphabet() -> tuple[list[str], np.ndarray]:
    """The symbols of the trigrams, and the symbol of each code point (the last entry: of all higher ones)."""
    symbols = [" ", "\u0001", *filter(_letter, map(chr, range(ord("a"), 0x180)))]
    at = {c: i for i, c in enumerate(symbols)}
    return symbols, np.array([at.get(chr(c), 1) for c in range(0x180)] + [1], np.int64)


def _pieces(batches):
    """The batches in parts of few rows."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS_AT_ONCE):
            yield b.slice(at, ROWS_AT_ONCE)


def gram_counts(words: Counter, place: np.ndarray, n_symbols: int, into: np.ndarray | None = None) -> np.ndarray:
    """Counts of the trigrams of padded words, by their code in base ``n_symbols``; added to ``into`` if given."""
    cores, times = [], []
    for w, n in words.items():
        core = w.strip(EDGE)
        if core.isalpha() and not _RUN3.search(core):
            cores.append(core)
            times.append(n)
    text = np.frombuffer("".join([f"  {c} " for c in cores]).encode("utf-32-le"), "<u4")
    each = np.repeat(np.array(times, np.int64), np.array([len(c) + 3 for c in cores], np.int64))
    at = place[np.minimum(text, len(place) - 1)]
    inside = ~((at[1:-1] == 0) & (at[2:] == 0))  # of one word
    code = ((at[:-2] * n_symbols + at[1:-1]) * n_symbols + at[2:])[inside]
    out = np.zeros(n_symbols ** 3, np.int64) if into is None else into
    np.add.at(out, code, each[:-2][inside])  # in place: the table is large
    return out


def char_grams(documents: DataFrame) -> dict[str, int]:
    """Trigram counts over the words of all documents; letters outside the Latin ranges count as one."""
    symbols, place = _alphabet()
    n = len(symbols)

    def run(batches):
        held, grams = Counter(), np.zeros(n ** 3, np.int64)
        for b in _pieces(batches):
            for t in b.column(0).to_pylist():
                held.update(t.lower().split())
                if len(held) > 100_000:
                    gram_counts(held, place, n, grams)
                    held.clear()
        gram_counts(held, place, n, grams)
        code = np.flatnonzero(grams)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(grams[code])], names=["code", "n"])

    text = documents.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sums = text.mapInArrow(tidy(run), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return {symbols[r["code"] // n ** 2] + symbols[r["code"] // n % n] + symbols[r["code"] % n]: r["n"]
            for r in sums.toLocalIterator()}


@dataclass
class ToxicityModel:
    chars: CharModel
    weights: dict[str, float]  # of features
    bias: float

    def __post_init__(self):
        self.heads = {f[1:4] for f in self.weights}  # first letters of the words that matter
        self.starts = {f[1:7] for f in self.weights if f[0] == "="}
        self._spelled: dict = {}  # signs: can they spell such first letters

    def without_search(self, word: str) -> tuple[str, ...] | None:
        """The features of a written word that have a weight, if all its readings agree on them; else None.

        The first word of every reading begins with the letters before any sign (pairs kept or made one); what the
        signs and digits after them stand for can make it longer, or be further words.
        """
        if not any(map(str.isalpha, word)):  # letters that no weighted word begins with give no feature
            return None if self._spells(frozenset("".join([LEET.get(c, "") + c for c in word]))) else ()
        m = _HEAD.match(_noisy(word))
        if not m or not m[1].isalpha() or _RUN3.search(m[1]):
            return None
        pairs = len(_RUN.findall(m[1]))
        if pairs > 4:
            return None
        first = readings(m[1]) if pairs else [m[1]]
        signs = frozenset("".join([LEET.get(c, "") + c * c.isalnum() for c in m[2]]))
        if signs:
            if self._spells(signs) or any(len(x) < 3 or x[:3] in self.heads and (len(x) < 6 or x[:6] in self.starts)
                                           for x in first):
                return None
        got = {self.useful(x) for x in first}
        return got.pop() if len(got) == 1 else None

    def _spells(self, signs: frozenset) -> bool:
        """Can these characters spell the first letters of a word that matters?"""
        out = self._spelled.get(signs)
        if out is None:
            if len(self._spelled) > 300_000:
                self._spelled.clear()
            out = self._spelled[signs] = any(map(signs.issuperset, self.heads))
        return out

    def found(self, word: str) -> tuple[str, ...]:
        """The features of a written word that have a weight."""
        core = word.strip(EDGE)
        if core.isalpha():  # readings of letters differ in runs only
            if core[:3] not in self.heads and not _RUN.search(core[:4]):
                return ()
            if not _RUN.search(core):
                return self.useful(core)
        out = self.without_search(word)
        return tuple(f for x in restored(word, self.chars).split() for f in self.useful(x)) if out is None else out

    def useful(self, word: str) -> tuple[str, ...]:
        """The features of a restored word that have a weight."""
        return tuple(f for f in features(word) if f in self.weights) if word[:3] in self.heads else ()

    def score(self, found) -> float:
        """Score of a text with these features (a set)."""
        x = self.bias + sum(map(self.weights.get, sorted(found)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


class _Among:
    """The numbers of the features of words that are in ``wanted`` (feature: number)."""

    def __init__(self, wanted: dict[str, int]):
        self.wanted, self.heads, self.known = wanted, {f[1:4] for f in wanted}, {}

    def of(self, words) -> set[int]:
        out = set()
        for w in words:
            if w[:3] in self.heads:
                got = self.known.get(w)
                if got is None:
                    if len(self.known) > 300_000:
                        self.known.clear()
                    got = self.known[w] = tuple(self.wanted[f] for f in features(w) if f in self.wanted)
                out.update(got)
        return out


def significant(toxic: int, clean: int, share: float) -> bool:
    """More frequent in toxic documents, beyond chance."""
    n = toxic + clean
    if toxic < LEAST_DOCS or toxic <= share * n:
        return False
    ratio = toxic * math.log(toxic / (n * share)) + (clean * math.log(clean / (n * (1 - share))) if clean else 0.0)
    return 2 * ratio >= LEAST_RATIO


def _regression(cols: np.ndarray, sizes: np.ndarray, y: np.ndarray, n_cols: int, steps: int = 300):
    """Bias and weights of a ridge logistic regression on 0/1 features: row i has the next ``sizes[i]`` of ``cols``.

    Accelerated gradient descent, each weight with the inverse of its curvature bound. The rows are taken in blocks,
    so that the memory besides ``cols`` stays small.
    """
    n = len(y)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    cuts = np.unique(np.r_[np.searchsorted(ends[:-1], np.arange(0, ends[-1] + 1, REGRESSION_BLOCK)), n])
    cuts = np.unique(np.r_[0, cuts])

    def blocks():
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            yield (slice(lo, hi), np.repeat(np.arange(hi - lo), sizes[lo:hi]),
                   cols[ends[lo]:ends[hi]].astype(np.int64))

    size = sizes + 1.0  # features of a row, and the bias
    bound = np.full(n_cols, RIDGE)
    for at, row, col in blocks():
        bound += np.bincount(col, weights=size[at][row], minlength=n_cols) / 4
    bias_bound = size.sum() / 4
    w, b = np.zeros(n_cols), math.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    vw, vb, t = w, b, 1.0
    for _ in range(steps):
        slope, total = -RIDGE * vw, 0.0
        for at, row, col in blocks():
            x = vb + np.bincount(row, weights=vw[col], minlength=at.stop - at.start)
            miss = y[at] - 1 / (1 + np.exp(-np.clip(x, -30, 30)))
            slope += np.bincount(col, weights=miss[row], minlength=n_cols)
            total += miss.sum()
        new_w, new_b = vw + slope / bound, vb + total / bias_bound
        turn = (1 + math.sqrt(1 + 4 * t * t)) / 2
        vw, vb = new_w + (t - 1) / turn * (new_w - w), new_b + (t - 1) / turn * (new_b - b)
        w, b, t = new_w, new_b, turn
    return b, w


def fit(documents: DataFrame, labels: DataFrame, usable=None, fit_rows: int = FIT_ROWS) -> ToxicityModel:
    """Model from ``documents`` (doc_id, text) and ``labels`` (doc_id, toxic); ``usable`` filters labels' rows."""
    spark = documents.sparkSession
    lab = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
    lab = lab.filter(usable) if usable is not None else lab
    lab = lab.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = lab.count()
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < min(1.0, 0.98 * fit_rows / max(n, 1)) * (1 << 20)
    sample = (lab.filter(part) if n > fit_rows else lab).limit(fit_rows)
    chars = CharModel(char_grams(documents))
    model = spark.sparkContext.broadcast(chars)

    def run(batches):
        known: dict = {}
        for b in _pieces(batches):
            words = [sorted(_clean_words(t, model.value, known)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.list_(pa.string()))],
                                             names=["toxic", "words"])

    # At most fit_rows ids and labels: a bounded broadcast.
    chosen = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")) \
        .join(F.broadcast(sample), "doc_id").select("toxic", "text")
    read = stored(chosen.mapInArrow(tidy(run), "toxic int, words array<string>"), "toxic-words")
    n_all, n_toxic = read.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    share = n_toxic / n_all if n_all else 0.0

    def counted(rows, only=None):
        def sums(names, numbers):
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(numbers, pa.int64())],
                                              names=["f", "n"])

        def count(batches):
            held = Counter()
            for b in _pieces(batches):
                for words in b.column(0).to_pylist():
                    held.update({f for w in words for f in features(w)})
                    if len(held) > 200_000:
                        yield sums(list(held.keys()), list(held.values()))
                        held.clear()
            yield sums(list(held.keys()), list(held.values()))

        def count_wanted(batches):
            wanted = only.value.combine_chunks()
            among = _Among({f: i for i, f in enumerate(wanted.to_pylist())})
            held = [0] * len(wanted)
            for b in _pieces(batches):
                for words in b.column(0).to_pylist():
                    for i in among.of(words):
                        held[i] += 1
            there = np.flatnonzero(held)
            yield sums(wanted.take(pa.array(there)), np.array(held, np.int64)[there])

        return rows.select("words").mapInArrow(tidy(count if only is None else count_wanted), "f string, n long") \
            .groupBy("f").agg(F.sum("n").alias("n"))

    if not 0 < n_toxic < n_all:
        return ToxicityModel(chars, {}, math.log((n_toxic + 0.5) / (n_all - n_toxic + 0.5)))
    # Features of at most fit_rows documents, kept as Arrow columns on the driver.
    toxic = counted(read.filter("toxic = 1")).filter(F.col("n") >= LEAST_DOCS).toArrow()
    only = spark.sparkContext.broadcast(toxic.column("f"))
    clean = counted(read.filter("toxic = 0"), only).withColumnRenamed("n", "clean").toArrow()
    names = []
    for b in toxic.join(clean, "f").to_batches(max_chunksize=10_000):
        for f, there, other in zip(*(b.column(c).to_pylist() for c in ("f", "n", "clean"))):
            if significant(there, other or 0, share):
                names.append(f)
    names.sort()
    del toxic, clean
    place = spark.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def found(batches):
        among = _Among(place.value)
        for b in _pieces(batches):
            got = [np.array(sorted(among.of(words)), "<i4").tobytes() for words in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary())], names=["y", "at"])

    # At most fit_rows rows with the few features that are kept; sorted, as the order of rows may differ by run.
    got = read.select("toxic", "words").mapInArrow(tidy(found), "y int, at binary").toArrow().sort_by(
        [("y", "ascending"), ("at", "ascending")])
    rows = got.column("at").to_pylist()
    sizes = np.array([len(x) // 4 for x in rows], np.int64)
    cols = np.frombuffer(b"".join(rows), "<i4")
    bias, weights = _regression(cols, sizes, got.column("y").to_numpy().astype(float), len(names))
    return ToxicityModel(chars, {f: float(w) for f, w in zip(names, weights) if w}, float(bias))


def score(documents: DataFrame, model: ToxicityModel, limit: float = 0.7) -> DataFrame:
    """``documents`` plus score (0 to 1) and predicted (1 if score >= limit)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    base = replace_columns(documents, ["score", "predicted", "__text"])

    def run(batches):
        m = shared.value
        chars = m.chars
        known, dull, older = {}, set(), set()  # features of words that have some; words without any, and those before

        for b in _pieces(batches):
            scores = []
            for t in b.column(b.num_columns - 1).to_pylist():
                words = t.lower().split()
                found = set()
                for w in set(words).difference(dull):
                    got = known.get(w)
                    if got is None:
                        got = () if w in older else m.found(w)
                        if got:
                            if len(known) > 100_000:
                                known.clear()
                            known[w] = got
                        else:
                            if len(dull) > 150_000:
                                dull, older = set(), dull
                            dull.add(w)
                    found.update(got)
                for r in spaced(words):
                    for x in viterbi(r, chars).split():
                        found.update(m.useful(x))
                scores.append(m.score(found))
            yield add_arrays(b.select(b.schema.names[:-1]), score=pa.array(scores, pa.float64()),
                             predicted=pa.array([int(s >= limit) for s in scores], pa.int32()))

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return base.withColumn("__text", text).mapInArrow(
        tidy(run), extended(base.schema, score=T.DoubleType(), predicted=T.IntegerType()))


def restore(documents: DataFrame, model: CharModel) -> DataFrame:
    """``documents`` plus clean_text, the restored reading of the text."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    base = replace_columns(documents, ["clean_text", "__text"])

    def run(batches):
        for b in batches:
            texts = [restore_text(t, shared.value) for t in b.column(b.num_columns - 1).to_pylist()]
            yield add_arrays(b.select(b.schema.names[:-1]), clean_text=pa.array(texts, pa.string()))

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return base.withColumn("__text", text).mapInArrow(run, extended(base.schema, clean_text=T.StringType()))


def training_rows(folds: int = 3, held: int = 1):
    """The rows whose label may be learnt."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds != held, F.lit(False))


def drop_toxic(documents: DataFrame, labels: DataFrame, limit: float = 0.7) -> DataFrame:
    """The documents that score below ``limit``; columns as given, also those named as the model's."""
    model = fit(documents, labels, training_rows())
    given, back = set_aside(documents, ["score", "predicted", "__text"])
    return score(given, model, limit).filter("predicted = 0").select(*back)
