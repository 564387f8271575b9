"""Phrase mining against a plain count over all texts."""

import random
import re

import pytest
from samples import ODD, SCHEMA
from tarmac.llm import phrases as P

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, length=5, top=2000):
    """rows: (lang, text)."""
    f, n = {}, {}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] = n.get(lang, 0) + len(w)
            for k in range(1, length + 1):
                for i in range(len(w) - k + 1):
                    key = (lang, tuple(w[i:i + k]))
                    f[key] = f.get(key, 0) + 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, w), a in cand.items():
        if any(lg == lang and len(x) > len(w) and b >= a and any(x[i:i + len(w)] == w for i in range(len(x)))
               for (lg, x), b in cand.items()):
            continue
        cut = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]])
                  for k in range(1, len(w)))
        out.setdefault(lang, []).append((-cut[0], -a, " ".join(w).encode(), cut[2], cut[3]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items()
                  for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top]))


def got(df, **options):
    return sorted(tuple(r) for r in P.mine(df, **options).collect())


@pytest.mark.parametrize("budget,flush,known", [(2_000_000, 1_000_000, 1 << 17), (64, 500, 3), (4000, 5000, 40)])
def test_given_texts(spark, documents, budget, flush, known):
    """Also with groups and flushes so small that prefixes are extended and trees span many blocks."""
    rows = [(r.lang, r.text) for r in documents.collect()]
    assert got(documents, least=60, budget=budget, flush=flush, known=known) == plain(rows, 60)


@pytest.mark.parametrize("budget,flush,known", [(2_000_000, 1_000_000, 1 << 17), (32, 50, 2), (800, 50, 0)])
def test_few_words_many_ties(spark, budget, flush, known):
    """One word holds a third of all, runs of one word, phrases that overlap themselves, langs that share words."""
    rnd = random.Random(budget)
    rows = []
    for i in range(60):
        w = rnd.choices(["a", "b", "c", "d", "É", "a,", "b.", "\t", "x\x0by"], [9, 5, 3, 1, 1, 2, 2, 1, 1], k=rnd.randint(0, 60))
        rows.append((rnd.choice(["en", None, "und", ""]), " ".join(w)))
    rows += [("en", "a a a a a a a a"), ("en", "A b\nC d\rb c"), (None, None), ("en", None), ("x", "")] * 3
    df = spark.createDataFrame([(i, t, g) for i, (g, t) in enumerate(rows)], "doc_id long, text string, lang string")
    for least, top in ((3, 2000), (5, 4), (1, 50)):
        assert got(df, least=least, top=top, budget=budget, flush=flush, known=known) == plain(rows, least, top=top)


def test_long_texts_in_parts(spark, monkeypatch, documents):
    text = "one two  three. " * 40 + "two three one " * 30
    assert [w for p in P.parts(text.encode()) for w in p] == P.parts(text.encode()).__next__()
    monkeypatch.setattr(P, "PART", 7)
    flat = [w for p in P.parts(text.encode()) for w in p if w]
    monkeypatch.undo()
    assert flat == [w for p in P.parts(text.encode()) for w in p if w]


def test_odd_rows_clashing_names_and_empty(spark, odd, empty):
    rows = [(r[2], r[1]) for r in ODD]
    more = odd.selectExpr("*", "1 AS words", "2 AS a", "'x' AS rank", "3 AS h", "4 AS phrase")
    assert got(more, least=2) == got(odd, least=2) == plain(rows, 2)
    assert got(empty) == [] and got(odd, least=10 ** 6) == []
    assert P.mine(empty).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert SCHEMA


def test_shared_hash_takes_another_seed(spark, monkeypatch, odd):
    """If two words share a hash under a seed, the next one is taken."""
    real = P.word_counts
    clash = spark.createDataFrame([(7, "en", bytearray(b"x"), 1), (7, "en", bytearray(b"y"), 1)],
                                  "h long, lang string, word binary, f long")
    monkeypatch.setattr(P, "word_counts", lambda d, seed: clash if seed < 2 else real(d, seed))
    found, seed = P.words(odd)
    assert seed == 2 and found.count() == found.select("h").distinct().count() > 0


def test_score_beyond_64_bits(spark):
    """1000 * a * n passes 64 bits: the quotient is exact."""
    big = 9_007_199_254_740_993
    found = spark.createDataFrame([(1, "en", bytearray(b"x"), big), (2, "en", bytearray(b"y"), big + 2)],
                                  "h long, lang string, word binary, f long")
    counted = spark.createDataFrame([([1, 2], big - 2)], "words array<long>, a long")
    n = 2 * big + 2
    r = P.score(found, counted).first()
    assert r.n == n and r.score == 1000 * (big - 2) * n // (big * (big + 2))
