"""Scores against a plain model of the same definition; probabilities that sum to one."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from samples import SF, WORD
from tarmac.llm import ppm as P
from tarmac.llm.queries import op7_lm_score


def tokens(t):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def is_held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 10 == 0


def plain_base(rows):
    train = [tokens(t) for d, t in rows if not is_held(d)]
    c = Counter(w for ws in train for w in ws)
    n, v = sum(c.values()) + len(train), len(c) + bool(train)
    cost = lambda k: math.log10((k + 0.1) / (n + 0.1 * (v + 1)))
    out = []
    for d, t in rows:
        ws = tokens(t)
        out.append((d, is_held(d), len(ws) + 1, sum(c[w] > 0 for w in ws) + bool(train), n,
                    sum(cost(c[w]) for w in ws) + cost(len(train))))
    return out


def close(got, want):
    key = lambda r: tuple((x is not None, str(x)) for x in r[:5])
    got, want = sorted(got, key=lambda r: (key(r), r[5])), sorted(want, key=lambda r: (key(r), r[5]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert all(math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(got, want))


@pytest.mark.parametrize("hot", [P.HOT, 2.0, 1e-3])
def test_base_counts_and_scores(spark, documents, odd, hot):
    from pyspark.sql import functions as F
    from tarmac.llm.common import utf8
    for df in (documents, odd):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
        model = P.train(df.filter(~out).select(utf8().alias("text")), hot=hot)
        got = [tuple(r) for r in P.score(df, model, out).collect()]
        close([r[:6] for r in got], plain_base(rows))
        # The scores from the model's parts, word by word.
        rates, trie = model.rates, P.Trie(model.contexts)
        at = {w: i for i, w in enumerate(model.hot)}
        by_class = {}

        def kind(t):
            found = Counter(at[w.encode()] for w in tokens(t) if w.encode() in at)
            ids = np.array(sorted(found), np.int64)
            return int(model.classes.of(ids, np.array([found[i] for i in ids.tolist()], np.int64),
                                        np.array([0, len(ids)]))[0])

        kinds = [kind(t) for _, t in rows]
        for (d, t), k in zip(rows, kinds):
            if not is_held(d):
                for w in tokens(t):
                    by_class.setdefault(w, np.zeros(P.CLASSES))[k] += 1
        assert np.array_equal(rates.class_texts, np.bincount([k for (d, _), k in zip(rows, kinds) if not is_held(d)],
                                                             minlength=P.CLASSES))
        known = {}

        def cost(w, k):
            if w not in known:
                known[w] = rates.words(by_class.get(w, np.zeros(P.CLASSES))[None, :],
                                       np.array([trie.word(w.encode())]))[0]
            return known[w][k]

        want = [(d, is_held(d), len(tokens(t)) + 1, 0, 0, sum(cost(w, k) for w in tokens(t)) + rates.end()[k]
                 + rates.class_cost()[k]) for (d, t), k in zip(rows, kinds)]
        close([(*r[:3], 0, 0, r[6]) for r in got], want)


def test_probabilities_sum_to_one():
    """Over all short words of a small alphabet, the longer words and the end."""
    contexts = {b"": {97: 3, 98: 1, 32: 2}, b" ": {97: 2, 98: 1}, b"a": {32: 1, 98: 2}, b" a": {97: 1, 32: 4}}
    trie = P.Trie(contexts, 3)
    for ctx in (b" ", b" a", b" ab", b" zz"):
        assert math.isclose(sum(10 ** trie.cost(ctx, s) for s in range(256)), 1.0, rel_tol=1e-9)
    # Spelling: the mass of words up to two bytes, plus that of all words that go on.
    space, more = 0.0, 0.0
    for a in range(256):
        if a == 32:
            continue
        pa = 10 ** trie.cost(b" ", a)
        for b in range(256):
            pb = pa * 10 ** trie.cost(bytes([32, a]), b)
            if b == 32:
                space += pb
                assert math.isclose(math.log10(pb), trie.word(bytes([a])), rel_tol=1e-9)
            else:
                more += pb
    assert math.isclose(space + more + 10 ** trie.cost(b" ", 32), 1.0, rel_tol=1e-9)
    counts = np.zeros((3, P.CLASSES))
    counts[0, 0], counts[1, 0], counts[1, 1] = 5, 2, 7
    texts = np.zeros(P.CLASSES)
    texts[:2] = 2, 3
    tok = counts.sum(axis=0) + texts
    rates = P.Rates(int(tok.sum()), 3, 0.5, tok, texts)
    spelled = np.log10([0.2, 0.3, 0.5])  # three words hold all of the spelling mass
    total = (10 ** rates.words(counts, spelled)).sum(axis=0) + 10 ** rates.end()
    assert np.allclose(total[:2], 1.0)


def test_empty_tables_and_no_training_rows(spark, empty):
    assert P.score_documents(empty).count() == 0
    held = next(i for i in range(100) if is_held(i))
    df = spark.createDataFrame([(held, "ab c"), (held, "")], "doc_id long, text string")
    got = sorted(P.score_documents(df).collect(), key=lambda r: r.n_tokens)
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert math.isclose(got[0].score, math.log10(0.5))


def test_beats_the_base_on_held_out_texts(spark):
    rows = [r for r in op7_lm_score(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert op7_lm_score(spark, SF).count() == 200
