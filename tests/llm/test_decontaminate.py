"""The suffix automaton against a plain search for windows."""

import hashlib
import random
import re

from pyspark.sql import functions as F
from tarmac.llm import decontaminate as D
from tarmac.llm.queries import op10_decontaminate

from samples import SF

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain(text, items, window=13):
    low = lambda t: re.findall(WORDS, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words = low(text)
    hit, names = set(), set()
    for name, t in items:
        seq = low(t)
        n = min(window, len(seq))
        if name is None or not n:
            continue
        wins = {tuple(seq[i:i + n]) for i in range(len(seq) - n + 1)}
        for i in range(len(words) - n + 1):
            if tuple(words[i:i + n]) in wins:
                hit |= set(range(i, i + n))
                names.add(str(name))
    return len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def rows(df, bench, **kw):
    out = D.mark(df, bench, **kw).select("doc_id", "n_words", "n_hit", "n_items", D.items_digest())
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_equals_brute_force_on_tables(spark, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = sorted(((r.doc_id, *plain(r.text, items)) for r in documents.collect()), key=str)
    got = op10_decontaminate(spark, SF)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == want
    assert any(w[2] for w in want)


def test_random_texts_small_windows_and_blocks(spark):
    rnd = random.Random(3)
    text = lambda n: " ".join(rnd.choice("abc") for _ in range(n))
    items = [(i, text(rnd.randint(0, 9))) for i in range(14)] + [(None, "a b"), (3, "c c c c c"), (77, None)]
    docs = [(i, text(rnd.randint(0, 60))) for i in range(40)] + [(None, "a b c"), (50, None), (51, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_hit", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id long, text string")
    items = [(i, t) for i, t in items if i != 3] + [(3, t) for i, t in items if i == 3]
    for window in (3, 5):
        want = []
        for i, t in docs:
            n, h, k, s = plain(t, items, window)
            want.append((i, n, h, k, s))
        for block in (100_000, 7):
            assert rows(d, b, window=window, block_words=block) == sorted(want, key=str)


def test_odd_rows_and_empty_tables(spark, odd, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in D.mark(odd, none).collect()} == {0}
    assert D.mark(empty, none).count() == 0
    some = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    got = {(r.doc_id, r.n_hit) for r in D.mark(odd, some).collect()}
    assert (5, 2) in got and (3, 0) in got and (None, 0) in got
    kept = D.drop_contaminated(odd, some)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 2


def test_cut_spans(spark):
    d = spark.createDataFrame([(1, "Keep THIS, one two; three! and the rest.")], "doc_id long, text string")
    b = spark.createDataFrame([(9, "one Two three")], "item_id long, text string")
    row = D.cut_spans(d, b).first()
    assert row.hit_spans == [[2, 5]] and row.clean_text == "Keep THIS, ! and the rest."
