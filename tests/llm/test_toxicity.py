"""Restoring against a full search of the lattice, and held-out accuracy."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from samples import SF
from pyspark.sql import functions as F
from tarmac.llm import toxicity as X
from tarmac.llm.queries import op1_toxicity

CLEAN = ("you stupid idiot moron people talk about trash and clean things in a happy good little book see the balloon "
         "is less bitter than coffee and butter").split()


@pytest.fixture(scope="module")
def model():
    grams = X.Counter()
    for w in CLEAN * 30:
        s = f"  {w} "
        grams.update(s[i:i + 3] for i in range(len(s) - 2))
    return X.CharModel(dict(grams))


def full_search(noisy, model):
    """The cheapest path by trying all of them."""
    arcs, best = X._arcs(noisy), (math.inf, "")

    def go(i, ctx, total, out):
        nonlocal best
        if i == len(noisy):
            best = min(best, (total + model.cost(ctx, " "), out))
            return
        for j, e, w in arcs[i]:
            t, c = total + w, ctx
            for x in e:
                t += model.cost(c, x)
                c = "  " if x == " " else c[1] + x
            go(j, c, t, out + e)

    go(0, "  ", 0.0, "")
    return best[0]


def cost_of(noisy, model, text):
    """The least cost of reading ``noisy`` as ``text``."""
    arcs, best = X._arcs(noisy), math.inf

    def go(i, k, ctx, total):
        nonlocal best
        if i == len(noisy):
            if k == len(text):
                best = min(best, total + model.cost(ctx, " "))
            return
        for j, e, w in arcs[i]:
            if text[k:k + len(e)] == e:
                t, c = total + w, ctx
                for x in e:
                    t += model.cost(c, x)
                    c = "  " if x == " " else c[1] + x
                go(j, k + len(e), c, t)

    go(0, 0, "  ", 0.0)
    return best


@pytest.mark.parametrize("noisy", ["1d10t", "m0r0n", "stuuupid", "$tup1d", "tr@$h", "i d i o t", "id-i.ot", "l3ss", "b00k"])
def test_viterbi_is_the_cheapest_path(model, noisy):
    got = X.viterbi(noisy, model)
    assert math.isclose(cost_of(noisy, model, got), full_search(noisy, model), rel_tol=1e-9)


@pytest.mark.parametrize("noisy,want", [("1d10t", "idiot"), ("1D1OT!!".lower(), "idiot"), ("m0r0n", "moron"),
                                        ("stuuuupiiid", "stupid"), ("tr@$h", "trash"), ("st-u-p-id", "stupid"),
                                        ("happy", "happy"), ("coffee", "coffee"), ("less", "less"), ("book,", "book"),
                                        ("2021", "2021"), ("***", ""), ("", "")])
def test_words(model, noisy, want):
    assert X.restored(noisy, model) == want


def test_readings_of_pairs(model):
    for w in ("idiiott", "happy", "balloon", "aabb"):
        assert set(X.readings(w)) >= {X.viterbi(w, model), w} and len(X.readings(w)) <= 4
    for noisy in ("balloon", "idiiott"):
        for r in X.readings(noisy):
            assert cost_of(noisy, model, r) < math.inf


def test_spaced_and_text(model):
    assert X.spaced("you i d i o t a b see".split()) == ["i d i o t a b"]
    assert X.spaced("a b see a".split()) == []
    assert X.restore_text("You  1D10T, t r a s h !", model).startswith("you idiot trash")


def test_learns_words_and_ignores_held_labels(spark):
    rows, labels = [], []
    for i in range(300):
        toxic = i % 5 == 0
        word = ["idiot", "1d10t", "i d i o t", "idiiiot"][i // 5 % 4] if toxic else "people"
        rows.append((i, f"some words {i} about the {word} and things", "x"))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    lab = spark.createDataFrame([*labels, (None, 1), (7, None), (5, 0)], "doc_id long, toxic int")
    usable = X.training_rows()
    m = X.fit(docs, lab, usable)
    got = {r.doc_id: r for r in X.score(docs, m).collect()}
    assert all(got[i].predicted == t for i, t in labels)
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    flipped = lab.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in X.score(docs, X.fit(docs, flipped, usable)).collect()}
    assert again == {i: r.score for i, r in got.items()}


def test_odd_rows_and_empty_tables(spark, odd, empty):
    lab = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (5, 1)], "doc_id long, toxic int")
    got = X.score(odd, X.fit(odd, lab))
    assert got.columns == [*odd.columns, "score", "predicted"] and got.count() == odd.count()
    assert all(0 <= r.score <= 1 for r in got.collect())
    assert X.score(empty, X.fit(empty, lab)).count() == 0
    none = lab.limit(0)
    assert {r.predicted for r in X.score(odd, X.fit(odd, none)).collect()} <= {0}
    assert X.drop_toxic(odd, none).columns == odd.columns


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = op1_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    n = {(r.toxic, r.predicted): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert n.get((1, 1), 0) / (n.get((1, 1), 0) + n.get((1, 0), 0)) > 0.75
    assert n.get((0, 1), 0) / (n.get((0, 1), 0) + n.get((0, 0), 0)) < 0.01
    assert op1_toxicity(spark, SF).count() == 200


def test_numerals_that_are_no_digits_are_read():
    model = X.CharModel({"  a": 1})
    for word in ("a½x", "abcⅷ", "x²y", "a①"):
        assert X.restored(word, model).split()


def test_words_without_search_have_no_feature():
    """Skipping the lattice search never loses a feature."""
    rng = random.Random(5)
    chars = X.CharModel({"  b": 3, " ba": 3, "bad": 2, "ad ": 2, "  s": 1, " so": 1, "so ": 1})
    words = ["".join(rng.choice("abdos") for _ in range(rng.randint(1, 9)))
             + "".join(rng.choice("$#1!7½&") for _ in range(rng.randint(0, 4))) for _ in range(3000)]
    weights = {f: 1.0 for w in ("bad", "so", "ado", "bass", "dosadobs", "abdoso") for f in X.features(w)}
    model = X.ToxicityModel(chars, weights, 0.0)
    for w in words:
        full = [f for x in X.restored(w, chars).split() for f in X.features(x) if f in weights]
        assert list(model.found(w)) == full, w
        if model.without_search(w) is not None:
            assert list(model.without_search(w)) == full, w
    skipped = [model.without_search(w) for w in words]
    assert None in skipped and any(skipped)


@pytest.mark.parametrize("word,want", [("@$$", "ass"), ("5!+", "sit"), ("$0$", "sos"), ("455", "ass"), ("2021", "2021"), ("$100", "$100"),
                                       ("3.14", "3.14"), ("12:30", "12:30"), ("4111111111111111", "4111111111111111"),
                                       ("!!!", ""), ("+1", "+1")])
def test_words_without_a_letter(word, want):
    grams = X.Counter()
    for w in [*CLEAN, "ass", "sit", "sos", "assist", "site"]:
        for i in range(len(w) + 1):
            grams[f"  {w} "[i:i + 3]] += 5
    chars = X.CharModel(dict(grams))
    assert X.restored(word, chars) == want
    weights = {f: 1.0 for w in ("ass", "sit", "sos") for f in X.features(w)}
    full = [f for x in X.restored(word, chars).split() for f in X.features(x) if f in weights]
    assert list(X.ToxicityModel(chars, weights, 0.0).found(word)) == full and bool(full) == want.isalpha()


def test_search_is_exact_on_ambiguous_words(model):
    rng = random.Random(3)
    for _ in range(20):
        noisy = "".join(rng.choice("!|1l@$5+") for _ in range(7))
        assert math.isclose(X.cheapest(noisy, model)[0], full_search(noisy, model), rel_tol=1e-9)


def test_gram_counts_match_a_plain_count():
    words = Counter({"straße.": 3, "ab": 2, "d'or": 5, "zoo": 1, "baaa": 9, "中文": 4, "ж": 1, "\U0001f600": 2})
    symbols, place = X._alphabet()
    n = len(symbols)
    got = X.gram_counts(words, place, n)
    want = Counter()
    for s, times in (("  straße ", 3), ("  ab ", 2), ("  zoo ", 1), ("  \u0001\u0001 ", 4), ("  \u0001 ", 1)):
        for i in range(len(s) - 2):
            want[s[i:i + 3]] += times
    at = {c: i for i, c in enumerate(symbols)}
    assert {(at[g[0]] * n + at[g[1]]) * n + at[g[2]]: k for g, k in want.items()} == \
        {int(i): int(got[i]) for i in got.nonzero()[0]}
    assert not X.gram_counts(Counter(), place, n).any()


def test_words_of_letters_have_the_features_of_their_restored_reading():
    """The short ways past the lattice give what the lattice gives."""
    words = ["idiot", "stupid", "letter", "address", "hello", "moron", "eerie"]
    chars = X.CharModel(dict(Counter(p[i:i + 3] for w in words for p in [f"  {w} "] for i in range(len(w) + 1))))
    model = X.ToxicityModel(chars, {"=idiot": 1.0, "^stu": 0.5, "=moron": 1.0, "^eri": 0.3}, -1.0)
    seen = ["idiot", "iidiot", "idioooot", "idddiot", "stupid", "sttupid", "stttupid", "letter", "leettter", "hello!!", "(moron)",
            "moroon", "eerie", "eeerie", "erie", "a", "ii", "", "...", "1d10t", "stu", "st", "äääidiot", "idiöt"]
    for w in seen:
        want = tuple(f for x in X.restored(w, chars).split() for f in model.useful(x))
        quick = model.without_search(w)
        assert model.found(w) == (want if quick is None else quick), w
        if quick is not None:
            assert quick == want, w


def test_a_task_makes_few_objects_at_once():
    """Grams are added in place, not by tables of their own; batches are taken in parts."""
    import tracemalloc
    symbols, place = X._alphabet()
    grams = np.zeros(len(symbols) ** 3, np.int64)
    words = Counter({"word": 2, "other": 1})
    tracemalloc.start()
    X.gram_counts(words, place, len(symbols), grams)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < grams.nbytes / 10
    assert (grams == X.gram_counts(words, place, len(symbols))).all() and grams.sum() == 2 * 5 + 6
    batch = pa.RecordBatch.from_arrays([pa.array(range(1203))], names=["x"])
    parts = list(X._pieces([batch]))
    assert max(p.num_rows for p in parts) <= X.ROWS_AT_ONCE
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(1203))
