"""PPM over the running text against a plain coder with a dictionary of contexts."""

import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tarmac.llm import ppm_text as P


def is_held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 10 == 0


def symbols(text, order):
    """(context, symbol) of the running text; start marks are line feeds, as is the end."""
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    spelled = b"\n" * 5 + b" " + b"".join(w + b" " for w in re.findall(rb"[^\x20\x09-\x0D]+", low)) + b"\n"
    return [(spelled[i - order:i], spelled[i]) for i in range(6, len(spelled))]


def plain(texts, order):
    seen = defaultdict(lambda: defaultdict(int))
    for t in texts:
        for context, s in symbols(t, order):
            for k in range(order + 1):
                seen[context[order - k:]][s] += 1

    def cost(context, s):
        out, gone = 0.0, set()
        for k in range(order, -1, -1):
            left = {x: n for x, n in seen.get(context[order - k:], {}).items() if x not in gone}
            if not left:
                continue
            whole = sum(left.values()) + (len(left) if len(gone) + len(left) < 256 else 0)
            if s in left:
                return out + math.log10(left[s] / whole)
            out += math.log10(len(left) / whole)
            gone |= left.keys()
        if not gone:
            return math.log10(0.5) if s == 10 else math.log10(0.5 / 255)
        return out - math.log10(256 - len(gone))

    return cost


@pytest.mark.parametrize("order", [6, 2])
def test_scores_are_those_of_a_plain_coder(spark, documents, odd, order, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_BYTES", 20_000)  # many blocks
    more = spark.createDataFrame([(i, t) for i, t in enumerate(
        ["to be or not to be", "To Be\tor not", "", None, "be", "not to be or", "été \U0001f600 x", "a\x00b"] * 4)],
        "doc_id long, text string")
    for df in (documents, odd, more):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        cost = plain([t for d, t in rows if not is_held(d)], order)
        got = P.score_documents(df.select("doc_id", "text"), order=order).collect()
        assert len(got) == len(rows)
        found, wanted = defaultdict(list), defaultdict(list)
        for r in got:
            found[r.doc_id].append(r.score)
        for d, t in rows:
            wanted[d].append(sum(cost(*x) for x in symbols(t, order)))
        assert found.keys() == wanted.keys()
        for d in wanted:
            assert np.allclose(sorted(found[d]), sorted(wanted[d]), rtol=1e-9, atol=1e-9)


def test_contexts_cross_words_and_rare_ones_stay(spark):
    """A context of the word before tells two texts of equal words apart; the old word counts could not."""
    learn = [i for i in range(400) if not is_held(i)]
    rows = [(i, "red sky blue sea") for i in learn[:50]] + [(i, f"w{i} q{i}") for i in learn[50:]]
    held = [i for i in range(1000, 2000) if is_held(i)][:4]
    rows += [(held[0], "red sky blue sea"), (held[1], "red sea blue sky")]
    rows += [(held[2], f"w{learn[60]} q{learn[60]}"), (held[3], f"w{learn[60]} q{learn[61]}")]
    got = {r.doc_id: r.score for r in P.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[held[0]] > got[held[1]] + 1
    assert got[held[2]] > got[held[3]] + 0.5


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(5)
    texts = [P.running(bytes(rng.choice([97, 98, 99, 32], 30).astype(np.uint8))) for _ in range(20)]
    learnt, counts = np.unique(P.grams_of(texts)[0], return_counts=True)
    low = [P.Level(*P.summed((learnt >> 40) << 8 | learnt & 0xFF, counts))]
    for _ in range(2):
        less = P.Level(*P.summed(P.shorter(low[0].pairs), low[0].counts))
        low[0].exclude(less.counts[np.searchsorted(less.pairs, P.shorter(low[0].pairs))])
        low.insert(0, less)
    for context in [*np.unique(learnt >> 8)[::17], 0x7A7A7A7A7A7A, 0x61617A7A7A7A]:
        grams = np.union1d(learnt, (int(context) << 8) + np.arange(256))
        n = np.zeros(len(grams), np.int64)
        n[np.searchsorted(grams, learnt)] = counts
        costs = P.gram_costs(grams, n, low)[grams >> 8 == context]
        assert len(costs) == 256 and math.isclose((10 ** costs).sum(), 1.0, rel_tol=1e-9)
