"""Pieces against the library, places against brute force, the number of sequences against bounds."""

import random
import zlib
from itertools import combinations_with_replacement

import numpy as np
import public_tokenizers
import pytest
from samples import ODD
from tarmac.llm import packing as K
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def plain(library, rows, length=2048):
    out = []
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        for n, at in enumerate(range(0, len(ids), length)):
            part = ids[at:at + length]
            out.append((doc, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return out


def check(rows, want, length=2048):
    """Every piece is there once and the sequences are gapless; the number of sequences is returned."""
    key = lambda r: str(tuple(r)[:5])
    assert sorted(map(key, rows)) == sorted(map(str, want))
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spots in held.values():
        at = 0
        for o, n in sorted(spots):
            assert o == at
            at += n
        assert at <= length
    assert sorted(held) == list(range(len(held)))
    return len(held)


def falling(sizes, room):
    """First fit decreasing."""
    free = []
    for s in sorted(sizes, reverse=True):
        i = next((i for i, f in enumerate(free) if f >= s), None)
        if i is None:
            free.append(room - s)
        else:
            free[i] -= s
    return len(free)


def test_given_texts(spark, documents, library):
    rows = K.pack(documents).collect()
    want = plain(library, [(r.doc_id, r.text) for r in documents.collect()])
    n = check(rows, want)
    sizes = [w[3] for w in want]
    assert -(-sum(sizes) // 2048) <= n <= falling(sizes, 2048)


def test_odd_rows_clashing_names_and_empty(spark, odd, empty, library):
    want = plain(library, [(r[0], r[1]) for r in ODD])
    more = odd.selectExpr("*", "1 AS length", "'x' AS task", "2 AS nth", "3 AS offset", "4 AS sequence_id")
    for df in (odd, more):
        check(K.pack(df, rounds=20).collect(), want)
    assert K.pack(empty).collect() == []
    short = plain(library, [(r[0], r[1]) for r in ODD], 64)
    check(K.pack(odd, length=64, rounds=20).collect(), short, 64)


def test_tokens_of_strange_texts(library):
    rnd = random.Random(4)
    parts = ["don't", "it's.", "Straße", "ΣΑΣ", "á", "e", "́", "word.,", "...", "x!?", "\x01", "<|endoftext|>", "<",
             "a\x1cb", "\x85", " ", "　", " ", "漢字", "😀", "12.5", "İ", "ﬁ", "ͅ", "\x00", "A" * 300, "'s", "’s", "é!"]
    texts = ["".join(rnd.choice(parts) + rnd.choice(["", " ", "  ", "\n", "\t"]) for _ in range(rnd.randint(0, 40)))
             for _ in range(400)] + ["", " ", "\n"]
    tok = K.Tokenizer("word_bpe_49k.json")
    for some in (texts[:100], texts[100:], texts):
        want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in some]
        assert tok.ids(some) == want


@pytest.mark.parametrize("seed", range(6))
def test_knapsack_and_rounding(seed):
    rnd = random.Random(seed)
    room = 24
    sizes = sorted(rnd.sample(range(1, room), 6))
    price = np.array([rnd.random() for _ in sizes])
    value, choice = K._knapsack(price, np.array(sizes), room)
    best = max(sum(price[sizes.index(s)] for s in p) for k in range(0, room + 1)
               for p in combinations_with_replacement(sizes, min(k, 8)) if sum(p) <= room)
    assert value[room] >= best - 1e-12
    counts = [rnd.choice([1, 3, 50, 400]) for _ in sizes]
    plan = K.rounded(sizes, counts, K.configurations(sizes, counts, room, 40), room)
    held = dict.fromkeys(sizes, 0)
    for p, n in plan:
        assert sum(p) <= room and n > 0
        for s in p:
            held[s] += n
    assert list(held.values()) == counts
    flat = [s for s, n in zip(sizes, counts) for _ in range(n)]
    assert sum(n for _, n in plan) <= falling(flat, room) + 1


def test_a_program_that_decreasing_fit_does_not_solve():
    """6 x (51, 27, 22) fills sequences of 100; taking the longest that fits leaves waste."""
    sizes, counts, room = [22, 26, 27, 51], [600, 0, 600, 600], 100
    used = [(s, n) for s, n in zip(sizes, counts) if n]
    plan = K.rounded(*zip(*used), K.configurations(*zip(*used), room, 60), room)
    assert sum(n for _, n in plan) == 600
