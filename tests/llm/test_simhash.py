"""Fingerprints and neighbours against plain computations."""

import hashlib
import math
import random
import re

import numpy as np
import xxhash
from samples import WORD
from pyspark.sql import functions as F
from tarmac.llm import simhash as S


def plain_fp(text):
    words = set(re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text)))
    votes, whole = [0] * 128, 0
    for w in words:
        weight = min(len(w), S.LONGEST) ** 2
        whole += weight
        h = xxhash.xxh64_intdigest(w.encode(), 42)
        # Spark folds further arguments into the seed: the int 1 is hashed with the first hash as its seed.
        hs = [h, S_two(w)]
        for k, x in enumerate(hs):
            for b in range(64):
                votes[64 * k + b] += weight * (x >> b & 1)
    return [sum(1 << b for b in range(64) if 2 * votes[64 * k + b] > whole) for k in range(2)]


_two = {}


def S_two(word):
    return _two[word]


def load_second_hashes(spark, texts):
    words = {w for t in texts for w in re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t))}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for r in df.select("w", F.xxhash64("w", F.lit(1)).alias("h")).collect():
        _two[r.w] = r.h & (1 << 64) - 1


def edits(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for i, (d, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        out.append((d, t, t[:len(t) - half] + nxt[:half], nxt))
    return out


def check(spark, df):
    rows = edits([(r.doc_id, r.text or "") for r in df.collect()])
    load_second_hashes(spark, [x for r in rows for x in r[1:]])
    like = lambda a, b: max(0.0, math.cos(math.pi * sum((x ^ y).bit_count() for x, y in zip(a, b)) / 128))
    hexed = lambda fp: "".join(f"{x:016x}" for x in fp)
    want, fps = [], []
    for d, t, e, n in rows:
        a, b, c = plain_fp(t), plain_fp(e), plain_fp(n)
        fps.append(a)
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), hexed(a), hexed(b), round(like(a, b), 9),
                     round(like(a, c), 9)))
    got = S.neighbours(df).collect()
    assert sorted(((*tuple(r)[:5], round(r.near_edited, 9), round(r.near_next, 9)) for r in got), key=str) \
        == sorted(want, key=str)
    for r in got:
        if r.doc_id is None or r.doc_id % 20:
            assert r.n_within is None
        else:
            mine = [int(r.fingerprint[k:k + 16], 16) for k in (0, 16)]
            assert r.n_within == sum(sum((x ^ y).bit_count() for x, y in zip(mine, f)) <= 3 for f in fps) - 1


def test_equals_brute_force(spark, documents):
    check(spark, documents)


def test_odd_rows(spark, odd):
    check(spark, odd.union(odd.withColumn("doc_id", F.lit(40).cast("long"))))


def test_many_buckets(spark, documents, monkeypatch):
    import functools
    monkeypatch.setattr(S, "_ordered", functools.partial(S._ordered, a_bucket=7))
    check(spark, documents)


def test_empty(empty):
    assert S.neighbours(empty).count() == 0


def test_within_finds_all(spark):
    rnd = random.Random(1)
    near = []
    for _ in range(20):
        a = rnd.getrandbits(128)
        near += [a] + [a ^ sum(1 << b for b in rnd.sample(range(128), rnd.randint(1, 5))) for _ in range(8)]
    signed = lambda x: [int(np.uint64(x >> s & (1 << 64) - 1).astype(np.int64)) for s in (0, 64)]
    df = spark.createDataFrame([(signed(x),) for x in near], "fp array<long>")
    for radius, blocks in ((3, 6), (3, 4), (1, 3)):
        got = {(tuple(r.fp), tuple(r.near_fp)) for r in S.within(df, df, radius, blocks).collect()}
        rows = S.within(df, df, radius, blocks).count()
        want = {(tuple(signed(a)), tuple(signed(b))) for a in near for b in near if (a ^ b).bit_count() <= radius}
        assert got == want and rows == len(want)
