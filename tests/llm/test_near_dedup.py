"""SimHash groups against a plain per-text computation, all pairs and union by search."""

import random
import re

import numpy as np
import xxhash

from samples import WORD
from pyspark.sql import functions as F
from tarmac.llm import near_dedup as N


def plain_fp(text):
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows):
    fps = [(d, plain_fp(t)) for d, t in rows]
    parent = list(range(len(fps)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 3:
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return sorted(((d, f"{fp:016x}", least.get(top(i))) for i, (d, fp) in enumerate(fps)), key=str)


def got(df):
    return sorted((tuple(r) for r in N.near_duplicates(df).collect()), key=str)


def test_equals_brute_force(documents, odd):
    for df in (documents, odd):
        assert got(df) == plain_groups([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])


def test_empty_table(empty):
    assert got(empty) == []


def test_hash_is_sparks(spark):
    assert spark.sql("select xxhash64('a b c')").first()[0] & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c", 42)


def test_links_of_random_fingerprints(spark):
    """Chains, stars and dense groups, with chunks small enough that groups are compared in blocks."""
    rnd = random.Random(5)
    fps = set()
    for _ in range(12):
        base = rnd.getrandbits(64)
        for _ in range(60):
            x = base
            for _ in range(rnd.randint(0, 5)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    parent = {x: x for x in fps}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[top(a)] = top(b)
    for segments, chunk in ((2, 4096), (2, 8), (4, 16), (1, 4096)):
        if segments == 1:
            continue
        roots = {r.node: r.root for r in N.components(N.links(df, 3, segments, chunk)).collect()}
        u = lambda x: int(np.int64(x).view(np.uint64))
        groups = {}
        for x in signed:
            groups.setdefault(roots.get(x, x), set()).add(u(x))
        want = {}
        for x in fps:
            want.setdefault(top(x), set()).add(x)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_drop_keeps_one_of_each_group(documents):
    """By doc_id, where these are unique; rows without or with shared ids are compared below, by row."""
    kept = N.drop_near_duplicates(documents)
    assert kept.columns == documents.columns
    want = {c for _, _, c in plain_groups([(r.doc_id, r.text) for r in documents.collect()])}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_drop_keeps_the_texts_of_every_group(spark, documents, odd):
    """Also of groups whose doc_ids are all null or belong to another group too."""
    extra = spark.createDataFrame([(None, "rows without an id that are no copy of others", None, "b", 1),
                                   (None, "rows without an id that are no copy of others", "b", None, 1),
                                   (4, None, None, None, None), (8, "a wholly different text of the eighth", "en", "c", 1),
                                   (5, "no id at all here", "en", "b", 17)], odd.schema)
    for df in (documents, odd, odd.union(extra).union(extra)):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        fps = [plain_fp(t) for _, t in rows]
        group = list(range(len(rows)))
        for i in range(len(rows)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 3 and group[i] != group[j]:
                    group = [group[j] if g == group[i] else g for g in group]
        want = {}
        for (d, t), g in zip(rows, group):
            want.setdefault(g, []).append((d is None, d or 0, t))
        kept = [(r.doc_id is None, r.doc_id or 0, r.text) for r in N.drop_near_duplicates(df).collect()]
        assert len(kept) == len(want)
        for members in want.values():
            got = [k for k in kept if k in members]
            assert len(got) == 1 and got[0][:2] == min(m[:2] for m in members)
    texts = {r.text for r in N.drop_near_duplicates(odd).collect()}
    assert {"dup row of other words entirely", "dup row of some words"} <= texts


def test_clashing_names(documents):
    df = documents.limit(20).withColumn("fp", F.lit(1)).withColumn("component_id", F.lit("x"))
    assert N.near_duplicates(df).columns == ["doc_id", "fingerprint", "component_id"]
    assert N.drop_near_duplicates(df).columns == df.columns
