"""The mix against a plain water filling and stream walk; the SQL is compared by the oracle test."""

import hashlib
import re
from collections import defaultdict

from samples import WORD
from pyspark.sql import functions as F
from tarmac.llm import mixing as M


def n_words(t):
    return len(re.findall(WORD, t or ""))


def plain_targets(rows):
    size = defaultdict(int)
    for _, s, t in rows:
        size[s] += n_words(t)
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(size.values()), set(names), {}
    while True:
        total = sum(w[s] for s in open_)
        full = [s for s in open_ if left * w[s] / total > 2 * size[s]]
        if not full:
            return size, out | {s: left * w[s] / total for s in open_}
        for s in full:
            out[s] = 2.0 * size[s]
            left -= out[s]
            open_.discard(s)


def check(df):
    rows = [(r.doc_id, r.source, r.text) for r in df.collect()]
    size, goal = plain_targets(rows)
    got = M.taken(df).collect()
    assert len(got) == len(rows)
    by_id = defaultdict(list)
    for d, s, t in rows:
        by_id[d].append((n_words(t), size[s], s))
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        match = [x for x in by_id[r.doc_id] if x[:2] == (r.size, r.source_size)]
        assert match, r
        assert any(abs(r.target - goal[x[2]]) < 1e-6 for x in match)
        taken[match[0][2]] += r.taken
    for s in goal:
        if sum(x[2] == s for v in by_id.values() for x in v):
            assert abs(taken[s] - goal[s]) <= 1, s
    return got


def test_targets_and_limits(documents, odd):
    check(documents)
    check(odd)


def test_reruns_agree_and_empty(documents, empty):
    a, b = (sorted(map(tuple, M.taken(d).collect())) for d in (documents, documents.repartition(7)))
    assert a == b
    assert M.taken(empty).count() == 0 and M.mixed_documents(empty).count() == 0


def test_schedule_is_low_discrepancy(documents):
    rows = M.sized(documents).select("doc_id", "source", "size", M.row_key().alias("tie"))
    goal = M.targets(rows)
    plan = [(r.slot, r.source, r.rank) for r in M.schedule(goal, 16).orderBy("slot").collect()]
    want = {r.source: -(-r.quota // 16) for r in goal.collect()}
    seen = defaultdict(list)
    for _, s, k in plan:
        seen[s].append(k)
    assert {s: sorted(k) for s, k in seen.items()} == {s: list(range(n)) for s, n in want.items() if n}
    assert all(k == sorted(k) for k in seen.values())
    total, upto, n = sum(want.values()), defaultdict(int), 0
    for slot, s, _ in plan:
        n += 1
        upto[s] += 1
        assert abs(upto[s] - n * want[s] / total) < 12


def test_mixed_documents_hold_the_words_taken(documents, odd):
    for df in (documents, odd):
        out = M.mixed_documents(df)
        assert out.schema == df.schema
        got, want = defaultdict(int), defaultdict(int)
        for r in out.collect():
            got[r.doc_id] += n_words(r.text)
            assert r.n_chars == len(r.text)
        for r in M.taken(df).collect():
            want[r.doc_id] += r.taken
        assert dict(got) == {k: v for k, v in want.items() if v}


def test_extra_columns(documents):
    df = documents.limit(30).withColumn("size", F.lit("mine")).withColumn("target", F.lit(0))
    assert M.taken(df).count() == 30
    assert M.mixed_documents(df).columns == df.columns


def test_order_key_is_md5():
    assert hashlib.md5(b"mix|1").hexdigest()[:3]  # the SQL uses the same key
