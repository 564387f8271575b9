"""Shards: exact round trip, a permutation, fixed strides, resumable reads."""

import glob
import zlib

import numpy as np
import pytest
from tarmac.llm import token_shards as S
from tarmac.session import scratch_path


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 64, 65, 1000, 4097])
def test_feistel_is_a_permutation(n):
    got = S.feistel(np.arange(n), n, "k")
    assert sorted(got.tolist()) == list(range(n))
    if n > 100:
        assert got.tolist() != S.feistel(np.arange(n), n, "other").tolist()
        assert abs(np.corrcoef(np.arange(n), got)[0, 1]) < 0.2


def test_tokenizer_equals_the_library(documents, odd):
    import tiktoken
    tok = S.Tokenizer(S.VOCABULARY)
    ref = tiktoken.Encoding("x", pat_str=S.PATTERN, mergeable_ranks=S.vocabulary(S.VOCABULARY), special_tokens={})
    texts = [r.text for r in documents.collect()] + [r.text for r in odd.collect() if r.text]
    texts += [" a", "a  b", "a ", "  ", "x \n y", "x\n y", "it's 's a", "a  b", "a  b", "don't stop", "1 234 5,6"]
    for t in texts:
        assert np.frombuffer(tok.ids(t), "<u2").tolist() == ref.encode_ordinary(t)


def run(spark, df, length=64, per_shard=32):
    path = scratch_path(spark, "shards-test")
    manifest = S.write_shards(df, path, length, per_shard).collect()
    return path, sorted(manifest, key=lambda r: r.slot)


def test_round_trip(spark, documents, odd):
    tok = S.Tokenizer(S.VOCABULARY)
    for df in (documents, odd):
        path, man = run(spark, df)
        assert [r.slot for r in man] == list(range(len(man)))
        read = {r.slot: r for r in S.read_shards(spark, path, 0, 64, 32).collect()}
        assert sorted(read) == list(range(len(man)))
        ids = []
        for r in sorted(man, key=lambda r: r.number):
            assert read[r.slot].n_ids == r.n_ids == len(read[r.slot].ids)
            ids += read[r.slot].ids
        texts, cur = [], []
        for i in ids:
            if i == tok.end:
                texts.append(cur)
                cur = []
            else:
                cur.append(i)
        assert not cur
        want = [np.frombuffer(tok.ids(r.text or ""), "<u2").tolist() for r in df.collect()]
        assert sorted(texts) == sorted(want)
        # Every record is at its offset, in a file of fixed stride.
        for r in man[:: max(1, len(man) // 20)]:
            (name,) = glob.glob(f"{path.removeprefix('file:')}/shard={r.shard}/part-*")
            with open(name, "rb") as f:
                f.seek(r.byte_offset)
                rec = f.read(S.stride(64))
            assert zlib.crc32(rec[:-1]) == r.crc and rec[-1:] == b"\n"
        later = S.read_shards(spark, path, 40, 64, 32).collect()
        assert sorted(r.slot for r in later) == list(range(40, len(man)))


def test_doc_ids_name_the_documents(spark):
    df = spark.createDataFrame([(i, "word " * (i * 7 % 30)) for i in range(25)], "doc_id long, text string").coalesce(1)
    tok = S.Tokenizer(S.VOCABULARY)
    _, man = run(spark, df, 16, 8)
    spans, at = [], 0
    for r in df.collect():
        n = len(tok.ids(r.text)) // 2 + 1
        spans.append((r.doc_id, at, at + n))
        at += n
    for r in man:
        lo = r.number * 16
        assert list(r.doc_ids) == [d for d, a, b in spans if a < lo + r.n_ids and b > lo]


def test_empty(spark, empty):
    path, man = run(spark, empty)
    assert man == []


def test_written_bytes_keep_the_slots_when_sorts_spill(spark, documents, tmp_path):
    conf = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().conf()
    key, length, per_shard = "spark.shuffle.spill.numElementsForceSpillThreshold", 64, 1000
    conf.set(key, "400")
    try:
        manifest = S.write_shards(documents, str(tmp_path / "shards"), length, per_shard).collect()
    finally:
        conf.remove(key)
    assert len(manifest) > per_shard
    step, bodies = S.stride(length), {}
    for r in manifest:
        if r.shard not in bodies:
            (file,) = (tmp_path / "shards" / f"shard={r.shard}").glob("part-*")
            bodies[r.shard] = file.read_bytes()
        record = bodies[r.shard][r.byte_offset:r.byte_offset + step - 1]
        assert zlib.crc32(record) == r.crc
