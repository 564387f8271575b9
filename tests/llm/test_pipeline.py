"""Stages of the pipeline, and the registered queries against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F
from samples import SF
from tarmac.llm.common import table
from tarmac.llm.queries import ORACLE, QUERIES

import __spark_entry__
import corpus_pipeline


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    sf = "/root/testdata/sf0.01"
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    con.execute(f"CREATE VIEW result AS {ORACLE[name]}")
    res = con.execute("SELECT * FROM result")
    cols = [c[0] for c in res.description]
    want = sorted(map(str, res.fetchall()))
    got = QUERIES[name](spark, sf)
    assert sorted(map(str, (tuple(r) for r in got.select(*cols).collect()))) == want
    assert sorted(got.columns) == sorted(cols)


def test_registered():
    q = __spark_entry__.queries()
    assert set(QUERIES) | {"pipeline"} <= set(q)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontaminate", "mixing", "token_shards"]


def test_stages_keep_the_columns(spark, documents, odd, empty):
    for df in (documents, odd, empty):
        docs = df
        for _, f in corpus_pipeline.STAGES[:-1]:
            docs = f(spark, docs, SF)
            assert docs.columns == df.columns
        if df is empty:
            assert docs.count() == 0


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    ids = {d for r in rows for d in r.doc_ids}
    assert ids <= {r.doc_id for r in table(spark, SF, "documents").collect()}


def test_stages_keep_foreign_columns(spark, documents):
    """Columns named as an operator's own, a map, and rows that differ in one column only come through unchanged."""
    own = {"score": F.lit(7.5), "predicted": F.col("doc_id") + 100, "n_words": F.lit("w"), "n_hit": F.lit(1),
           "n_items": F.lit(2), "hit_items": F.lit("i"), "hit_spans": F.lit(3), "size": F.lit(-1), "fp": F.lit("f"),
           "tie": F.lit("t"), "given_score": F.lit(0), "component_id": F.lit(9),
           "about": F.create_map(F.lit("k"), F.col("lang"), F.lit("n"), F.lit(None).cast("string"))}
    few = documents.filter("doc_id < 40")
    given = few.withColumns(own)
    known = {r.doc_id: r for r in given.collect()}
    docs = given
    for name, f in corpus_pipeline.STAGES[:-1]:
        docs = f(spark, docs, SF)
        assert docs.schema == given.schema, name
        rows = docs.collect()
        assert rows
        for r in rows:
            for c in own:
                assert r[c] == known[r.doc_id][c], (name, c)


def test_mixing_tells_rows_apart_by_all_columns(spark, documents):
    same = documents.filter("doc_id = 3").drop("lang")
    both = same.withColumn("lang", F.lit("en")).unionByName(same.withColumn("lang", F.lit("de")))
    got = dict(corpus_pipeline.mixing_stage(spark, both, SF).groupBy("lang").count().collect())
    assert set(got) == {"en", "de"}


def test_near_dedup_of_rows_with_maps(spark, documents):
    df = documents.limit(30).withColumn("m", F.create_map(F.lit("a"), F.col("doc_id")))
    kept = corpus_pipeline.near_dedup_stage(spark, df.unionByName(df), SF)
    assert kept.count() == corpus_pipeline.near_dedup_stage(spark, documents.limit(30), SF).count()
    assert all(r.m == {"a": r.doc_id} for r in kept.collect())
