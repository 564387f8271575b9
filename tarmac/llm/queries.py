"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm import (decontaminate, html_density, kmeans, mixing, near_dedup, packing, phrases, pii, ppm, simhash,
                        token_shards, toxicity, url_filter)
from tarmac.llm.common import fold, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.training_rows())
    out = toxicity.score(docs, model)
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.neighbours(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of the shards written, one row per sequence."""
    return token_shards.materialise(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the number of values by kind, the pseudonyms in text order and a digest of the new text."""
    out = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    def number(kind):
        return F.size(F.filter("values", lambda v: v["kind"] == kind)).cast("long").alias(f"n_{kind}")

    kinds = [number(k) for k in pii.KINDS]
    return out.select("doc_id", *kinds, F.transform("values", lambda v: v["pseudonym"]).alias("pseudonyms"),
                      F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
                      F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.mark(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", decontaminate.items_digest().alias("items_sha256"),
                      decontaminate.contaminated().alias("contaminated"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.cluster(table(spark, sf_dir, "embeddings"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents").select("text", "lang"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_fingerprints, op3_url_filter, op4_near_dedup, op5_token_shards,
                                   op6_mixing, op7_lm_score, op8_html_text, op9_pseudonyms, op10_decontaminate,
                                   op11_packing, op12_clusters, op13_phrases)}

# The blocks of the schedule cover each source's repeated stream up to its quota once, so what a document gives is
# the overlap of its places in the stream with the quota.
MIXING_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM sized GROUP BY source),
level AS (
  SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - 2.0::DOUBLE * CAST(coalesce(
              sum(source_size) OVER need, 0) AS DOUBLE))
            / CAST(sum(w) OVER () - coalesce(sum(w) OVER need, 0) AS DOUBLE) AS level
  FROM src
  WINDOW need AS (ORDER BY CAST(source_size AS DOUBLE) / w, source ASC NULLS LAST
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
opened AS (
  SELECT min_by(level, CAST(source_size AS DOUBLE) / w) AS open FROM level WHERE level * w <= 2 * source_size),
goal AS (
  SELECT source, source_size,
         CASE WHEN level * w > 2 * source_size THEN source_size * 2.0::DOUBLE ELSE open * w END AS target
  FROM level CROSS JOIN opened),
quota AS (
  SELECT *, least(CAST(floor(target + 0.5) AS BIGINT), 2 * source_size) AS quota FROM goal),
streamed AS (
  SELECT s.*, q.source_size, q.target, q.quota,
         CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source
              ORDER BY md5('mix|' || coalesce(CAST(s.doc_id AS VARCHAR), 'null')), s.doc_id, s.size
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sized s JOIN quota q ON s.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
       greatest(least(quota - start, size), 0)
       + greatest(least(quota - start - source_size, size), 0) AS taken
FROM streamed
"""

DECONTAMINATE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
spots AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, spots.n, i, item FROM spots JOIN win USING (g) WHERE spots.n = win.n),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit
          FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_ROUND_SQL = r"""
d{n} AS MATERIALIZED (
  SELECT rid, c, CAST(sum((v.q - t.q) * (v.q - t.q)) AS BIGINT) AS dist
  FROM v JOIN c{n} t USING (pos) GROUP BY rid, c),
a{n} AS MATERIALIZED (
  SELECT rid, c, dist FROM d{n} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY dist, c) = 1)"""
_MOVED_SQL = r"""
c{m} AS MATERIALIZED (
  SELECT t.c, t.pos, coalesce(g.q, t.q) AS q
  FROM c{n} t LEFT JOIN (
    SELECT c, pos, CAST((sum(q) - ((sum(q) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS q
    FROM a{n} JOIN v USING (rid) GROUP BY c, pos) g ON g.c = t.c AND g.pos = t.pos)"""


def clusters_sql(k: int = kmeans.K, rounds: int = kmeans.ROUNDS, seed: int = kmeans.SEED) -> str:
    """The rounds written out one after the other; vectors as (row, place, integer)."""
    steps = []
    for n in range(rounds):
        steps += [_ROUND_SQL.format(n=n), _MOVED_SQL.format(n=n, m=n + 1)]
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {kmeans.DIMS}
    AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = {kmeans.DIMS}),
v AS MATERIALIZED (
  SELECT rid, pos, CAST(floor({int(kmeans.SCALE)} * CAST(embedding[pos] AS DOUBLE)) AS BIGINT) AS q
  FROM kept, (SELECT unnest(range(1, {kmeans.DIMS + 1})) AS pos)),
first AS (
  SELECT rid, row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR))) - 1 AS c FROM kept
  QUALIFY c < {k}),
c0 AS MATERIALIZED (SELECT c, pos, q FROM first JOIN v USING (rid)),{",".join(steps)},{_ROUND_SQL.format(n=rounds)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, dist AS distance,
       CAST(sum(dist) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(dist) OVER () AS BIGINT) AS inertia, sha AS centroid_sha256
FROM a{rounds} JOIN kept USING (rid) JOIN (
  SELECT c, sha256(string_agg(CAST(q AS VARCHAR), ',' ORDER BY pos)) AS sha FROM c{rounds} GROUP BY c) USING (c)
"""


PHRASES_SQL = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS pid, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
spots AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i
        FROM pieces, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(w) >= m)),
freq AS MATERIALIZED (SELECT lang, m, g, count(*) AS f FROM spots GROUP BY lang, m, g HAVING count(*) >= 100),
sizes AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
longer AS (
  SELECT lang, g, max(f) AS f FROM (
    SELECT lang, f, array_to_string(string_split(g, ' ')[i:i + s - 1], ' ') AS g
    FROM (SELECT *, unnest(range(1, m - s + 2)) AS i
          FROM (SELECT *, unnest(range(2, m)) AS s FROM freq WHERE m > 2))) GROUP BY lang, g),
cand AS (
  SELECT c.lang, c.m, c.g, c.f AS a, n FROM freq c JOIN sizes USING (lang)
  LEFT JOIN longer o ON o.lang = c.lang AND o.g = c.g
  WHERE c.m > 1 AND (o.f IS NULL OR 100 * o.f < 100 * c.f)),
cuts AS (
  SELECT *, array_to_string(string_split(g, ' ')[:k], ' ') AS p, array_to_string(string_split(g, ' ')[k + 1:], ' ') AS q
  FROM (SELECT *, unnest(range(1, m)) AS k FROM cand)),
valued AS (
  SELECT c.*, x.f AS l, y.f AS r, CAST(1000::HUGEINT * a * n // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts c JOIN freq x ON x.lang = c.lang AND x.g = c.p JOIN freq y ON y.lang = c.lang AND y.g = c.q),
best AS (SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(g)) AS rank, g AS phrase,
       CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, score
FROM best QUALIFY rank <= 2000
"""

ORACLE = {"op6_mixing": MIXING_SQL, "op10_decontaminate": DECONTAMINATE_SQL,
          "op12_clusters": clusters_sql(), "op13_phrases": PHRASES_SQL}
