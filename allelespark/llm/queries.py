"""One query per operator over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, embeddings, html, media, minhash, mixing, pii, quality, secrets, toxicity

#: The vocabulary of op2; every executor has the package at its own path.
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


ORACLE["op1_mix_sources"] = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM sizes
), filled AS (
  SELECT *, coalesce(sum(source_size) OVER w, 0) AS cum_size, coalesce(sum(weight) OVER w, 0) AS cum_weight,
    row_number() OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST) AS place, sum(source_size) OVER () AS all_size, sum(weight) OVER () AS all_weight
  FROM weighed WINDOW w AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT *, (1.5::DOUBLE * all_size - 2.0::DOUBLE * cum_size) / (all_weight - cum_weight) AS l FROM filled
), level2 AS (
  SELECT source, source_size, weight, (SELECT arg_min(l, place) FROM level WHERE weight * l < 2.0::DOUBLE * source_size) AS l FROM level
), goals AS (
  SELECT source, source_size, coalesce(least(weight * l, 2.0::DOUBLE * source_size), 2.0::DOUBLE * source_size) AS target FROM level2
), classes AS (
  SELECT source, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END + 1 AS wide, CAST(sum(size) AS BIGINT) AS words FROM sized GROUP BY ALL
), spread AS (
  SELECT c.*, g.source_size, g.target,
    coalesce(sum(words) OVER (PARTITION BY c.source ORDER BY wide DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS heavy,
    sum(words * wide) OVER (PARTITION BY c.source ORDER BY wide ROWS UNBOUNDED PRECEDING) AS mass
  FROM classes c JOIN goals g ON c.source IS NOT DISTINCT FROM g.source
), leveled AS (SELECT *, (target - 2.0::DOUBLE * heavy) / nullif(mass, 0) AS l FROM spread),
chosen AS (SELECT source, max_by(l, wide) AS l FROM leveled WHERE wide * l < 2.0::DOUBLE GROUP BY source),
wishes AS (
  SELECT s.*, CASE WHEN source_size > 0 THEN least(wide * coalesce(c.l, 2.0::DOUBLE), 2.0::DOUBLE) ELSE 0.0::DOUBLE END AS wanted
  FROM spread s LEFT JOIN chosen c ON s.source IS NOT DISTINCT FROM c.source
), certain AS (
  SELECT source, wide, source_size, target, CAST(floor(wanted) AS BIGINT) AS whole, wanted - floor(wanted) AS p,
    greatest(CAST(floor(target - sum(CAST(floor(wanted) AS BIGINT) * words) OVER (PARTITION BY source)) AS BIGINT), 0) AS remain
  FROM wishes
), odds AS (
  SELECT d.*, c.source_size, c.target, c.whole, c.p, c.remain,
    (('0x' || substr(md5('1:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 12))::BIGINT::DOUBLE + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM sized d JOIN certain c ON d.source IS NOT DISTINCT FROM c.source AND CASE WHEN d.size > 0 THEN length(bin(d.size)) ELSE 0 END + 1 = c.wide
), drawn AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM odds),
ranked AS (
  SELECT *, q / (1 + q) AS rank FROM drawn
), running AS (
  SELECT *, CASE WHEN p > 0 THEN sum(size) OVER (PARTITION BY source, p > 0 ORDER BY rank, size, doc_id ROWS UNBOUNDED PRECEDING) END AS cum FROM ranked
), stops AS (SELECT source, max(CASE WHEN cum <= remain THEN cum ELSE 0 END) AS held, max(remain) AS remain FROM running WHERE p > 0 GROUP BY source),
best AS (
  SELECT r.source, doc_id, size, rank, row_number() OVER (PARTITION BY r.source ORDER BY abs(size - (s.remain - s.held)), rank, size, doc_id) AS n,
    abs(size - (s.remain - s.held)) < s.remain - s.held AS better
  FROM running r JOIN stops s ON r.source IS NOT DISTINCT FROM s.source WHERE r.cum > s.remain
)
SELECT r.doc_id, r.size, r.source_size, r.target, CAST(r.size * (r.whole + x.e) AS BIGINT) AS taken, CAST(r.whole + x.e AS BIGINT) AS copies
FROM running r LEFT JOIN (SELECT * FROM best WHERE n = 1 AND better) b ON r.source IS NOT DISTINCT FROM b.source AND r.doc_id = b.doc_id AND r.p > 0,
LATERAL (SELECT CASE WHEN r.p > 0 AND (r.cum <= r.remain OR b.doc_id IS NOT NULL) THEN 1 ELSE 0 END AS e) x
"""


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), VOCABULARY)


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_table(spark, sf_dir, "documents"))


@query
def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.95)


@query
def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), k=2, similarity=80)


ORACLE["op5_minhash_near_dedup"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN list_distinct(w)
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words
), sized AS (SELECT doc_id, len(s) AS n, s FROM sets),
shingles AS (SELECT doc_id, n, unnest(s) AS g FROM sized),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id < y.doc_id
    AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM reach r JOIN edges e ON r.node = e.a)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, min(r.root) AS component_id, s.doc_id = min(r.root) AS kept
FROM sized s JOIN reach r ON r.node = s.doc_id GROUP BY s.doc_id, s.n
"""


@query
def op6_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_table(spark, sf_dir, "documents"))


@query
def op8_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


#: Key of op7's replacements; a production run passes its own secret.
PII_KEY = "op7-surrogates"


@query
def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_table(spark, sf_dir, "documents"), PII_KEY)


@query
def op9_quality_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
