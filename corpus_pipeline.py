"""The corpus pipeline: each stage calls one operator on all that its predecessor kept; part of subpackage llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelespark.llm import bpe, minhash, mixing, secrets, toxicity
from allelespark.llm.common import cut, small, store
from allelespark.llm.queries import VOCABULARY


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon learned from the labels doesn't reject. Null and empty texts have no hit and stay, rows that
    repeat share their fate, an empty table stays empty; without labels of both kinds the built-in entries decide."""
    return toxicity.reject(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares five-word shingles at a similarity of 0.8. Documents without words and rows
    without a doc_id stay, rows that repeat a doc_id share its fate, an empty table stays empty."""
    found = cut(minhash.near_duplicates(docs, k=5, similarity=80).filter(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct())
    return docs.join(small(found), "doc_id", "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret in their texts replaced by a mark; null and empty texts stay as they are, repeated rows are
    treated alike, an empty table stays empty."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice. Null texts have no words and are taken by their rank,
    rows that repeat a doc_id share the greatest number of copies, a null doc_id is one id, an empty table stays empty."""
    taken = mixing.mix(docs).groupBy(F.col("doc_id").alias("taken_id")).agg(F.max("copies").cast("int").alias("taken_copies"))
    taken = cut(taken.filter("taken_copies > 0"))
    out = docs.join(small(taken), docs["doc_id"].eqNullSafe(taken["taken_id"]))
    return out.withColumn("taken_copy", F.explode(F.sequence(F.lit(1), "taken_copies"))).select(*(docs[c] for c in docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token ids and slice offsets, with the digests of the ids and of what they decode to; null and empty texts
    have no ids, a row for each row, an empty table gives an empty result."""
    return bpe.encode(docs, VOCABULARY, full=True)


STAGES = [("toxicity", toxic), ("minhash_near_dedup", near_dedup), ("secret_scan", secret_scan), ("mix_sources", mix_sources), ("byte_bpe", encode)]

#: The lexicon is learned and the ids come from a vocabulary file, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = store(docs)
    return docs
