"""Scores of uploads as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import count_allele, id_key


def stream_scores(calls: DataFrame, terms: DataFrame) -> DataFrame:
    """(user_id, score, n_used) over a stream of calls(user_id, raw_id, genotype) and the static score terms, kept by user.

    Stream-static join by id, then a stateful sum; its state is one row a user. Write it in update or complete mode.
    """
    t = terms.select(F.lower("variant_id").alias("id"), "effect_allele", "other_allele", "beta")
    d = calls.withColumn("id", id_key(F.col("raw_id"))).join(t, "id")
    n = count_allele(F.col("genotype"), F.col("effect_allele"), F.col("other_allele"))
    return d.withColumn("n", n).groupBy("user_id").agg(F.sum(F.col("n") * F.col("beta")).alias("score"), F.count("n").alias("n_used"))
