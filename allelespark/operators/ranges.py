"""Range joins over positions, nearest neighbours and merged regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def window_pairs(targets: DataFrame, predictors: DataFrame, window: int) -> DataFrame:
    """Pairs (target_idx, predictor_idx, distance) on one chromosome with |distance| <= window, a variant never with itself.

    targets and predictors(variant_idx, chromosome, position), chromosomes normalised. Positions fall in bins of the window's
    width; a predictor meets the targets of its own and both neighbouring bins, so the join is an equi-join with a bounded
    fan-out of three instead of a comparison of all positions.
    """
    width = max(window, 1)
    t = targets.select(F.col("variant_idx").alias("target_idx"), "chromosome", F.col("position").alias("t_pos"), F.floor(F.col("position") / width).alias("bin"))
    p = predictors.select(F.col("variant_idx").alias("predictor_idx"), "chromosome", F.col("position").alias("p_pos"), F.explode(F.sequence(F.floor(F.col("position") / width) - 1, F.floor(F.col("position") / width) + 1)).alias("bin"))
    out = t.join(p, ["chromosome", "bin"]).withColumn("distance", F.abs(F.col("t_pos") - F.col("p_pos")))
    return out.filter((F.col("distance") <= window) & (F.col("target_idx") != F.col("predictor_idx"))).select("target_idx", "predictor_idx", "distance")


def nearest(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest predictors of each target with their rank, by distance, then predictor_idx."""
    w = Window.partitionBy("target_idx").orderBy("distance", "predictor_idx")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def merge_windows(variants: DataFrame, window: int) -> DataFrame:
    """(chromosome, start, end, n_variants) of the merged windows around variants; touching windows are one region.

    The running maximum of ends is taken within a chromosome, whose variants are sorted in one task: a few million at most.
    """
    v = variants.select("chromosome", F.greatest(F.lit(0), F.col("position") - window).alias("start"), (F.col("position") + window).alias("end"))
    w = Window.partitionBy("chromosome").orderBy("start", "end")
    v = v.withColumn("reach", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    v = v.withColumn("region", F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return v.groupBy("chromosome", "region").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_variants")).withColumn("region", F.col("region").cast("long"))


def region_predictors(regions: DataFrame, predictors: DataFrame, k: int | None = None) -> DataFrame:
    """(chromosome, region, predictor_idx, distance): predictors inside each region, the k nearest to its centre if k is
    given. Regions of a chromosome are disjoint, so each predictor falls in one at most: the last that starts before it,
    which one sorted pass over both tables finds."""
    p = predictors.select("chromosome", F.col("position").alias("at"), F.lit(1).alias("kind"), F.col("variant_idx"), F.lit(None).cast("struct<region:bigint,start:bigint,end:bigint>").alias("r"))
    r = regions.select("chromosome", F.col("start").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("variant_idx"), F.struct(F.col("region").cast("long").alias("region"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).alias("r"))
    w = Window.partitionBy("chromosome").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    d = p.unionByName(r).withColumn("r", F.last("r", ignorenulls=True).over(w)).filter("kind = 1 and r is not null and at <= r.end")
    d = d.select("chromosome", "r.region", F.col("variant_idx").alias("predictor_idx"), F.abs(F.col("at") - F.floor((F.col("r.start") + F.col("r.end")) / 2)).alias("distance"))
    if k is None:
        return d
    rank = F.row_number().over(Window.partitionBy("chromosome", "region").orderBy("distance", "predictor_idx"))
    return d.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")
