"""Per-variant statistics and per-fold sufficient statistics of dosages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import hardy_weinberg_variance


def allele_frequency(dosages: DataFrame) -> DataFrame:
    """(variant_idx, n_called, mean, allele_frequency, hwe_variance); a variant without calls has mean and frequency 0."""
    d = dosages.groupBy("variant_idx").agg(F.count("dosage").cast("long").alias("n_called"), F.coalesce(F.avg("dosage"), F.lit(0.0)).alias("mean"))
    d = d.withColumn("allele_frequency", F.col("mean") / 2)
    return d.withColumn("hwe_variance", hardy_weinberg_variance(F.col("allele_frequency")))


def imputed(dosages: DataFrame) -> DataFrame:
    """dosages with missing cells at the variant's mean; the means are one row a variant."""
    means = allele_frequency(dosages).select("variant_idx", "mean")
    return dosages.join(means, "variant_idx").withColumn("dosage", F.coalesce(F.col("dosage").cast("double"), "mean")).drop("mean")


def fold_moments(full: DataFrame, fold) -> DataFrame:
    return full.withColumn("fold", fold).groupBy("variant_idx", "fold").agg(F.count("*").cast("long").alias("n"), F.sum("dosage").alias("total"), F.sum(F.col("dosage") * F.col("dosage")).alias("squares"))


def train_moments(moments: DataFrame) -> DataFrame:
    """Moments of all folds but one, as the total minus that fold's; moments are formed once."""
    whole = lambda c: F.sum(c).over(Window.partitionBy("variant_idx")) - F.col(c)
    return moments.select("variant_idx", "fold", *(whole(c).alias(c) for c in ("n", "total", "squares")))


def frequencies(panel: DataFrame) -> DataFrame:
    """allele_frequency() of a packed panel(variant_idx, d), without a shuffle."""
    called = F.filter("d", lambda x: x.isNotNull())
    n = F.size(called).cast("long")
    mean = F.coalesce(F.try_divide(F.aggregate(called, F.lit(0.0), lambda a, x: a + x), n), F.lit(0.0))
    d = panel.select("variant_idx", n.alias("n_called"), mean.alias("mean"))
    return d.withColumn("allele_frequency", F.col("mean") / 2).withColumn("hwe_variance", hardy_weinberg_variance(F.col("allele_frequency")))


def filled(panel: DataFrame) -> DataFrame:
    """A packed panel with missing cells at the variant's mean, 0 where nothing is called; nothing is shuffled."""
    called = F.filter("d", lambda x: x.isNotNull())
    d = panel.withColumn("_m", F.coalesce(F.try_divide(F.aggregate(called, F.lit(0.0), lambda a, x: a + x), F.size(called)), F.lit(0.0)))
    return d.withColumn("d", F.transform("d", lambda x: F.coalesce(x.cast("double"), F.col("_m")))).drop("_m")


def _dot(x: str, y: str) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


def cross_products(full: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(target_idx, predictor_idx) with n, the sum of the products of their dosages over the samples, both sums and sums
    of squares, for a filled packed panel(variant_idx, d)."""
    one = F.aggregate("d", F.lit(0.0), lambda a, x: a + x)
    m = full.select("variant_idx", "d", one.alias("s"), _dot("d", "d").alias("q"))
    t = m.select(F.col("variant_idx").alias("target_idx"), F.col("d").alias("y"), F.col("s").alias("ys"), F.col("q").alias("yq"))
    p = m.select(F.col("variant_idx").alias("predictor_idx"), F.col("d").alias("z"), F.col("s").alias("zs"), F.col("q").alias("zq"))
    return pairs.join(t, "target_idx").join(p, "predictor_idx").select("target_idx", "predictor_idx", F.size("y").cast("long").alias("n"), _dot("y", "z").alias("product"), "ys", "yq", "zs", "zq")


def single_predictor_fits(full: DataFrame, pairs: DataFrame, alpha: float, l1_ratio: float) -> DataFrame:
    """Closed-form elastic net of each target on its one predictor: (target_idx, predictor_idx, coefficient, intercept, r2)."""
    return closed_form(cross_products(full, pairs), alpha, l1_ratio)


def closed_form(x: DataFrame, alpha: float, l1_ratio: float, *keep: str) -> DataFrame:
    """single_predictor_fits() from the rows of cross_products(), with its columns keep."""
    x = x.withColumns({"sd": F.sqrt(F.greatest(F.col("zq") / F.col("n") - (F.col("zs") / F.col("n")) ** 2, F.lit(0.0)))})
    x = x.withColumn("sd", F.when(F.col("sd") < 1e-8, 1.0).otherwise(F.col("sd")))
    x = x.withColumns({"g": (F.col("zq") - F.col("zs") ** 2 / F.col("n")) / F.col("sd") ** 2, "c": (F.col("product") - F.col("zs") * F.col("ys") / F.col("n")) / F.col("sd")})
    w = F.signum("c") * F.greatest(F.abs("c") - alpha * l1_ratio * F.col("n"), F.lit(0.0)) / (F.col("g") + alpha * (1 - l1_ratio) * F.col("n"))
    x = x.withColumn("w", w).withColumn("yc", F.col("yq") - F.col("ys") ** 2 / F.col("n"))
    r2 = F.when(F.col("yc") > 1e-10, 1 - (F.col("yc") - 2 * F.col("w") * F.col("c") + F.col("w") ** 2 * F.col("g")) / F.col("yc")).otherwise(0.0)
    coef = F.col("w") / F.col("sd")
    return x.select("target_idx", "predictor_idx", coef.alias("coefficient"), (F.col("ys") / F.col("n") - coef * F.col("zs") / F.col("n")).alias("intercept"), r2.alias("r2"), *keep)
