"""Calibration and agreement of estimated with true scores."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import normalize_chromosome


def valid(scores: DataFrame) -> DataFrame:
    """Samples whose truth and estimate are both numbers."""
    ok = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in ("truth", "estimate")]
    return scores.filter(ok[0] & ok[1])


def calibration(scores: DataFrame) -> DataFrame:
    """One row: the regression of truth on estimate with the slope's error, r2, spreads (ddof 1), attenuation and the residual
    spread before (raw_residual_sd) and after it (residual_sd); null where a spread is zero or fewer than 3 samples count."""
    d = valid(scores).agg(
        F.regr_slope("truth", "estimate").alias("slope"), F.regr_intercept("truth", "estimate").alias("intercept"), F.regr_r2("truth", "estimate").alias("r2"),
        F.stddev_samp("truth").alias("sd_true"), F.stddev_samp("estimate").alias("sd_estimate"), F.stddev_samp(F.col("truth") - F.col("estimate")).alias("raw_residual_sd"),
        F.count("*").cast("long").alias("n"),
    )
    rest = F.greatest(1 - F.col("r2"), F.lit(0.0)) * (F.col("n") - 1) * F.col("sd_true") ** 2
    d = d.withColumns({
        "slope_se": F.sqrt(F.try_divide(rest, F.col("n") - 2) / F.nullif((F.col("n") - 1) * F.col("sd_estimate") ** 2, F.lit(0.0))),
        "sd_scaled": F.abs("slope") * F.col("sd_estimate"), "attenuation": F.col("sd_estimate") / F.nullif("sd_true", F.lit(0.0)),
        "residual_sd": F.coalesce(F.sqrt(F.try_divide(rest, F.col("n") - 1)), "raw_residual_sd"),
    })
    return d.select(*(c if c == "n" else F.when(F.col("n") >= 3, F.col(c)).alias(c) for c in d.columns))


def estimate_calibration(scores: DataFrame) -> dict:
    """calibration() as a dict; ValueError below 3 samples. Where the estimate doesn't vary the slope is 1, its error and r2
    are 0 and the intercept is the difference of the means."""
    c = calibration(scores).first().asDict()
    if c["n"] < 3:
        raise ValueError(f"{c['n']} samples are too few to calibrate; 3 are needed")
    if c["slope"] is None or not math.isfinite(c["slope"]):
        off = valid(scores).agg(F.avg(F.col("truth") - F.col("estimate"))).first()[0]
        c |= {"slope": 1.0, "intercept": off, "r2": 0.0, "slope_se": 0.0, "sd_scaled": c["sd_estimate"], "residual_sd": c["raw_residual_sd"]}
    return c


def with_theory(c: dict, models: DataFrame) -> dict:
    """A calibration with theoretical_sd: the root of the models' summed variances, beta² times residual_variance of targets or
    cv_mse of regions."""
    v = F.when(F.col("role") == "region", F.col("cv_mse")).otherwise(F.col("beta") ** 2 * F.col("residual_variance"))
    total = models.filter("role in ('target', 'region')").agg(F.sum(v)).first()[0]
    return c | {"theoretical_sd": math.sqrt(max(total or 0.0, 0.0))}


def standard_error(terms: DataFrame) -> DataFrame:
    """One row: the root of the summed beta² times residual_variance of terms(beta, residual_variance)."""
    return terms.agg(F.sqrt(F.coalesce(F.sum(F.col("beta") ** 2 * F.col("residual_variance")), F.lit(0.0))).alias("se"))


def quality_summary(models: DataFrame) -> DataFrame:
    """One row over models(r2, beta): how many there are in each tier, mean, median, least and greatest r2 and the mean weighted
    by |beta|, unweighted where all betas are 0."""
    r, w = F.col("r2"), F.abs("beta")
    when = lambda c: F.count(F.when(c, 1)).cast("long")
    return models.agg(
        F.count("*").cast("long").alias("n_models"), when(r > 0.8).alias("n_high"), when((r > 0.6) & (r <= 0.8)).alias("n_good"), when((r > 0.4) & (r <= 0.6)).alias("n_moderate"), when(r <= 0.4).alias("n_low"),
        F.avg(r).alias("mean_r2"), F.median(r).alias("median_r2"), F.min(r).alias("min_r2"), F.max(r).alias("max_r2"), F.coalesce(F.try_divide(F.sum(r * w), F.sum(w)), F.avg(r)).alias("weighted_r2"),
    )


def quantile_bins(d: DataFrame, column: str, bins: int, name: str) -> DataFrame:
    """d with name, the bin of column among the interior quantiles (linear between ranks), 0 to bins - 1."""
    if bins < 2:
        return d.withColumn(name, F.lit(0))
    edges = d.agg(F.percentile(column, F.array(*(F.lit(i / bins) for i in range(1, bins)))).alias("_e"))
    return d.join(F.broadcast(edges)).withColumn(name, F.when(F.col(column).isNotNull(), F.size(F.filter("_e", lambda e: e <= F.col(column))))).drop("_e")


def variant_strata(variants: DataFrame, bins: int = 3) -> DataFrame:
    """variants(chromosome, allele_frequency, beta) with stratum: chromosome, bin of the minor allele's frequency and of |beta|."""
    q = F.coalesce("allele_frequency", F.lit(0.0))
    d = quantile_bins(variants.withColumns({"_maf": F.least(q, 1 - q), "_b": F.abs("beta")}), "_maf", bins, "_mb")
    d = quantile_bins(d, "_b", bins, "_bb")
    return d.withColumn("stratum", F.concat_ws(":", normalize_chromosome(F.col("chromosome")), "_mb", "_bb")).drop("_maf", "_b", "_mb", "_bb")


def stratified_sample(items: DataFrame, n_target: int | None, seed: int = 42, key: str = "unit_id") -> DataFrame:
    """n_target rows of items(key, stratum) at most: each stratum fills its quota in the order of a seeded hash of key. All rows
    where there are no more than n_target."""
    if n_target is None:
        return items
    quota = stratified_quotas(items, n_target).select("stratum", F.least("quota", "n").alias("quota"))
    order = F.row_number().over(Window.partitionBy("stratum").orderBy(F.xxhash64(F.lit(seed), key), key))
    return items.withColumn("_k", order).join(quota, "stratum").filter(F.col("_k") <= F.col("quota")).drop("_k", "quota").select(*items.columns)


def average_rank(d: DataFrame, column: str, parts: int = 64) -> DataFrame:
    """(column, rank) of each distinct value, ties sharing the mean of their ranks.

    Values are counted first, then ranked within the parts that approximate quantiles cut, each part behind the counts of
    those below it: no task sorts all rows, and equal values never meet as rows.
    """
    v = d.groupBy(column).agg(F.count("*").alias("k"))
    edges = v.agg(F.percentile_approx(column, [i / parts for i in range(1, parts)], F.lit(1000)).alias("edges"))
    v = v.join(F.broadcast(edges)).withColumn("part", F.size(F.filter("edges", lambda e: e < F.col(column)))).drop("edges")
    below = v.groupBy("part").agg(F.sum("k").alias("all")).select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("below"))
    before = F.sum("k").over(Window.partitionBy("part").orderBy(column))
    return v.join(F.broadcast(below), "part").select(column, (F.col("below") + before - F.col("k") + (F.col("k") + 1) / 2).alias("rank"))


def ranked(d: DataFrame, *columns: str, parts: int = 64) -> DataFrame:
    """d with rank_ of each column, ties sharing the mean of their ranks; columns hold no nulls. d is read three times.

    Edges from approximate quantiles cut the values into buckets, those between two edges and those equal to one. Ranks are the
    counts of the buckets below, which one small job gives for all columns, and the place in a window over the own bucket. A
    value of many rows is an edge: its rows share one rank, known from the counts, and are dealt over many windows.
    """
    at, n = [F.lit(i / parts) for i in range(1, parts)], 2 * parts - 1
    edges = d.agg(*(F.array_distinct(F.percentile_approx(c, F.array(*at), F.lit(1000))).alias(f"_e{i}") for i, c in enumerate(columns)))
    bucket = lambda i, c: 2 * F.size(F.filter(f"_e{i}", lambda e: e < F.col(c))) + F.array_contains(f"_e{i}", F.col(c)).cast("int")
    b = d.join(F.broadcast(edges)).select(*d.columns, *(bucket(i, c).alias(f"_b{i}") for i, c in enumerate(columns)))
    counts = b.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"_b{i}").alias("b")) for i in range(len(columns))))).alias("x")).groupBy("x.i", "x.b").agg(F.count("*").alias("n"))
    all_ = F.collect_list(F.struct("i", "b", "n"))
    total = lambda i, ok: F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: F.aggregate(F.filter("_a", lambda x: (x["i"] == i) & ok(x["b"], k)), F.lit(0).cast("long"), lambda s, x: s + x["n"]))
    below = counts.agg(all_.alias("_a")).select(*(f for i in range(len(columns)) for f in (total(i, lambda b, k: b < k).alias(f"_l{i}"), total(i, lambda b, k: b == k).alias(f"_n{i}"))))
    out, names = b.join(F.broadcast(below)), [*d.columns]
    for i, c in enumerate(columns):
        of, alone = F.col(f"_b{i}"), F.col(f"_b{i}") % 2 == 1
        w = Window.partitionBy(f"_b{i}", "_s").orderBy(c)
        upto, ties = (F.count("*").over(w.rangeBetween(a, Window.currentRow)) for a in (Window.unboundedPreceding, Window.currentRow))
        place = F.when(alone, (F.get(f"_n{i}", of) + 1) / 2).otherwise(upto - ties + (ties + 1) / 2)
        names.append(f"rank_{c}")
        out = out.withColumn("_s", F.when(alone, F.monotonically_increasing_id() % parts).otherwise(0)).withColumn(names[-1], F.get(f"_l{i}", of) + place)
    return out.select(*names)


def agreement(scores: DataFrame) -> DataFrame:
    """One row: Pearson r and its square, MAE, RMSE, Spearman's rho by average ranks, mean and spread of truth - estimate, slope
    and intercept of truth on estimate, and the number of samples; all but that null below 3 samples."""
    d = ranked(valid(scores).persist(), "truth", "estimate")  # a row a sample, read three times
    error = F.col("truth") - F.col("estimate")
    out = d.agg(
        F.count("*").cast("long").alias("n"), F.regr_slope("truth", "estimate").alias("slope"), F.regr_intercept("truth", "estimate").alias("intercept"), F.corr("estimate", "truth").alias("pearson"), F.pow(F.corr("estimate", "truth"), F.lit(2)).alias("r2"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error**2)).alias("rmse"),
        F.corr("rank_truth", "rank_estimate").alias("spearman"), F.avg(error).alias("mean_error"), F.stddev_samp(error).alias("sd_error"),
    )
    return out.select(*(c if c == "n" else F.when(F.col("n") >= 3, F.col(c)).alias(c) for c in out.columns))


def concordance(scores: DataFrame, percents=(1, 5, 10)) -> DataFrame:
    """(percent, top, bottom): of the samples in the estimated top (bottom) percent, the share that is also in the true one."""
    d = valid(scores)
    cuts = d.agg(*(F.percentile(c, F.array(*(F.lit(x) for p in percents for x in (1 - p / 100, p / 100)))).alias(c) for c in ("truth", "estimate")))
    each = [F.struct(F.lit(float(p)).alias("percent"), *(F.get(c, F.lit(2 * i + low)).alias(f"{c[0]}{'hl'[low]}") for c in ("truth", "estimate") for low in (0, 1))) for i, p in enumerate(percents)]
    d = d.join(F.broadcast(cuts.select(F.array(*each).alias("e")))).select("truth", "estimate", F.inline("e"))
    both = lambda a, b: F.count(F.when(a & b, 1)) / F.count(F.when(b, 1))
    top, bottom = both(F.col("truth") >= F.col("th"), F.col("estimate") >= F.col("eh")), both(F.col("truth") <= F.col("tl"), F.col("estimate") <= F.col("el"))
    return d.groupBy("percent").agg(top.alias("top"), bottom.alias("bottom"))


def quintile_kappa(scores: DataFrame) -> DataFrame:
    """One row: Cohen's kappa of the quintiles that the interior percentiles of each score cut."""
    scores = valid(scores)
    cuts = [0.2, 0.4, 0.6, 0.8]
    edges = scores.agg(*(F.percentile(c, F.array(*map(F.lit, cuts))).alias(f"{c}_cuts") for c in ("truth", "estimate")))
    bin_ = lambda c: sum(((F.col(c) >= F.get(f"{c}_cuts", F.lit(i))).cast("int") for i in range(4)), F.lit(0))
    d = scores.join(F.broadcast(edges)).select(bin_("truth").alias("a"), bin_("estimate").alias("b"))
    rows = d.groupBy().agg(F.count("*").cast("long").alias("n"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("po"), *(F.avg((F.col(c) == k).cast("double")).alias(f"{c}{k}") for c in "ab" for k in range(5)))
    pe = sum((F.col(f"a{k}") * F.col(f"b{k}") for k in range(5)), F.lit(0.0))
    return rows.select(F.when(pe == 1, F.when(F.col("po") == 1, 1.0).otherwise(0.0)).otherwise((F.col("po") - pe) / (1 - pe)).alias("kappa"), "n")


def stratified_quotas(strata: DataFrame, n_target: int) -> DataFrame:
    """(stratum, n, quota): proportional shares of n_target, the rest to the largest remainders, ties by stratum."""
    s = strata.groupBy("stratum").agg(F.count("*").cast("long").alias("n"))
    s = s.withColumn("exact", F.col("n") * n_target / F.sum("n").over(Window.partitionBy()))
    s = s.withColumns({"base": F.floor("exact").cast("long"), "rank": F.row_number().over(Window.orderBy((F.col("exact") - F.floor("exact")).desc(), "stratum"))})
    rest = n_target - F.sum("base").over(Window.partitionBy())
    return s.select("stratum", "n", (F.col("base") + F.when(F.col("rank") <= rest, 1).otherwise(0)).alias("quota"))
