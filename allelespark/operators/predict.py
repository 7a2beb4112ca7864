"""Predicted scores of uploads: models with mean-substituted predictors, fallbacks, uncertainty and calibration."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import clip_dosage, hardy_weinberg_variance
from ..functions.sizes import small
from ..functions.solver import truncated_normal
from .score import counted_effects


@F.pandas_udf(T.DoubleType())
def truncated_variance(mu: pd.Series, variance: pd.Series) -> pd.Series:
    """Variance of a normal truncated to [0, 2]; variances under 1e-20 are 0."""
    out = truncated_normal(mu, variance.clip(lower=0) ** 0.5)[1]
    return pd.Series(out).where(variance.reset_index(drop=True) >= 1e-20, 0.0)


def called_dosages(calls: DataFrame, variants: DataFrame) -> DataFrame:
    """(user_id, variant_idx, dosage): alternate alleles called at variants(variant_idx, variant_id, chromosome, position,
    ref_allele, alt_allele). What isn't called, conflicts or doesn't fit has no row."""
    terms = variants.select(F.col("variant_idx").alias("prs_row"), "variant_id", "chromosome", "position", F.col("alt_allele").alias("effect_allele"), F.col("ref_allele").alias("other_allele"))
    return counted_effects(calls, terms).select("user_id", F.col("prs_row").alias("variant_idx"), F.col("n").cast("double").alias("dosage"))


def baselines(models: DataFrame, coefficients: DataFrame, frequencies: DataFrame) -> DataFrame:
    """models with n_predictors and base: the prediction where every predictor is substituted by twice its frequency."""
    c = coefficients.join(frequencies.select(F.col("variant_idx").alias("predictor_idx"), "allele_frequency"), "predictor_idx")
    c = c.groupBy("unit_id").agg(F.count("*").cast("long").alias("n_predictors"), F.sum(2 * F.col("allele_frequency") * F.col("coefficient")).alias("shift"))
    d = models.drop("n_predictors").join(c, "unit_id", "left")
    return d.withColumns({"n_predictors": F.coalesce("n_predictors", F.lit(0)), "base": F.col("intercept") + F.coalesce("shift", F.lit(0.0))}).drop("shift")


def touched(called: DataFrame, based: DataFrame, coefficients: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(user_id, unit_id, raw, missing): predictions of the models that a user's calls reach, and the share of substituted
    predictors. Only called cells are joined: the base already holds what the substituted ones add."""
    c = coefficients.join(frequencies.select(F.col("variant_idx").alias("predictor_idx"), "allele_frequency"), "predictor_idx")
    d = called.join(small(c), F.col("variant_idx") == F.col("predictor_idx"))
    d = d.groupBy("user_id", "unit_id").agg(F.sum((F.col("dosage") - 2 * F.col("allele_frequency")) * F.col("coefficient")).alias("moved"), F.count("*").alias("seen"))
    d = d.join(based.select("unit_id", "base", "n_predictors"), "unit_id")
    return d.select("user_id", "unit_id", (F.col("base") + F.col("moved")).alias("raw"), (1 - F.col("seen") / F.col("n_predictors")).alias("missing"))


def _terms(d: DataFrame, raw: Column, missing: Column) -> DataFrame:
    """d(beta, residual_variance, allele_frequency) with the score term, its variance and whether the dosage was clipped."""
    full = F.col("residual_variance") * (1 - missing) + hardy_weinberg_variance(F.col("allele_frequency")) * missing
    d = d.withColumns({"_raw": raw, "_var": full})
    return d.withColumns({
        "term": clip_dosage(F.col("_raw")) * F.col("beta"), "variance": F.col("beta") ** 2 * truncated_variance(F.col("_raw"), F.col("_var")), "truncated": (clip_dosage(F.col("_raw")) != F.col("_raw")).cast("long"),
    }).drop("_raw", "_var")


SUMS = ("term", "variance", "truncated")


def imputed_component(users: DataFrame, called: DataFrame, models: DataFrame, coefficients: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(user_id, term, variance, truncated, n_models) summed over all models(unit_id, intercept, beta, residual_variance,
    allele_frequency) and coefficients(unit_id, predictor_idx, coefficient).

    Every model scores every user, so the sums over all models at their base are computed once and each user adds the
    differences of the models reached by a call: work grows with calls, not with users times models.
    """
    based = baselines(models, coefficients, frequencies)
    whole = F.when(F.col("n_predictors") > 0, 1.0).otherwise(0.0)
    base = _terms(based, F.col("base"), whole)
    total = base.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(f"all_{c}") for c in SUMS), F.count("*").cast("long").alias("n_models"))
    t = touched(called, based, coefficients, frequencies).join(base.select("unit_id", "beta", "residual_variance", "allele_frequency", *(F.col(c).alias(f"b_{c}") for c in SUMS)), "unit_id")
    t = _terms(t, F.col("raw"), F.col("missing"))
    own = t.groupBy("user_id").agg(*(F.sum(F.col(c) - F.col(f"b_{c}")).alias(c) for c in SUMS))
    d = users.join(own, "user_id", "left").join(F.broadcast(total))
    return d.select("user_id", *((F.coalesce(c, F.lit(0)) + F.col(f"all_{c}")).alias(c) for c in SUMS), "n_models")


def observed_component(users: DataFrame, calls: DataFrame, called: DataFrame, observed: DataFrame, fallbacks: DataFrame, coefficients: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(user_id, term, variance, truncated, n_direct, n_fallback, fallback_weight, n_unresolved) over observed(unit_id,
    variant_id, chromosome, position, effect_allele, other_allele, beta).

    A term that is called counts its effect allele as called; else the fallback of the same unit_id predicts it; else it is
    unresolved. fallbacks have the columns of models.
    """
    t = observed.filter("other_allele is not null").withColumn("prs_row", F.col("unit_id"))
    r = counted_effects(calls, t).join(small(t.select("prs_row", "beta")), "prs_row")
    direct = r.select("user_id", F.col("prs_row").alias("unit_id"), (F.col("n") * F.col("beta")).alias("term"))
    based = baselines(fallbacks.join(observed.select("unit_id"), "unit_id", "left_semi"), coefficients, frequencies)
    base = _terms(based, F.col("base"), F.when(F.col("n_predictors") > 0, 1.0).otherwise(0.0)).withColumn("weight", F.abs("beta"))
    sums = (*SUMS, "weight")
    total = base.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(f"all_{c}") for c in sums), F.count("*").cast("long").alias("all_fallbacks"))
    total = total.join(F.broadcast(observed.agg(F.count("*").cast("long").alias("n_observed"))))
    rows = base.select("unit_id", "beta", "residual_variance", "allele_frequency", *(F.col(c).alias(f"b_{c}") for c in sums))
    moved = touched(called, based, coefficients, frequencies).join(direct.select("user_id", "unit_id"), ["user_id", "unit_id"], "left_anti").join(rows, "unit_id")
    moved = _terms(moved, F.col("raw"), F.col("missing")).groupBy("user_id").agg(*(F.sum(F.col(c) - F.col(f"b_{c}")).alias(f"m_{c}") for c in SUMS))
    d = direct.join(rows, "unit_id", "left").groupBy("user_id").agg(F.sum("term").alias("d_term"), F.count("*").cast("long").alias("n_direct"), F.count("b_term").cast("long").alias("spared"), *(F.sum(f"b_{c}").alias(f"s_{c}") for c in sums))
    d = users.join(d, "user_id", "left").join(moved, "user_id", "left").join(F.broadcast(total)).na.fill(0)
    fall = {c: F.col(f"all_{c}") - F.col(f"s_{c}") + (F.col(f"m_{c}") if c != "weight" else 0) for c in sums}
    n_fallback = F.col("all_fallbacks") - F.col("spared")
    return d.select("user_id", (F.col("d_term") + fall["term"]).alias("term"), fall["variance"].alias("variance"), fall["truncated"].alias("truncated"), "n_direct", n_fallback.alias("n_fallback"), fall["weight"].alias("fallback_weight"), (F.col("n_observed") - F.col("n_direct") - n_fallback).alias("n_unresolved"))


def projected_component(users: DataFrame, called: DataFrame, regions: DataFrame, coefficients: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(user_id, term, variance, n_regions, n_substituted) over regions(unit_id, intercept, cv_mse, target_variance): their
    predictions aren't clipped, and the variance moves from cv_mse to target_variance with the share substituted."""
    based = baselines(regions, coefficients, frequencies)
    spread = lambda f: F.col("cv_mse") * (1 - f) + F.col("target_variance") * f
    whole = F.when(F.col("n_predictors") > 0, 1.0).otherwise(0.0)
    base = based.withColumns({"b_term": F.col("base"), "b_variance": spread(whole)})
    total = base.agg(F.coalesce(F.sum("b_term"), F.lit(0.0)).alias("all_term"), F.coalesce(F.sum("b_variance"), F.lit(0.0)).alias("all_variance"), F.count("*").cast("long").alias("n_regions"), F.coalesce(F.sum("n_predictors"), F.lit(0)).alias("n_cells"))
    t = touched(called, based, coefficients, frequencies).join(base.select("unit_id", "cv_mse", "target_variance", "n_predictors", "b_term", "b_variance"), "unit_id")
    own = t.groupBy("user_id").agg(F.sum(F.col("raw") - F.col("b_term")).alias("term"), F.sum(spread(F.col("missing")) - F.col("b_variance")).alias("variance"), F.sum(F.round((1 - F.col("missing")) * F.col("n_predictors"))).cast("long").alias("seen"))
    d = users.join(own, "user_id", "left").join(F.broadcast(total)).na.fill(0)
    return d.select("user_id", (F.col("term") + F.col("all_term")).alias("term"), (F.col("variance") + F.col("all_variance")).alias("variance"), "n_regions", (F.col("n_cells") - F.col("seen")).alias("n_substituted"))


def assemble(observed: DataFrame, modelled: DataFrame, calibration: dict | None = None) -> DataFrame:
    """A row a user: prs, se, its 95% interval, both components and, with calibration (slope, intercept and, if known,
    raw_residual_sd and residual_sd), the same on the calibrated scale.

    The diagonal error is the root of the summed variances; a known residual spread takes its place where it is larger.
    """
    m = modelled.select("user_id", F.col("term").alias("modelled"), F.col("variance").alias("mv"), *(c for c in modelled.columns if c not in ("user_id", "term", "variance", "truncated")), *([F.col("truncated").alias("n_truncated")] if "truncated" in modelled.columns else [F.lit(0).cast("long").alias("n_truncated")]))
    d = observed.withColumnsRenamed({"term": "observed", "variance": "ov"}).drop("truncated").join(m, "user_id")
    d = d.withColumns({"prs": F.col("observed") + F.col("modelled"), "se_diagonal": F.sqrt(F.greatest(F.col("ov") + F.col("mv"), F.lit(0.0)))})
    c = calibration or {}
    raw, fitted, slope = c.get("raw_residual_sd"), c.get("residual_sd"), c.get("slope")
    d = d.withColumn("se", F.greatest(F.lit(float(raw)), F.col("se_diagonal")) if raw is not None else F.col("se_diagonal"))
    d = d.withColumns({"ci_lower": F.col("prs") - 1.96 * F.col("se"), "ci_upper": F.col("prs") + 1.96 * F.col("se")})
    if slope is not None:
        se = F.greatest(F.lit(float(fitted)), abs(slope) * F.col("se_diagonal")) if raw is not None and fitted is not None else abs(slope) * F.col("se")
        d = d.withColumns({"prs_scaled": slope * F.col("prs") + float(c["intercept"]), "se_scaled": se})
        d = d.withColumns({"ci_lower_scaled": F.col("prs_scaled") - 1.96 * F.col("se_scaled"), "ci_upper_scaled": F.col("prs_scaled") + 1.96 * F.col("se_scaled")})
    return d.drop("ov", "mv")


def check_compatibility(model_build: str | None, model_platform: str | None, build: str | None = None, platform: str | None = None, strict: bool = True) -> list[str]:
    """What doesn't match between a model and an upload; unknown on either side matches. Raises if strict."""
    names = {"hg19": "GRCh37", "b37": "GRCh37", "grch37": "GRCh37", "hg38": "GRCh38", "b38": "GRCh38", "grch38": "GRCh38"}
    norm = lambda b: names.get(b.strip().lower(), b) if b else None
    out = [f"{what} {mine} is not the model's {want}" for what, mine, want in (("build", norm(build), norm(model_build)), ("platform", platform, model_platform)) if mine and want and mine != want]
    if out and strict:
        raise ValueError("; ".join(out))
    return out


def validate_build(score_build: str | None, genotype_build: str | None, strict: bool = True) -> bool:
    """Whether two builds are one, unknown on either side counting as such; raises if strict and they aren't."""
    return not check_compatibility(score_build, None, genotype_build, None, strict)


def chip_axis(predictors: DataFrame) -> DataFrame:
    """The distinct predictors(variant_id, chromosome, position, counted_allele, other_allele, allele_frequency) of several
    models; ValueError if one id comes with different metadata."""
    columns = ["chromosome", "position", "counted_allele", "other_allele", "allele_frequency"]
    d = predictors.groupBy("variant_id").agg(F.min(F.struct(*columns)).alias("low"), F.max(F.struct(*columns)).alias("high"))
    if bad := [r[0] for r in d.filter("low <> high").select("variant_id").limit(5).collect()]:
        raise ValueError(f"{', '.join(sorted(bad))} differ between models")
    return d.select("variant_id", "low.*")


def oriented_matrix(panel: DataFrame, predictors: DataFrame) -> DataFrame:
    """(prs_row, d) for predictors(prs_row, chromosome, position, effect_allele, other_allele, allele_frequency): the panel's
    arrays counting the effect allele, cells that are missing or not placed at twice the frequency; one pass, no long form."""
    from .harmonize import resolve_alleles

    r = resolve_alleles(predictors.withColumn("beta", F.lit(0.0)), panel.drop("d")).join(panel.select("variant_idx", "d"), "variant_idx", "left")
    n = (panel.select(F.size("d")).first() or [0])[0]
    fill = 2 * F.col("allele_frequency")
    full = F.transform("d", lambda x: F.coalesce(F.when(F.col("flip"), 2 - x).otherwise(x).cast("double"), fill))
    return r.select("prs_row", F.coalesce(full, F.array_repeat(fill, n)).alias("d"))


def needed_ids(model, observed_only: bool = False) -> DataFrame:
    """(variant_id) that an upload should hold for a model: its observed terms and, unless observed_only, all predictors."""
    seen = model.tables["observed"].select("variant_id")
    return (seen if observed_only else seen.union(model.tables["variants"].select("variant_id"))).distinct()
