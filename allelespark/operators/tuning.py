"""Search for penalties over units or regions, from one collection of moments."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, metrics, tiles

# The grid where none is given.
L1_RATIOS, ALPHAS = (0.1, 0.5, 0.9), (0.001, 0.01, 0.1)


def grids(l1_ratios=None, alphas=None) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """The grid to search; ratios lie in [0, 1] and penalties above 0."""
    l1, a = tuple(L1_RATIOS if l1_ratios is None else l1_ratios), tuple(ALPHAS if alphas is None else alphas)
    if not l1 or not a or any(not 0 <= x <= 1 for x in l1) or any(not x > 0 for x in a):
        raise ValueError("l1 ratios lie in [0, 1], alphas above 0, and there is one of each at least")
    return l1, a


def _best(solved: DataFrame) -> tuple[dict, DataFrame]:
    """The best point and (l1_ratio, alpha, mean_cv_mse, n_units, best) of all."""
    d = blocks.best_penalties(solved)
    row = d.filter("best").first()
    if row is None:
        n = solved.select("unit_id").distinct().count()
        raise ValueError(f"no unit of {n} has a model that isn't intercept-only at any point")
    return {"l1_ratio": row.l1_ratio, "alpha": row.alpha, "mean_cv_mse": row.mean_cv_mse, "n_units": row.n_units}, d


def search_units(chip: DataFrame, targets: DataFrame, window: int, max_predictors: int | None = None, max_units: int | None = None, l1_ratios=None, alphas=None, folds: int = 5, seed: int = 42) -> tuple[dict, DataFrame]:
    """The penalties with the least mean held-out error over targets(unit_id, variant_idx, chromosome, position, y, beta).

    With max_units the units are a sample spread over chromosome, minor allele frequency and |beta|; that is the option's
    purpose, and without it all count.
    """
    l1, a = grids(l1_ratios, alphas)
    return _best(blocks.solve_blocks(tiles.collect_tiles(chip, sample_units(targets, max_units, seed), window, max_predictors, folds, seed), l1, a))


def sample_units(targets: DataFrame, most: int | None, seed: int) -> DataFrame:
    if most is None:
        return targets
    called = F.filter("y", lambda x: x.isNotNull())
    q = F.try_divide(F.aggregate(called, F.lit(0.0), lambda s, x: s + x), 2 * F.size(called))
    strata = metrics.variant_strata(targets.select("unit_id", "chromosome", "beta", q.alias("allele_frequency")))
    return targets.join(metrics.stratified_sample(strata, most, seed).select("unit_id"), "unit_id", "left_semi")


def search_regions(y: DataFrame, pairs: DataFrame, panel: DataFrame, max_regions: int | None = None, members: DataFrame | None = None, l1_ratios=None, alphas=None, folds: int = 5, seed: int = 42) -> tuple[dict, DataFrame]:
    """The same over regions y(unit_id, y) and pairs(unit_id, predictor_idx); a sample of regions is spread over buckets of
    their numbers of predictors and, with members(unit_id, variant_idx), of score variants."""
    from ..functions.exprs import predictor_bucket, prs_bucket

    l1, a = grids(l1_ratios, alphas)
    if max_regions is not None:
        d = y.select("unit_id").join(pairs.groupBy("unit_id").agg(F.count("*").alias("p")), "unit_id", "left").withColumn("p", F.coalesce("p", F.lit(0)))
        d = d.join(members.groupBy("unit_id").agg(F.count("*").alias("m")), "unit_id", "left") if members is not None else d.withColumn("m", F.lit(1))
        d = d.select("unit_id", F.concat_ws(":", predictor_bucket(F.col("p")), prs_bucket(F.coalesce("m", F.lit(1)))).alias("stratum"))
        y = y.join(metrics.stratified_sample(d, max_regions, seed).select("unit_id"), "unit_id", "left_semi")
    return _best(blocks.solve_blocks(blocks.collect_blocks(y, pairs.join(y.select("unit_id"), "unit_id", "left_semi"), panel, folds, seed), l1, a))


def trial_points(n: int, l1_range: tuple[float, float] = (0.0, 1.0), alpha_range: tuple[float, float] = (1e-4, 1.0), seed: int = 42) -> list[tuple[float, float]]:
    """n points spread evenly over the ratio and the logarithm of alpha: a Halton sequence, begun at a place that seed sets."""

    def radical(i: int, base: int) -> float:
        out, f = 0.0, 1.0 / base
        while i:
            i, r = divmod(i, base)
            out, f = out + r * f, f / base
        return out

    low, high = math.log(alpha_range[0]), math.log(alpha_range[1])
    start = 1 + (seed * 7919) % 100_003
    return [(l1_range[0] + radical(start + i, 2) * (l1_range[1] - l1_range[0]), math.exp(low + radical(start + i, 3) * (high - low))) for i in range(n)]


def search_trials(chip: DataFrame, targets: DataFrame, window: int, max_predictors: int | None = None, max_units: int | None = None, n_trials: int = 50, l1_range=(0.0, 1.0), alpha_range=(1e-4, 1.0), folds: int = 5, seed: int = 42) -> tuple[dict, DataFrame]:
    """search_units() at n_trials points of a quasi-random sequence instead of a grid; all are solved in one pass."""
    points = trial_points(n_trials, l1_range, alpha_range, seed)
    m = tiles.collect_tiles(chip, sample_units(targets, max_units, seed), window, max_predictors, folds, seed)
    return _best(blocks.solve_blocks(m, points=points))
