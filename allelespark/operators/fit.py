"""Per-variant and per-region elastic-net fits in grouped Arrow functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.solver import fit_block, kfold
from .blocks import best_penalties, collect_blocks, solve_blocks

MODEL = "unit_id long, intercept double, cv_mse double, cv_r2 double, n_predictors int, intercept_only boolean, predictor_idx array<long>, coefficients array<double>, held_out array<double>"


def packed(full: DataFrame) -> DataFrame:
    """One row a variant: its dosages ordered by sample."""
    return full.groupBy("variant_idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("sample_idx", "dosage"))), lambda x: x["dosage"]).alias("d"))


def fit_units(targets: DataFrame, pairs: DataFrame, panel: DataFrame, folds: int = 5, alpha: float = 0.01, l1_ratio: float = 0.5, seed: int = 42) -> DataFrame:
    """Models of targets(unit_id, y) on the panel rows pairs(unit_id, predictor_idx) names, panel(variant_idx, d).

    A unit's group holds its own predictors' columns alone, so a task's memory is bounded by the predictors a unit is
    allowed (nearest()), whatever the number of units.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y = np.asarray(pdf["y"].iat[0], float)
        own = pdf.dropna(subset=["predictor_idx"]).sort_values("predictor_idx")
        z = np.stack(own["d"].to_numpy()).T.astype(float) if len(own) else np.zeros((len(y), 0))
        coef, b, mse, r2, held, empty = fit_block(z, y, kfold(len(y), folds, seed), folds, alpha, l1_ratio)
        ids = own["predictor_idx"].astype(int).tolist()
        return pd.DataFrame([(key[0], b, mse, r2, len(ids), empty, ids if len(coef) else [], coef.tolist(), held.tolist())], columns=["unit_id", "intercept", "cv_mse", "cv_r2", "n_predictors", "intercept_only", "predictor_idx", "coefficients", "held_out"])

    cells = pairs.join(panel.select(F.col("variant_idx").alias("predictor_idx"), "d"), "predictor_idx")
    return targets.join(cells, "unit_id", "left").select("unit_id", "y", "predictor_idx", "d").groupBy("unit_id").applyInPandas(run, MODEL)


def region_contribution(full: DataFrame, members: DataFrame) -> DataFrame:
    """(region_id, sample_idx, contribution): the sum of beta times oriented dosage over members(region_id, variant_idx, beta, flip)."""
    d = full.join(F.broadcast(members), "variant_idx")
    return d.groupBy("region_id", "sample_idx").agg(F.sum(F.col("beta") * F.when(F.col("flip"), 2 - F.col("dosage")).otherwise(F.col("dosage"))).alias("contribution"))


def grid_search(targets: DataFrame, pairs: DataFrame, panel: DataFrame, l1_ratios=(0.1, 0.5, 0.9), alphas=(0.001, 0.01, 0.1), folds: int = 5) -> DataFrame:
    """(l1_ratio, alpha, mean_cv_mse, n_units, best): mean over units that are not intercept-only; the first of equals is best.

    The samples are read once, for the moments; each point of the grid is solved from those.
    """
    return best_penalties(solve_blocks(collect_blocks(targets, pairs, panel, folds), l1_ratios, alphas))
