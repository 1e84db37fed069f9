"""Scaler comparison: every scaler for every linear model, fold and weight status."""

from __future__ import annotations

import logging
import math

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise import constants as K
from foldwise.operators.cleaning import weight_features
from foldwise.functions.bins import label_bin
from foldwise.operators.folds import assign_roles
from foldwise.operators.joins import join_small
from foldwise.operators.linear import fit_sums, score_sums
from foldwise.operators.moments import FoldSums, sums_by_fold
from foldwise.operators.scalers import AFFINE, SCALERS, apply_scaler, fit_scaler
from foldwise.operators.selection import best_scaler
from foldwise.operators.weights import bin_counts, bin_weights
from foldwise.session import cut_lineage

log = logging.getLogger(__name__)
MODELS = ["ols", "mb_SGD", "lasso", "ridge", "elasticnet"]
STUDY_SCHEMA = (
    "model_name string, scaler string, fold int, weight_status string, downsampled string, "
    "validation_mse double, validation_r2 double, na_count long"
)


def weighted_rows(df: DataFrame, cols: list[str], label: str, k: int = 5) -> DataFrame:
    """Rows of each fold with listed columns and the label times the root of the bin weight."""
    weights = cut_lineage(bin_weights(bin_counts(df, label, ["fold"]), ["fold"]))
    binned = df.withColumn("bin", label_bin(F.col(label)))
    joined = join_small(binned, weights, ["fold", "bin"], "inner", k * (K.N_EDGES - 1))
    return weight_features(joined, [*cols, label]).drop("bin", "count", "inverse_count", "weight")


def scale_weighted(df: DataFrame, cols: list[str], label: str, kind: str, bucket: str = "bucket", k: int = 5) -> tuple[DataFrame, DataFrame]:
    """Weighted training rows scaled by their own fit, validation rows by the fit of the unweighted training rows."""
    train = assign_roles(df, bucket, k, ["train"])
    val = assign_roles(df, bucket, k, ["val"])
    heavy = weighted_rows(train, cols, label, k)
    own = fit_scaler(heavy, ["fold"], cols, kind, groups=k)
    plain = fit_scaler(train, ["fold"], cols, kind, groups=k)
    return apply_scaler(heavy, own, ["fold"], cols, kind, k), apply_scaler(val, plain, ["fold"], cols, kind, k)


def scaler_study(df: DataFrame, scaled: list[str], unscaled: list[str], label: str, models: list[str] | None = None,
                 scalers: list[str] | None = None, statuses: list[str] | None = None, variant: str = "A",
                 bucket: str = "bucket", k: int = 5, split: str = "train") -> DataFrame:
    """One row per (model, scaler, fold, weight status).

    One table of cross products serves every model. Shifting and stretching columns only
    rescales the table, so the affine scalers share the table of the raw rows and each
    needs no more than its own fitted numbers; the other scalers take a table of their
    own. Rows are scored on ``split``; the default scores the training rows. A scaler
    that fails gives NaN rows and the study goes on.
    """
    features = [*scaled, *unscaled]
    models = models or MODELS
    out = []
    for status in statuses or ["unweighted", "weighted"]:
        train = assign_roles(df.select(bucket, label, *features), bucket, k, ["train"])
        if status == "weighted":
            train = weighted_rows(train, scaled, label, k)
        # Every scaler reads the rows several times; lost blocks are computed again from the source.
        train = train.persist(StorageLevel.MEMORY_AND_DISK)
        other = assign_roles(df.select(bucket, label, *features), bucket, k, [split])
        shared: dict[str, FoldSums] = {}

        def tables(params: DataFrame | None, kind: str) -> dict[str, FoldSums]:
            def take(rows: DataFrame, role: str) -> FoldSums:
                done = apply_scaler(rows, params, ["fold"], scaled, kind, k)
                return sums_by_fold(done, features, label, k, role)

            return {"train": take(train, "train")} | ({} if split == "train" else {split: take(other, split)})

        for kind in scalers or SCALERS:
            stats: dict[tuple[str, int], tuple[float, float, int | None]] = {}
            try:
                params = fit_scaler(train, ["fold"], scaled, kind, groups=k)
                params = params if params is None else cut_lineage(params)
                divisors = {}
                if kind in AFFINE or kind == "IdentityScaler":
                    shared = shared or tables(None, "IdentityScaler")
                    sums = shared
                    for r in params.collect() if params is not None else []:
                        divisors[r["fold"]] = np.array([r["params"][c][1] for c in scaled] + [1.0] * len(unscaled))
                else:
                    sums = tables(params, kind)
                stats = _study_rows(sums, divisors, models, split, k)
            except Exception as problem:  # noqa: BLE001 - the study reports failed scalers
                log.error("scaler %s failed: %s", kind, problem)
            for model in models:
                for fold in range(k):
                    out.append((model, kind, fold, status, variant, *stats.get((model, fold), (math.nan, math.nan, None))))
        train.unpersist()
    return df.sparkSession.createDataFrame(out, STUDY_SCHEMA)


def _study_rows(sums: dict[str, FoldSums], divisors: dict[int, np.ndarray], models: list[str], split: str,
                k: int) -> dict[tuple[str, int], tuple[float, float, int | None]]:
    """(mse, r2, missing predictions) per model and fold, from bounded tables."""
    found: dict[tuple[str, int], tuple[float, float, int | None]] = {}
    for model in models:
        ratio = K.PENALTY_RATIO.get(model, K.LINEAR_DEFAULTS["l1_ratio"])
        alpha = K.LINEAR_DEFAULT_ALPHA.get(model, 0.0)
        for fold in range(k):
            try:
                fit = fit_sums(sums["train"], fold, "train", alpha, ratio, divisor=divisors.get(fold))
                m = score_sums(sums[split], fit, fold, split)
                rows = int(sums[split].table[(fold, split)].plain[0, 0])
                found[(model, fold)] = (m["mse"], m["r2"], 0 if math.isfinite(m["mse"]) else rows)
            except (ValueError, KeyError, ArithmeticError) as problem:
                log.error("model %s, fold %s failed: %s", model, fold, problem)
    return found


def study_winners(study: DataFrame) -> DataFrame:
    """Best scaler per model, fold and weight status."""
    return best_scaler(study, ["model_name", "fold", "weight_status"])
