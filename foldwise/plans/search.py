"""Search and refit jobs: linear grids, penalty sweeps, forests, boosted trees, support vectors."""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise import constants as K
from foldwise.operators.boosting import BINS, Booster, fit_boosters, score_boosters
from foldwise.operators.grid import alpha_sweep_values, draw_space, fold_grid, resolve_params
from foldwise.operators.linear import grid_stats
from foldwise.operators.moments import FoldSums, fold_sums
from foldwise.operators.selection import best_params, top1_trial
from foldwise.operators.svr import fit_machines, score_machines
from foldwise.operators.trees import forest, gradient_linear, sweep


def linear_grid_search(df: DataFrame | None, features: list[str], label: str, grid: DataFrame, scaler: str = "StandardScaler",
                       bucket: str = "bucket", k: int = 5, sums: FoldSums | None = None, train: str = "train",
                       val: str = "val") -> DataFrame:
    """Every grid row of every fold, fitted and scored from one scan of the data.

    ``grid`` holds ``model, param_key, alpha, l1_ratio``; rows equal in the penalty differ
    only in solver labels and share their fit. ``df`` is not read when ``sums`` are given.
    """
    sums = sums or fold_sums(df, features, label, bucket, k)
    folded = grid if "fold" in grid.columns else fold_grid(grid, list(range(k)))
    return grid_stats(grid.sparkSession, sums, folded, scaler, train, val)


def alpha_sweep(df: DataFrame, features: list[str], label: str, models: list[str], low: float = -5.0, high: float = 0.0,
                n: int = 100, scaler: str = "IdentityScaler", bucket: str = "bucket", k: int = 5,
                sums: FoldSums | None = None, l1_ratio: float = K.LINEAR_DEFAULTS["l1_ratio"]) -> DataFrame:
    """Log-spaced penalties for each model and fold; the result carries the penalty itself."""
    spark = df.sparkSession
    points = (
        spark.createDataFrame([(m,) for m in models], "model string")
        .select("model", F.posexplode(alpha_sweep_values(low, high, n)).alias("i", "alpha"))
        .select("model", F.concat("model", F.lit("_alpha_"), "i").alias("param_key"), "alpha", F.lit(float(l1_ratio)).alias("l1_ratio"))
    )
    stats = linear_grid_search(df, features, label, points, scaler, bucket, k, sums)
    return stats.join(F.broadcast(points.select("model", F.col("param_key").alias("param"), "alpha")), ["model", "param"])


def refit_winners(stats: DataFrame, grid: DataFrame, sums: FoldSums,
                  scaler: str = "StandardScaler") -> DataFrame:
    """Each fold's best parameters fitted again on train plus validation rows and scored on the test rows."""
    best = best_params(stats, ["model", "fold"], "param").select("model", "fold", "param_key")
    chosen = resolve_params(best, grid)
    return as_test(grid_stats(stats.sparkSession, sums, chosen, scaler, "train_val", "test"))


def as_test(stats: DataFrame) -> DataFrame:
    """Metric names of a refit: train_val for train, test for val."""
    sides = {"train": "train_val", "val": "test"}
    return stats.withColumnsRenamed(
        {f"{w}{a}_{m}": f"{w}{b}_{m}" for a, b in sides.items() for w in ("", "weighted_") for m in ("mse", "r2")}
    )


def forest_search(data: DataFrame, grid: list[dict], k: int = 5, train: str = "train", val: str = "val",
                  seeds: dict[int, dict] | None = None, parallelism: int = 4, keep: dict | None = None) -> DataFrame:
    """Forest cross-validation; ``seeds`` adds each fold's earlier winner as ``random_forest_hp__1``."""
    grids = None
    if seeds:
        grids = {f: [*grid, {**seeds[f], "param_key": "random_forest_hp__1"}] if f in seeds else grid for f in range(k)}
    return sweep(data, "random_forest", grid, forest, k, train, val, parallelism=parallelism, fold_grids=grids, keep=keep)


def refit_sweep(data: DataFrame, model: str, stats: DataFrame, grid: list[dict], estimator: Callable[[dict], object],
                k: int = 5, parallelism: int = 4, keep: dict | None = None) -> DataFrame:
    """Each fold's best parameter set fitted on train plus validation rows and scored on the test rows."""
    values = {p["param_key"]: p for p in grid}
    best = best_params(stats, ["model", "fold"]).filter("param_key IS NOT NULL").collect()
    chosen = {f: [] for f in range(k)} | {r["fold"]: [values[r["param_key"]]] for r in best if r["param_key"] in values}
    return as_test(sweep(data, model, [], estimator, k, "train_val", "test", parallelism=parallelism, fold_grids=chosen, keep=keep))


def gradient_search(data: DataFrame, model: str, grid: list[dict], k: int = 5, parallelism: int = 4,
                    trial_epochs: int = 100) -> DataFrame:
    """Gradient-style linear models with a short trial run before the full one."""
    share = K.PENALTY_RATIO.get(model)

    def make(params: dict, cap: int | None = None):
        p = params if share is None else {**params, "l1_ratio": share}
        return gradient_linear(p, cap)

    return sweep(data, model, grid, make, k, parallelism=parallelism, trial=lambda p: make(p, trial_epochs))


def drawn_trials(spark: SparkSession, trials: int, seed: int = 42, k: int = 5, folds: list[int] | None = None,
                 space: list[tuple[str, float, float, bool, bool]] | None = None) -> dict[int, list[dict]]:
    """Per fold, ``trials`` points of a search space as drawn."""
    points = spark.range(trials).withColumnRenamed("id", "trial").withColumn("fold", F.explode(F.array(*[F.lit(f) for f in (folds if folds is not None else range(k))])))
    out: dict[int, list[dict]] = {}
    for r in draw_space(points, ["fold", "trial"], seed, space).orderBy("fold", "trial").collect():
        out.setdefault(r["fold"], []).append({n: v for n, v in r.asDict().items() if n not in ("trial", "fold")} | {"param_key": f"boosted_hp_{r['trial'] + 1}"})
    return out


def trial_search(df: DataFrame, features: list[str], label: str, trials: int, seed: int = 42, k: int = 5, folds: list[int] | None = None,
                 space: list[tuple[str, float, float, bool, bool]] | None = None, seconds: float | None = None, bucket: str = "bucket",
                 bins: int = BINS) -> tuple[DataFrame, list[Booster], list[np.ndarray]]:
    """Random search for boosted trees: ``trials`` drawn points per fold, all growing together, each until 50 rounds after its best one.

    Gives one row per (fold, trial) with validation loss, kept trees, eight metrics, the reason of a failure (its metrics are NaN) and the drawn values,
    and the grown machines with their bin edges. After ``seconds`` growth ends with the rounds there are.
    """
    drawn = drawn_trials(df.sparkSession, trials, seed, k, folds, space)
    deadline = None if seconds is None else time.time() + seconds
    machines, edges = fit_boosters(df, features, label, drawn, k=k, folds=sorted(drawn), bucket=bucket, bins=bins, seed=seed, deadline=deadline)
    values = {(f, p["param_key"]): {n: float(v) for n, v in p.items() if n != "param_key"} for f, points in drawn.items() for p in points}
    rows = [(m.fold, m.key, int(m.key.rsplit("_", 1)[1]) - 1, m.best if not m.failed else None, len(m.trees), m.failed, values[(m.fold, m.key)]) for m in machines]
    fits = df.sparkSession.createDataFrame(rows, "fold int, param_key string, trial int, trees int, rounds int, failed string, params map<string,double>")
    stats = score_boosters(df, features, label, machines, edges, k=k, bucket=bucket)
    table = stats.join(F.broadcast(fits), ["fold", "param_key"]).withColumn("val_loss", 1.0 - F.col("val_r2"))
    return table.select("fold", "trial", "model", "param_key", "val_loss", "trees", "rounds", "failed", *_STATS, "params"), machines, edges


def refit_boosters(df: DataFrame, features: list[str], label: str, stats: DataFrame, machines: list[Booster], seed: int = 42, k: int = 5,
                   bucket: str = "bucket", bins: int = BINS, edges: list[np.ndarray] | None = None) -> tuple[DataFrame, list[Booster], list[np.ndarray]]:
    """Each fold's best trial by weighted validation R2 grown again on train plus validation rows, as many trees as it kept, and scored on the test rows.

    Over rows with a bucket, ``edges`` are those of the search; rows with a role are others here than there.
    """
    best = top1_trial(stats, ["fold"], "weighted_val_r2", ["trial"]).filter(~F.isnan("weighted_val_r2")).select("fold", "param_key").collect()
    kept = {(m.fold, m.key): m for m in machines}
    chosen = {}
    for r in best:
        m = kept[(r["fold"], r["param_key"])]
        chosen[r["fold"]] = [{**m.params, "n_estimators": max(m.best, 1), "param_key": m.key}]
    again, edges = fit_boosters(df, features, label, chosen, "train_val", None, k, sorted(chosen), bucket, bins, seed, edges=edges)
    return as_test(score_boosters(df, features, label, again, edges, "boosted", k, "train_val", "test", bucket)), again, edges


_STATS = [f"{w}{side}_{m}" for side in ("train", "val") for w, m in (("weighted_", "mse"), ("weighted_", "r2"), ("", "mse"), ("", "r2"))]


def svr_search(df: DataFrame, features: list[str], label: str, grid: list[dict] | dict[int, list[dict]], bucket: str = "bucket", k: int = 5,
               size: int = 64, seed: int = 42, train: str = "train", val: str = "val", seeds: dict[int, dict] | None = None) -> DataFrame:
    """Support-vector cross-validation: all folds and parameter sets advance together, scan by scan, each to its own tolerance.

    ``seeds`` adds each fold's earlier winner as ``svr_hp__1``. Machines that fail or do not converge are rows of NaN.
    """
    if seeds:
        grid = {f: [*grid, {**seeds[f], "param_key": "svr_hp__1"}] if f in seeds else list(grid) for f in range(k)}
    machines, maps = fit_machines(df, features, label, grid, train, k, bucket, seed, size)
    return score_machines(df, features, label, machines, maps, "svr", k, train, val, bucket)
