"""The stages as jobs over stored fold tables.

``prepare`` writes one table partitioned by variant, split and fold. Every later job
reads it with a filter on ``variant`` (and the splits it needs), so only those
partitions are scanned, and writes its results as Parquet for the next job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise import constants as K
from foldwise.operators.cleaning import drop_ids, force_double, harmonise_types
from foldwise.operators.grid import json_grid, linear_grid, random_search, with_default
from foldwise.operators.boosting import model_table
from foldwise.operators.linear import grid_stats
from foldwise.operators.metrics import bin_moments, score
from foldwise.operators.moments import split_sums
from foldwise.operators.network import network_report
from foldwise.operators.sampling import make_variants
from foldwise.operators.selection import best_params, top1_trial
from foldwise.operators.svr import fit_machines, machine_table, score_machines
from foldwise.operators.trees import assembled, forest
from foldwise.operators.weights import training_weights
from foldwise.plans import search
from foldwise.sources.models import save_model
from foldwise.sources.tables import fold_registry, write_folds, write_table

TRAIN_SPLITS = ["train", "train_val"]


def prepare(spark: SparkSession, spec: dict[str, str], out: str, order_cols: list[str], label: str = K.LABEL, seed: int = 42) -> None:
    """Full (A) and down-sampled (B) training tables; validation and test tables pass through for both."""
    rows = fold_registry(spark, spec).drop("variant")
    train = rows.filter(F.col("split").isin(*TRAIN_SPLITS))
    groups = sum(len(paths.split(",")) for split, paths in spec.items() if split in TRAIN_SPLITS)
    held = rows.filter(~F.col("split").isin(*TRAIN_SPLITS))
    both = make_variants(train, ["split", "fold"], label, order_cols, seed, groups)
    for variant in ("A", "B"):
        both = both.unionByName(held.withColumn("variant", F.lit(variant)))
    write_folds(both, out)


def read_folds(spark: SparkSession, path: str, variant: str, splits: list[str]) -> DataFrame:
    """Rows of a variant and some splits, with ``role`` beside ``fold``; ids dropped, types harmonised."""
    rows = spark.read.parquet(path).filter((F.col("variant") == variant) & F.col("split").isin(*splits))
    clean = force_double(drop_ids(rows), [c for c in K.FORCED_DOUBLE if c in rows.columns])
    clean = harmonise_types(clean, ["fold", "split", "variant", *[c for c in K.UNSCALED if c in rows.columns]])
    return clean.withColumn("role", F.col("split")).withColumn("fold", F.col("fold").cast("int")).drop("split", "variant")


def naive_job(spark: SparkSession, folds: str, out: str, label: str = K.LABEL) -> DataFrame:
    """Mean of the training labels per variant and fold, scored on the training and test rows."""
    rows = spark.read.parquet(folds).filter(F.col("split").isin("train", "test")).select("variant", "fold", "split", label)
    means = rows.filter("split = 'train'").groupBy("variant", "fold").agg(F.avg(label).alias("naive_mean"))
    scored = score(rows.join(means, ["variant", "fold"]), ["variant", "fold", "split"], label, "naive_mean")
    write_table(scored, out)
    return spark.read.parquet(out)


def linear_job(spark: SparkSession, folds: str, out: str, variant: str, features: list[str], spaces: DataFrame,
               scaler: str = "StandardScaler", label: str = K.LABEL, k: int = 5) -> None:
    """Grid search on train and val, best parameters, refit on train_val, scores on test."""
    sums = split_sums(read_folds(spark, folds, variant, ["train", "val", "train_val", "test"]), features, label, k, role="role")
    grid = linear_grid(spaces)
    write_table(grid, f"{out}/grid")
    write_table(search.linear_grid_search(None, features, label, spark.read.parquet(f"{out}/grid"), scaler, k=k, sums=sums), f"{out}/stats")
    stats = spark.read.parquet(f"{out}/stats")
    write_table(best_params(stats, ["model", "fold"], "param"), f"{out}/best_params")
    write_table(search.refit_winners(stats, spark.read.parquet(f"{out}/grid"), sums, scaler), f"{out}/test_stats")


def least_squares_job(spark: SparkSession, folds: str, out: str, variant: str, features: list[str], label: str = K.LABEL, k: int = 5) -> None:
    """Ordinary least squares on train_val, scored on test; there is no grid to search."""
    sums = split_sums(read_folds(spark, folds, variant, ["train_val", "test"]), features, label, k, role="role")
    grid = spark.range(k).select(
        F.lit("ols").alias("model"), F.lit("ols_hp_0").alias("param_key"), F.col("id").cast("int").alias("fold"),
        F.lit(0.0).alias("alpha"), F.lit(0.0).alias("l1_ratio"),
    )
    write_table(search.as_test(grid_stats(spark, sums, grid, "IdentityScaler", "train_val", "test")), f"{out}/test_stats")


def _param_rows(grid: DataFrame) -> list[dict]:
    """Parameter sets as dictionaries; a grid is a list of settings, not data."""
    return [{"param_key": r["param_key"], **{n: _number(v) for n, v in (r["params"] or {}).items()}} for r in grid.select("param_key", "params").collect()]


def _number(text: str) -> object:
    try:
        return float(text)
    except ValueError:
        return text


def json_space(spark: SparkSession, model: str, space: str, share: float | None = None, seed: int = 42) -> list[dict]:
    """Parameter sets of a JSON search space with the default row; ``share`` draws a random part."""
    grid = json_grid(spark.createDataFrame([(model, space)], "model string, space string")).select("model", "param_key", "params")
    full = with_default(grid, spark.createDataFrame([(model, f"{model}_hp_0")], "model string, param_key string"))
    return _param_rows(full if share is None else random_search(full, ["model"], share, seed))


def forest_job(spark: SparkSession, folds: str, out: str, variant: str, features: list[str], grid: list[dict],
               label: str = K.LABEL, k: int = 5, seeds: dict[int, dict] | None = None, parallelism: int = 4) -> None:
    """Forest search on train and val, refit of the winners on train_val, test scores, models saved per fold."""
    rows = read_folds(spark, folds, variant, ["train", "val", "train_val", "test"])
    data = assembled(rows, features, label, ["fold", "role"])
    write_table(search.forest_search(data, grid, k, seeds=seeds, parallelism=parallelism), f"{out}/stats")
    stats = spark.read.parquet(f"{out}/stats")
    write_table(best_params(stats, ["model", "fold"]), f"{out}/best_params")
    keep: dict = {}
    listed = [*grid, *[{**p, "param_key": "random_forest_hp__1"} for p in (seeds or {}).values()]]
    write_table(search.refit_sweep(data, "random_forest", stats, listed, forest, k, parallelism, keep), f"{out}/test_stats")
    for (fold, key), model in keep.items():
        save_model(model, f"{out}/models/fold={fold}/{key}")


def svr_job(spark: SparkSession, folds: str, out: str, variant: str, features: list[str], grid: list[dict],
            label: str = K.LABEL, k: int = 5, size: int = 64, seeds: dict[int, dict] | None = None) -> None:
    """Support-vector search on train and val, each fold's winner fitted again on train_val, test scores; the machines are stored.

    ``seeds`` takes each fold's earlier winner into a second round as ``svr_hp__1``.
    """
    rows = read_folds(spark, folds, variant, ["train", "val", "train_val", "test"])
    write_table(search.svr_search(rows, features, label, grid, k=k, size=size, seeds=seeds), f"{out}/stats")
    best = best_params(spark.read.parquet(f"{out}/stats"), ["model", "fold"])
    write_table(best, f"{out}/best_params")
    sets = {g["param_key"]: g for g in grid}
    won = {r["fold"]: r["param_key"] for r in best.filter("param_key IS NOT NULL").collect()}
    chosen = {f: [sets[key] if key in sets else {**seeds[f], "param_key": key}] for f, key in won.items()}
    again, maps = fit_machines(rows, features, label, chosen, "train_val", k, size=size)
    write_table(search.as_test(score_machines(rows, features, label, again, maps, "svr", k, "train_val", "test")), f"{out}/test_stats")
    write_table(machine_table(spark, again, features, maps), f"{out}/models")


def boosted_job(spark: SparkSession, folds: str, out: str, variant: str, features: list[str], trials: int, label: str = K.LABEL, k: int = 5, seed: int = 42,
                space: list[tuple[str, float, float, bool, bool]] | None = None, seconds: float | None = None) -> None:
    """Drawn boosted trials on train and val, each fold's best trial grown again on train_val, test scores; the trees are stored node by node."""
    rows = read_folds(spark, folds, variant, ["train", "val", "train_val", "test"])
    table, machines, _ = search.trial_search(rows, features, label, trials, seed, k, space=space, seconds=seconds)
    write_table(table, f"{out}/trials")
    trials_table = spark.read.parquet(f"{out}/trials")
    write_table(top1_trial(trials_table, ["fold"], "weighted_val_r2", ["trial"]), f"{out}/best_trials")
    tested, again, edges = search.refit_boosters(rows, features, label, trials_table, machines, seed, k)
    write_table(tested, f"{out}/test_stats")
    write_table(model_table(spark, again, edges, features), f"{out}/models", ["fold"])


def weights_job(spark: SparkSession, folds: str, out: str, variant: str, label: str = K.LABEL, k: int = 5) -> None:
    """Training rows of every fold without duplicates, with their bin weights."""
    rows = spark.read.parquet(folds).filter((F.col("variant") == variant) & F.col("split").isin(*TRAIN_SPLITS))
    write_table(training_weights(rows, label, ["split", "fold"], groups=k * len(TRAIN_SPLITS)), out, ["split", "fold"])


def network_job(spark: SparkSession, predictions: str, out: str) -> None:
    """Stored test predictions (fold, layers, optimizer, y, pred) to per-model, winner and joined tables."""
    rows = spark.read.parquet(predictions)
    moments = bin_moments(rows, ["fold", "layers", "optimizer"], "y", "pred")
    results, winners, joined = network_report(moments, "fold", ["layers", "optimizer"])
    for name, table in (("results", results), ("winners", winners), ("report", joined)):
        write_table(table, f"{out}/{name}")
