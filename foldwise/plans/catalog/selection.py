"""Best-of selections over run statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.operators import selection
from foldwise.operators.grid import resolve_params
from foldwise.operators.joins import attach_winner
from foldwise.plans.catalog.registry import query
from foldwise.plans.fixtures import STATS, TRIALS, run_stats, trials

_R2 = "CASE WHEN isnan(weighted_val_r2) THEN NULL ELSE weighted_val_r2 END"
_MSE = "CASE WHEN isnan(weighted_val_mse) THEN NULL ELSE weighted_val_mse END"
_BEST = f"""{STATS}, r AS (SELECT *, row_number() OVER (PARTITION BY model, fold ORDER BY {_R2} DESC NULLS LAST, {_MSE} ASC NULLS LAST, i) AS rn FROM stats),
top AS (SELECT model, fold, weighted_val_r2 AS a, weighted_val_mse AS b, val_r2 AS c, val_mse AS d FROM r WHERE rn = 1),
tied AS (SELECT s.* FROM stats s JOIN top t ON s.model = t.model AND s.fold = t.fold AND s.weighted_val_r2 = a AND s.weighted_val_mse = b AND s.val_r2 = c AND s.val_mse = d),
best AS (SELECT model, fold, CASE WHEN bool_or(i = 0) THEN model || '_hp_0' ELSE arg_min(param_key, i) END AS param_key,
  CASE WHEN count(*) = 1 THEN 'single best answer by r2/mse' WHEN bool_or(i = 0) THEN '2+ best params, with default'
       ELSE '2+ best params, without default' END AS reason, count(*) AS tie_count FROM tied GROUP BY model, fold)"""


@query("run_stats", f"""
WITH {STATS} SELECT model, fold, param_key, weighted_val_r2, round(weighted_val_mse, 8) AS weighted_val_mse, val_r2, round(val_mse, 8) AS val_mse FROM stats""")
def _stats(spark: SparkSession, d: str) -> DataFrame:
    return run_stats(spark, d).select(
        "model", "fold", "param_key", "weighted_val_r2", F.round("weighted_val_mse", 8).alias("weighted_val_mse"),
        "val_r2", F.round("val_mse", 8).alias("val_mse"),
    )


@query("best_params", f"WITH {_BEST} SELECT * FROM best")
def best_params(spark: SparkSession, d: str) -> DataFrame:
    return selection.best_params(run_stats(spark, d), ["model", "fold"])


@query("best_params_coarse", f"""
WITH {_BEST.replace("* 5e2)) / 1e2", "* 5e3)) / 1e1")} SELECT * FROM best""")
def _coarse(spark: SparkSession, d: str) -> DataFrame:
    # Rounded further, so that most folds hold ties.
    s = run_stats(spark, d)
    wr2 = F.when(F.col("i") == 6, F.lit(float("nan"))).otherwise(F.col("val_r2"))
    return selection.best_params(s.withColumns({"weighted_val_r2": wr2, "weighted_val_mse": 1 - wr2}), ["model", "fold"])


@query("best_params_all_failed", """
SELECT event_type AS model, CAST(user_id % 5 AS INT) AS fold, CAST(NULL AS VARCHAR) AS param_key, 'no valid run' AS reason,
  CAST(0 AS BIGINT) AS tie_count FROM events GROUP BY event_type, user_id % 5""")
def _failed(spark: SparkSession, d: str) -> DataFrame:
    nan = F.lit(float("nan"))
    s = run_stats(spark, d).withColumns({c: nan for c in ("weighted_val_r2", "weighted_val_mse", "val_r2", "val_mse")})
    return selection.best_params(s, ["model", "fold"])


@query("resolve_params", f"""
WITH {_BEST} SELECT b.model, b.fold, b.param_key, g.i, g.i * 1e-2 AS alpha FROM best b
JOIN (SELECT DISTINCT model, param_key, i FROM stats) g ON b.model = g.model AND b.param_key = g.param_key""")
def _resolve(spark: SparkSession, d: str) -> DataFrame:
    s = run_stats(spark, d)
    grid = s.select("model", "param_key", "i", (F.col("i") * 0.01).alias("alpha")).distinct()
    best = selection.best_params(s, ["model", "fold"]).select("model", "fold", "param_key")
    return resolve_params(best, grid)


@query("best_scaler", f"""
WITH {STATS}, r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY {_R2} DESC NULLS LAST, {_MSE} ASC NULLS LAST, param_key) AS rn
  FROM (SELECT model, param_key, round(avg(CASE WHEN isnan(weighted_val_r2) THEN NULL ELSE weighted_val_r2 END), 10) AS weighted_val_r2,
               round(avg(CASE WHEN isnan(weighted_val_mse) THEN NULL ELSE weighted_val_mse END), 10) AS weighted_val_mse FROM stats GROUP BY ALL))
SELECT model, param_key AS scaler, round(weighted_val_r2, 8) AS validation_r2, round(weighted_val_mse, 8) AS validation_mse FROM r WHERE rn = 1""")
def _scaler(spark: SparkSession, d: str) -> DataFrame:
    real = [F.round(F.avg(F.when(~F.isnan(c), F.col(c))), 10).alias(n) for c, n in
            (("weighted_val_r2", "validation_r2"), ("weighted_val_mse", "validation_mse"))]
    means = run_stats(spark, d).groupBy("model", F.col("param_key").alias("scaler")).agg(*real)
    rounded = selection.best_scaler(means, ["model"])
    return rounded.withColumns({c: F.round(c, 8) for c in ("validation_r2", "validation_mse")})


@query("top1_trial", f"""
WITH {TRIALS}, r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY weighted_test_r2 DESC, trial) AS rn FROM trials)
SELECT fold, trial, weighted_test_r2, val_loss FROM r WHERE rn = 1""")
def _top1(spark: SparkSession, d: str) -> DataFrame:
    return selection.top1_trial(trials(spark, d), ["fold"], "weighted_test_r2", ["trial"])


@query("rank_alphas", f"""
WITH {STATS}, a AS (SELECT model, i * 1e-2 AS alpha, avg(CASE WHEN isnan(weighted_val_r2) THEN NULL ELSE weighted_val_r2 END) AS mr,
  avg(CASE WHEN isnan(weighted_val_mse) THEN NULL ELSE weighted_val_mse END) AS mm,
  count(*) FILTER (NOT isnan(weighted_val_r2)) AS n_folds FROM stats GROUP BY ALL)
SELECT model, alpha, round(mr, 8) AS mean_r2, round(mm, 8) AS mean_mse, n_folds,
  CAST(row_number() OVER (PARTITION BY model ORDER BY round(mr, 12) DESC NULLS LAST, round(mm, 12) ASC NULLS LAST, alpha) AS INT) AS rank FROM a""")
def _alphas(spark: SparkSession, d: str) -> DataFrame:
    out = selection.rank_alphas(run_stats(spark, d).withColumn("alpha", F.col("i") * 0.01), ["model"])
    return out.withColumns({c: F.round(c, 8) for c in ("mean_r2", "mean_mse")})


@query("summarise_models", f"""
WITH {STATS} SELECT model, round(avg(v), 8) AS weighted_val_r2_mean, round(stddev_samp(v), 8) AS weighted_val_r2_sd, count(*) AS n_folds
FROM (SELECT model, CASE WHEN isnan(weighted_val_r2) THEN NULL ELSE weighted_val_r2 END AS v FROM stats) GROUP BY model""")
def _summary(spark: SparkSession, d: str) -> DataFrame:
    out = selection.summarise_models(run_stats(spark, d), ["model"], ["weighted_val_r2"])
    return out.withColumns({c: F.round(c, 8) for c in ("weighted_val_r2_mean", "weighted_val_r2_sd")})


@query("winner_left_join", f"""
WITH {TRIALS}, r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY weighted_test_r2 DESC, trial) AS rn FROM trials)
SELECT t.fold, t.trial, t.val_loss, w.weighted_test_r2 AS best_r2 FROM trials t LEFT JOIN (SELECT * FROM r WHERE rn = 1) w USING (fold, trial)""")
def _winner(spark: SparkSession, d: str) -> DataFrame:
    all_ = trials(spark, d)
    best = selection.best_per_fold(all_, ["fold"], "weighted_test_r2", ["trial"])
    return attach_winner(all_.select("fold", "trial", "val_loss"), best.select("fold", "trial", F.col("weighted_test_r2").alias("best_r2")), ["fold", "trial"])
