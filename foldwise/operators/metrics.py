"""Regression metrics from one label-bin moment table.

A bin weight depends on the label bin alone, so a scored table needs a single
aggregation to (group, bin): count, central moments of the label, squared and
absolute error. Bin counts give the weights, and the weights applied to the bin rows
give every plain and weighted metric, so no weight is joined back to the rows and
the shuffle carries at most a hundred rows per group and task. Central moments are
merged, never ``sum(y*y) - n*mean**2``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise import constants as K
from foldwise.functions.bins import label_bin, report_bin, report_bin_centre
from foldwise.functions.scalar import bad_prediction, nan_if
from foldwise.operators.folds import roles_of_bucket

METRICS = ["mse", "r2", "mae", "weighted_mse", "weighted_r2"]


def _label_moments(y: Column) -> list[Column]:
    return [
        F.count(y).alias("n"),
        F.avg(y).alias("y_mean"),
        (F.var_pop(y) * F.count(y)).alias("y_m2"),
        F.min(y).alias("y_min"),
        F.max(y).alias("y_max"),
    ]


def label_moments(df: DataFrame, by: list[str], label: str, n_edges: int = K.N_EDGES) -> DataFrame:
    """Label moments per (group, bin)."""
    y = F.col(label).cast("double")
    return df.groupBy(*by, label_bin(y, n_edges).alias("bin")).agg(*_label_moments(y))


def bin_moments(df: DataFrame, by: list[str], label: str, pred: str, binning: str = "left",
                n_edges: int = K.N_EDGES) -> DataFrame:
    """Label moments and prediction error per (group, bin); ``binning`` is ``left`` or ``report``."""
    y, p = F.col(label).cast("double"), F.col(pred).cast("double")
    key = label_bin(y, n_edges) if binning == "left" else report_bin(y)
    return df.groupBy(*by, key.alias("bin")).agg(
        *_label_moments(y),
        F.sum((y - p) * (y - p)).alias("sse"),
        F.sum(F.abs(y - p)).alias("sae"),
        F.count_if(bad_prediction(p)).alias("bad"),
    )


def merge_moments(moments: DataFrame, by: list[str]) -> DataFrame:
    """Moment rows merged to a coarser grouping (folds pooled, buckets joined to roles)."""
    key = [*by, "bin"]
    extra = [c for c in ("sse", "sae", "bad") if c in moments.columns]
    w = Window.partitionBy(*key)
    centred = moments.withColumn("_mu", F.sum(F.col("n") * F.col("y_mean")).over(w) / F.sum("n").over(w))
    return centred.groupBy(*key).agg(
        F.sum("n").alias("n"),
        F.max("_mu").alias("y_mean"),
        F.sum(F.col("y_m2") + F.col("n") * (F.col("y_mean") - F.col("_mu")) ** 2).alias("y_m2"),
        F.min("y_min").alias("y_min"),
        F.max("y_max").alias("y_max"),
        *[F.sum(c).alias(c) for c in extra],
    )


def r2_of(sse: Column, sst: Column, constant: Column, n: Column) -> Column:
    """1 - sse/sst; a constant label gives 1 for a perfect fit and else 0; fewer than two rows give NaN."""
    return (
        F.when(n < 2, F.lit(float("nan")))
        .when(constant | (sst == 0), F.when(sse == 0, 1.0).otherwise(0.0))
        .otherwise(F.lit(1.0) - sse / F.when(sst == 0, F.lit(1.0)).otherwise(sst))
    )


def metrics(moments: DataFrame, by: list[str], weighting: str = "normalised") -> DataFrame:
    """MSE, R2, MAE and the weighted MSE and R2 per group.

    ``normalised`` weighs a bin by its share of the inverse counts, ``inverse_count``
    by 1/count and rows without a bin by 0. One bad prediction turns the whole row to NaN.
    """
    g = Window.partitionBy(*by)
    n, mean, m2 = F.col("n"), F.col("y_mean"), F.col("y_m2")
    if weighting == "normalised":
        raw = F.lit(1.0) / (n + K.INVERSE_COUNT_EPS)
        with_weight = moments.withColumn("_inv", raw).withColumn("_w", F.col("_inv") / F.sum("_inv").over(g))
    else:
        with_weight = moments.withColumn("_w", F.when(F.col("bin").isNull(), 0.0).otherwise(F.lit(1.0) / n))
    w = F.col("_w")
    sums = (
        with_weight.withColumn("_mu", F.sum(n * mean).over(g) / F.sum(n).over(g))
        .withColumn("_muw", F.try_divide(F.sum(w * n * mean).over(g), F.sum(w * n).over(g)))
        .groupBy(*by)
        .agg(
            F.sum(n).alias("n"),
            F.sum("sse").alias("_sse"),
            F.sum("sae").alias("_sae"),
            F.sum(m2 + n * (mean - F.col("_mu")) ** 2).alias("_sst"),
            F.sum(w * n).alias("_wn"),
            F.sum(w * F.col("sse")).alias("_wsse"),
            F.sum(w * (m2 + n * (mean - F.col("_muw")) ** 2)).alias("_wsst"),
            (F.min("y_min") == F.max("y_max")).alias("_const"),
            F.sum("bad").alias("bad"),
        )
    )
    failed = F.col("bad") > 0
    total = F.col("n")
    return sums.select(
        *by,
        total,
        "bad",
        nan_if(failed, F.col("_sse") / total).alias("mse"),
        nan_if(failed, r2_of(F.col("_sse"), F.col("_sst"), F.col("_const"), total)).alias("r2"),
        nan_if(failed, F.col("_sae") / total).alias("mae"),
        nan_if(failed, F.try_divide("_wsse", "_wn")).alias("weighted_mse"),
        nan_if(failed, r2_of(F.col("_wsse"), F.col("_wsst"), F.col("_const"), total)).alias("weighted_r2"),
    )


def score(df: DataFrame, by: list[str], label: str, pred: str, n_edges: int = K.N_EDGES) -> DataFrame:
    """All metrics of a scored table, per group."""
    return metrics(bin_moments(df, by, label, pred, "left", n_edges), by)


def sweep_moments(df: DataFrame, label: str, preds: dict[str, list[Column]], bucket: str = "bucket",
                  extra: list[str] | None = None, roles: list[str] | None = None,
                  n_edges: int = K.N_EDGES) -> DataFrame:
    """Bin moments per (param_key, fold, role) of fold models that score every row once.

    ``preds[key][f]`` is the prediction of fold ``f``'s model under parameter set ``key``.
    Each row is read once and aggregated to (bucket, bin) with one error sum per model;
    the fold roles are attached to that small table, not to the rows.
    """
    extra = extra or []
    k = len(next(iter(preds.values())))
    y = F.col(label).cast("double")
    sums = []
    for key, models in preds.items():
        for fold, p in enumerate(models):
            p = p.cast("double")
            sums.append(
                F.struct(
                    F.lit(key).alias("param_key"),
                    F.lit(fold).alias("fold"),
                    F.sum((y - p) * (y - p)).alias("sse"),
                    F.sum(F.abs(y - p)).alias("sae"),
                    F.count_if(bad_prediction(p)).alias("bad"),
                )
            )
    table = df.groupBy(*extra, bucket, label_bin(y, n_edges).alias("bin")).agg(
        *_label_moments(y), F.array(*sums).alias("_models")
    )
    moments = ["n", "y_mean", "y_m2", "y_min", "y_max"]
    roled = (
        table.withColumn("_m", F.explode("_models"))
        .withColumn("_pairs", roles_of_bucket(F.col(bucket), k, roles))
        .withColumn("_pair", F.explode(F.filter("_pairs", lambda p: p["fold"] == F.col("_m.fold"))))
        .select(*extra, "_m.param_key", "_m.fold", F.col("_pair.role").alias("role"), "bin", *moments, "_m.sse", "_m.sae", "_m.bad")
    )
    return merge_moments(roled, [*extra, "param_key", "fold", "role"])


def fold_moments(df: DataFrame, label: str, preds: list[Column], bucket: str = "bucket",
                 extra: list[str] | None = None, roles: list[str] | None = None,
                 n_edges: int = K.N_EDGES) -> DataFrame:
    """Bin moments per (fold, role) of one model per fold."""
    return sweep_moments(df, label, {"": preds}, bucket, extra, roles, n_edges).drop("param_key")


def fold_stats(scored: DataFrame, by: list[str], train: str = "train", val: str = "val") -> DataFrame:
    """Eight-metric row: train and validation, plain and weighted, MSE and R2."""
    names = {train: "train", val: "val"}
    return scored.groupBy(*by).agg(
        *[
            F.max(F.when(F.col("role") == role, F.col(m))).alias(
                m.replace("weighted_", f"weighted_{side}_") if m.startswith("weighted_") else f"{side}_{m}"
            )
            for role, side in names.items()
            for m in ("weighted_mse", "weighted_r2", "mse", "r2")
        ]
    )


def per_bin_metrics(df: DataFrame, by: list[str], label: str, pred: str) -> DataFrame:
    """MSE, R2 and count per report bin; R2 only for bins with more than two rows."""
    m = bin_moments(df, by, label, pred, "report").filter(F.col("bin").isNotNull())
    n = F.col("n")
    r2 = r2_of(F.col("sse"), F.col("y_m2"), F.col("y_min") == F.col("y_max"), n)
    return m.select(
        *by, "bin", report_bin_centre(F.col("bin")).alias("centre"), n.alias("count"),
        (F.col("sse") / n).alias("mse"), F.when(n > 2, r2).alias("r2"),
    )


def global_metrics(df: DataFrame, by: list[str], label: str, pred: str) -> DataFrame:
    """Plain and weighted MSE and R2, the weight being 1/count of the row's report bin.

    Plain metrics cover every row; weighted ones leave out rows without a report bin.
    """
    m = bin_moments(df, by, label, pred, "report")
    return metrics(m, by, "inverse_count").select(*by, "n", "mse", "r2", "weighted_mse", "weighted_r2")


def pooled_metrics(moments: DataFrame, by: list[str]) -> DataFrame:
    """Metrics of all folds together, weights taken from the pooled label distribution."""
    return metrics(merge_moments(moments, by), by)


def extents(df: DataFrame, by: list[str], label: str, pred: str) -> DataFrame:
    """Ranges of the label and the prediction."""
    return df.groupBy(*by).agg(
        F.min(label).alias("real_min"), F.max(label).alias("real_max"),
        F.min(pred).alias("pred_min"), F.max(pred).alias("pred_max"),
    )


def constant_prediction(df: DataFrame, by: list[str], pred: str) -> DataFrame:
    """Does a model give one single value? Minimum and maximum answer it without a distinct."""
    return df.groupBy(*by).agg((F.min(pred) == F.max(pred)).alias("is_constant"))


def all_close(df: DataFrame, by: list[str], a: str, b: str, atol: float = K.CLOSE_ATOL,
              rtol: float = K.CLOSE_RTOL) -> DataFrame:
    """Do two predictions agree within ``atol + rtol * |b|`` on every row?"""
    near = F.abs(F.col(a) - F.col(b)) <= F.abs(F.col(b)) * rtol + atol
    return df.groupBy(*by).agg(
        F.bool_and(near).alias("all_close"),
        F.count_if(~near).alias("n_different"),
    )


def na_count(df: DataFrame, by: list[str], pred: str) -> DataFrame:
    """Missing predictions."""
    p = F.col(pred)
    return df.groupBy(*by).agg(F.count_if(p.isNull() | F.isnan(p)).alias("na_count"))
