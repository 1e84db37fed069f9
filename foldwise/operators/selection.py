"""Best-of selections with explicit rules for NaN and ties.

NaN never wins: it counts as missing and sorts last both ways. Selections are
aggregations over an ordering struct, so they combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise import constants as K
from foldwise.functions.scalar import is_default_key, nan_to_null


def _order(desc: list[str], asc: list[str], ties: list[Column]) -> Column:
    parts = []
    for i, (c, sign) in enumerate([(c, -1.0) for c in desc] + [(c, 1.0) for c in asc]):
        v = nan_to_null(F.col(c))
        parts += [v.isNull().alias(f"n{i}"), F.coalesce(v * sign, F.lit(0.0)).alias(f"v{i}")]
    return F.struct(*parts, *[t.alias(f"t{i}") for i, t in enumerate(ties)])


def first_row(df: DataFrame, by: list[str], order: Column) -> DataFrame:
    """The whole first row of every group."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.min_by(F.struct(*rest), order).alias("_top")).select(*by, "_top.*")


def best_scaler(stats: DataFrame, by: list[str], r2: str = "validation_r2", mse: str = "validation_mse",
                scaler: str = "scaler") -> DataFrame:
    """Scaler of highest R2, then lowest MSE, then first name."""
    return first_row(stats, by, _order([r2], [mse], [F.col(scaler)]))


def _key_number(key: Column) -> Column:
    return F.coalesce(F.regexp_extract(key, r"(\d+)$", 1).try_cast("long"), F.lit(-1).cast("long"))


def best_params(stats: DataFrame, by: list[str], param: str = "param_key",
                r2: str = "weighted_val_r2", mse: str = "weighted_val_mse",
                plain_mse: str = "val_mse", plain_r2: str = "val_r2") -> DataFrame:
    """Winning parameter set per group, why it won, and how many sets tie with it.

    The top set has the highest weighted R2, then the lowest weighted MSE. Sets equal
    to it on all four metrics tie; the default set wins a tie it is part of, otherwise
    the lowest-numbered. A group where every run failed has no winner.
    """
    four = [mse, r2, plain_mse, plain_r2]
    clean = stats.select(*by, F.col(param).alias("param_key"), *[nan_to_null(F.col(c)).alias(c) for c in four])
    number = _key_number(F.col("param_key"))
    top = clean.groupBy(*by).agg(
        F.min_by(F.struct(*four), _order([r2], [mse], [number, F.col("param_key")])).alias("_top")
    ).select(*by, *[F.col(f"_top.{c}").alias(f"_top_{c}") for c in four])
    same = F.lit(True)
    for c in four:
        same = same & F.col(c).eqNullSafe(F.col(f"_top_{c}"))
    tied = clean.join(top, by).filter(same)
    default_first = F.struct((~is_default_key(F.col("param_key"))).alias("a"), number.alias("b"), F.col("param_key").alias("c"))
    found = tied.groupBy(*by).agg(
        F.count("*").alias("tie_count"),
        F.min_by("param_key", default_first).alias("param_key"),
        F.bool_or(is_default_key(F.col("param_key"))).alias("_default"),
        F.max(f"_top_{r2}").alias("_r2"),
    )
    failed = F.col("_r2").isNull()
    return found.select(
        *by,
        F.when(~failed, F.col("param_key")).alias("param_key"),
        F.when(failed, K.REASON_NONE)
        .when(F.col("tie_count") == 1, K.REASON_SINGLE)
        .when(F.col("_default"), K.REASON_TIE_DEFAULT)
        .otherwise(K.REASON_TIE_FIRST).alias("reason"),
        F.when(failed, F.lit(0).cast("long")).otherwise(F.col("tie_count")).alias("tie_count"),
    )


def best_per_fold(results: DataFrame, by: list[str], r2: str, ties: list[str]) -> DataFrame:
    """Row of the highest R2 per fold; missing values cannot win while another is present."""
    return first_row(results, by, _order([r2], [], [F.col(t) for t in ties]))


def top1_trial(trials: DataFrame, by: list[str], r2: str, ties: list[str]) -> DataFrame:
    """Best trial per fold."""
    return best_per_fold(trials, by, r2, ties)


def rank_alphas(stats: DataFrame, by: list[str], alpha: str = "alpha", r2: str = "weighted_val_r2",
                mse: str = "weighted_val_mse", top: int | None = None) -> DataFrame:
    """Penalties by mean R2 over the folds; ``top`` keeps the best of each model.

    Means are compared to twelve digits, so that the order of summation cannot decide a rank.
    """
    mean = stats.groupBy(*by, alpha).agg(
        F.avg(nan_to_null(F.col(r2))).alias("mean_r2"), F.avg(nan_to_null(F.col(mse))).alias("mean_mse"),
        F.count(nan_to_null(F.col(r2))).alias("n_folds"),
    )
    order = Window.partitionBy(*by).orderBy(F.desc_nulls_last(F.round("mean_r2", 12)), F.asc_nulls_last(F.round("mean_mse", 12)), alpha)
    ranked = mean.withColumn("rank", F.row_number().over(order))
    return ranked if top is None else ranked.filter(F.col("rank") <= top)


def summarise_models(stats: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Mean and deviation of metrics over the folds (an addition for reports)."""
    return stats.groupBy(*by).agg(
        *[F.avg(nan_to_null(F.col(c))).alias(f"{c}_mean") for c in values],
        *[F.stddev_samp(nan_to_null(F.col(c))).alias(f"{c}_sd") for c in values],
        F.count("*").alias("n_folds"),
    )
