"""Linear models fitted from cross products, and their scoring."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise import constants as K
from foldwise.operators.folds import assign_roles, roles_of_bucket
from foldwise.operators.metrics import fold_moments, metrics
from foldwise.operators.moments import FoldSums, Sums, cross_sums, unpack

STATS_SCHEMA = (
    "model string, scaler string, param string, fold int, "
    "weighted_train_mse double, weighted_train_r2 double, train_mse double, train_r2 double, "
    "weighted_val_mse double, weighted_val_r2 double, val_mse double, val_r2 double, "
    "intercept double, coefs array<double>"
)


@dataclass
class Fit:
    """Intercept and coefficients in the units of the stored columns."""

    intercept: float
    coefs: np.ndarray


def penalised(c_xx: np.ndarray, c_xy: np.ndarray, alpha: float, ratio: float, tol: float = 1e-12,
              max_iter: int = 20_000) -> np.ndarray:
    """Minimise ``b'Cb/2 - c'b + alpha (ratio |b|_1 + (1 - ratio)/2 |b|_2^2)`` over the coefficients."""
    p = len(c_xy)
    ridge = alpha * (1 - ratio)
    lasso = alpha * ratio
    if lasso == 0:
        a = c_xx + ridge * np.eye(p)
        # Minimum-norm solution in units of the columns' own spread, so constants get no weight.
        d = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
        return np.linalg.lstsq(a / np.outer(d, d), c_xy / d, rcond=1e-12)[0] / d
    b = np.zeros(p)
    diag = np.diag(c_xx) + ridge
    gradient = c_xy.copy()
    for _ in range(max_iter):
        moved = 0.0
        for j in range(p):
            if diag[j] <= 0:
                continue
            r = gradient[j] + c_xx[j, j] * b[j]
            new = math.copysign(max(abs(r) - lasso, 0.0), r) / diag[j]
            step = new - b[j]
            if step:
                gradient -= c_xx[:, j] * step
                b[j] = new
                moved = max(moved, abs(step) * math.sqrt(diag[j]))
        if moved < tol:
            break
    return b


def fit_sums(sums: FoldSums, fold: int, role: str = "train", alpha: float = 0.0, ratio: float = 0.0,
             scaler: str = "IdentityScaler", matrix: np.ndarray | None = None, divisor: np.ndarray | None = None) -> Fit:
    """Fit one fold; the penalty acts on raw or standardised columns.

    ``divisor`` is the scale of any other affine scaler fitted on the fold's training rows.
    """
    m = sums.table[(fold, role)].plain if matrix is None else matrix
    n = m[0, 0]
    mean = m[0] / n
    cov = m / n - np.outer(mean, mean)
    # Centred sums are in units of ``scale``; bring them to the units the penalty sees.
    if divisor is not None:
        unit = sums.scale / divisor
    elif scaler == "StandardScaler":
        sd = np.sqrt(np.maximum(np.diag(cov)[1:-1], 0.0))
        unit = np.where(sd > 0, 1.0 / np.where(sd > 0, sd, 1.0), 1.0)
    elif scaler == "IdentityScaler":
        unit = sums.scale
    else:
        raise ValueError(f"apply {scaler} to the rows before taking cross products")
    b = penalised(cov[1:-1, 1:-1] * np.outer(unit, unit), cov[1:-1, -1] * unit, alpha, ratio)
    coefs = b * unit / sums.scale
    intercept = sums.label_shift + mean[-1] - float(coefs @ (sums.shift + sums.scale * mean[1:-1]))
    return Fit(intercept, coefs)


def _errors(m: np.ndarray, v: np.ndarray) -> tuple[float, float]:
    total = m[0, 0]
    sse = max(float(v @ m @ v), 0.0)
    sst = max(float(m[-1, -1] - m[0, -1] ** 2 / total), 0.0)
    if total and sst > 1e-14 * max(float(m[-1, -1]), 1e-300):
        r2 = 1.0 - sse / sst
    else:
        r2 = 1.0 if sse <= 1e-14 * total else 0.0
    return float(sse / total), float(r2)


def score_sums(sums: FoldSums, fit: Fit, fold: int, role: str) -> dict[str, float]:
    """Plain and weighted MSE and R2 of a fit on one (fold, role)."""
    s = sums.table[(fold, role)]
    v = sums.residual_vector(fit.intercept, fit.coefs)
    if not np.isfinite(v).all():
        return dict.fromkeys(["mse", "r2", "weighted_mse", "weighted_r2"], math.nan)
    mse, r2 = _errors(s.plain, v)
    wmse, wr2 = _errors(s.weighted, v)
    return {"mse": mse, "r2": r2, "weighted_mse": wmse, "weighted_r2": wr2}


def _stats_row(sums: FoldSums, fit: Fit, fold: int, train: str, val: str) -> list[float]:
    out = []
    for role in (train, val):
        m = score_sums(sums, fit, fold, role)
        out += [m["weighted_mse"], m["weighted_r2"], m["mse"], m["r2"]]
    return out


def grid_stats(spark: SparkSession, sums: FoldSums, grid: DataFrame, scaler: str = "IdentityScaler",
               train: str = "train", val: str = "val", partitions: int | None = None) -> DataFrame:
    """Eight metrics for every (model, param, fold) row of the grid, solved in parallel.

    ``grid`` holds ``model, param_key, fold, alpha, l1_ratio``. The cross products
    go to the tasks as one broadcast variable: they are bounded by the number of
    columns, not rows. A row that fails gives NaN metrics and the sweep goes on.
    """
    shared = spark.sparkContext.broadcast(sums)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = shared.value
        cache: dict[tuple, tuple[Fit, list[float]]] = {}
        for frame in frames:
            rows = []
            for model, key, fold, alpha, ratio in frame[["model", "param_key", "fold", "alpha", "l1_ratio"]].itertuples(index=False):
                share = K.PENALTY_RATIO.get(model, ratio)
                point = (int(fold), float(alpha), float(share))
                try:
                    if point not in cache:
                        fit = fit_sums(s, point[0], train, point[1], point[2], scaler)
                        cache[point] = (fit, _stats_row(s, fit, point[0], train, val))
                    fit, stats = cache[point]
                    rows.append([model, scaler, key, fold, *stats, fit.intercept, fit.coefs.tolist()])
                except (ValueError, KeyError, np.linalg.LinAlgError):
                    rows.append([model, scaler, key, fold, *[math.nan] * 8, None, None])
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in STATS_SCHEMA.split(", ")])

    n = partitions or spark.sparkContext.defaultParallelism
    # Points that differ only in solver labels meet in one task and are solved once.
    spread = grid.select("model", "param_key", "fold", "alpha", "l1_ratio").repartition(n, "fold", "alpha", "l1_ratio")
    found = spread.mapInPandas(solve, STATS_SCHEMA)
    # NaN leaves pandas as null; a failed run is a NaN row.
    measured = [c.split()[0] for c in STATS_SCHEMA.split(", ") if "_mse" in c or "_r2" in c]
    return found.withColumns({c: F.coalesce(c, F.lit(float("nan"))) for c in measured})


def predict(fit: Fit, features: list[str]) -> Column:
    """Prediction as a column expression."""
    out = F.lit(float(fit.intercept))
    for c, b in zip(features, fit.coefs):
        out = out + F.col(c).cast("double") * float(b)
    return out


def fold_fits(sums: FoldSums, role: str = "train", alpha: float = 0.0, ratio: float = 0.0,
              scaler: str = "IdentityScaler") -> list[Fit]:
    """One fit per fold."""
    return [fit_sums(sums, f, role, alpha, ratio, scaler) for f in range(sums.k)]


def fits_table(spark: SparkSession, fits: list[Fit], features: list[str], model: str) -> DataFrame:
    """Coefficients of the fold models as a small table (to persist a closed-form model)."""
    rows = [(model, f, float(x.intercept), features, [float(b) for b in x.coefs]) for f, x in enumerate(fits)]
    return spark.createDataFrame(rows, "model string, fold int, intercept double, features array<string>, coefs array<double>")


def score_fits(df: DataFrame, fits: list[Fit], features: list[str], label: str, bucket: str = "bucket",
               roles: list[str] | None = None) -> DataFrame:
    """Metrics per (fold, role) by scoring the rows themselves, one scan for all folds."""
    return metrics(fold_moments(df, label, [predict(f, features) for f in fits], bucket, roles=roles), ["fold", "role"])


def bin_weighted_fit(sums: FoldSums, fold: int, scaled: list[str], role: str = "train") -> Fit:
    """Least squares on rows multiplied by the root of their bin weight.

    Listed features and the label are multiplied, other features and the intercept
    are not; this is not the fit a weight column gives.
    """
    s: Sums = sums.table[(fold, role)]
    raw = sums.to_raw()
    powers = np.array([0] + [1 if c in scaled else 0 for c in sums.features] + [1])
    parts = [raw @ m @ raw.T for m in (s.plain, s.rooted, s.weighted)]
    m = np.choose(powers[:, None] + powers[None, :], parts)
    n = m[0, 0]
    mean = m[0] / n
    cov = m / n - np.outer(mean, mean)
    b = penalised(cov[1:-1, 1:-1], cov[1:-1, -1], 0.0, 0.0)
    return Fit(float(mean[-1] - b @ mean[1:-1]), b)


def naive_report(df: DataFrame, label: str, bucket: str = "bucket", k: int = 5, extra: list[str] | None = None,
                 train: str = "train", roles: list[str] | None = None) -> DataFrame:
    """The mean of the training label as the model of each fold, scored on the wanted roles.

    Means come from bucket moments; a second scan scores all fold means at once.
    """
    extra = extra or []
    by_bucket = df.groupBy(*extra, bucket).agg(F.count(label).alias("n"), F.avg(label).alias("m"))
    means = (
        by_bucket.withColumn("_pair", F.explode(roles_of_bucket(F.col(bucket), k, [train])))
        .groupBy(*extra, F.col("_pair.fold").alias("fold"))
        .agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("naive_mean"))
    )
    # A value list per bucket keeps the scoring join an equi-join on a table of k rows.
    packed = means.groupBy(*extra).agg(F.map_from_entries(F.collect_list(F.struct("fold", "naive_mean"))).alias("_means"))
    per_bucket = packed.withColumn(bucket, F.explode(F.array(*[F.lit(b) for b in range(k)])))
    joined = df.join(F.broadcast(per_bucket) if not extra else per_bucket, [*extra, bucket])
    preds = [F.col("_means")[f] for f in range(k)]
    scored = metrics(fold_moments(joined, label, preds, bucket, extra, roles), [*extra, "fold", "role"])
    return scored.join(means, [*extra, "fold"])


def naive_mean(df: DataFrame, label: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(label).alias("naive_mean"), F.count(label).alias("n"))


def residuals(df: DataFrame, label: str, pred: Column, name: str = "residual") -> DataFrame:
    return df.withColumn(name, F.col(label) - pred)


def _per_fold(fits: list[Fit], features: list[str]) -> Column:
    """Prediction of the model of the row's own ``fold`` column."""
    return F.element_at(F.array(*[predict(f, features) for f in fits]), F.col("fold") + 1)


def weighted_fold_fits(df: DataFrame, features: list[str], label: str, weight: Column, sums: FoldSums,
                       role: str = "train", bucket: str = "bucket") -> list[Fit]:
    """Weighted least squares per fold; ``weight`` may use the row's ``fold``."""
    rows = assign_roles(df.select(bucket, label, *features), bucket, sums.k, [role])
    z = [F.lit(1.0)]
    z += [(F.col(c).cast("double") - float(m)) / float(s) for c, m, s in zip(features, sums.shift, sums.scale)]
    z.append(F.col(label).cast("double") - sums.label_shift)
    packed = cross_sums(rows, ["fold"], z, weight).groupBy("fold").agg(
        F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("g")
    )
    found = {r["fold"]: unpack(r["v"], sums.width) for r in packed.select("fold", F.col("g.v").alias("v")).collect()}
    return [fit_sums(sums, f, role, matrix=found[f]) for f in range(sums.k)]


def two_stage_fits(df: DataFrame, features: list[str], label: str, sums: FoldSums, role: str = "train",
                   bucket: str = "bucket") -> tuple[list[Fit], list[Fit]]:
    """Ordinary fit, then a fit weighted by ``1 / (residual^2 + 1e-6)``."""
    first = fold_fits(sums, role)
    r = F.col(label) - _per_fold(first, features)
    second = weighted_fold_fits(df, features, label, F.lit(1.0) / (r * r + K.INVERSE_COUNT_EPS), sums, role, bucket)
    return first, second


def two_stage_report(df: DataFrame, features: list[str], label: str, sums: FoldSums, train: str = "train",
                     val: str = "val", bucket: str = "bucket") -> DataFrame:
    """Eight metrics of both stages per fold, with the stage's sample-weight note."""
    first, second = two_stage_fits(df, features, label, sums, train, bucket)
    spark = df.sparkSession
    rows = []
    for model, note, fits in (("ols_stat_models", "None yet: OLS", first), ("wls_stat_models", "Manual: WLS", second)):
        for f, fit in enumerate(fits):
            rows.append([model, f, *_stats_row(sums, fit, f, train, val), note, float(fit.intercept), [float(b) for b in fit.coefs]])
    names = ", ".join(c for c in STATS_SCHEMA.split(", ") if c.split()[0] not in ("model", "scaler", "param", "fold", "intercept", "coefs"))
    return spark.createDataFrame(rows, f"model string, fold int, {names}, sample_weight string, intercept double, coefs array<double>")


def chi2_tail(x: float, df: int) -> float:
    """Upper tail of the chi-square distribution for whole degrees of freedom."""
    if x <= 0:
        return 1.0
    h = x / 2
    if df % 2 == 0:
        term, total = 1.0, 1.0
        for i in range(1, df // 2):
            term *= h / i
            total += term
        return math.exp(-h) * total
    total = math.erfc(math.sqrt(h))
    term = math.exp(-h) * math.sqrt(h) * 2 / math.sqrt(math.pi)
    for i in range(1, (df - 1) // 2 + 1):
        total += term
        term *= h / (i + 0.5)
    return total


def breusch_pagan(df: DataFrame, features: list[str], label: str, sums: FoldSums, fits: list[Fit],
                  role: str = "train", bucket: str = "bucket") -> DataFrame:
    """LM statistic ``n * R2`` of the squared residuals on the features, per fold."""
    rows = assign_roles(df.select(bucket, label, *features), bucket, sums.k, [role])
    r = F.col(label) - _per_fold(fits, features)
    z = [F.lit(1.0)]
    z += [(F.col(c).cast("double") - float(m)) / float(s) for c, m, s in zip(features, sums.shift, sums.scale)]
    z.append(r * r)
    packed = cross_sums(rows, ["fold"], z).groupBy("fold").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("g"))
    out = []
    for row in packed.select("fold", F.col("g.v").alias("v")).collect():
        m = unpack(row["v"], sums.width)
        n = m[0, 0]
        mean = m[0] / n
        cov = m / n - np.outer(mean, mean)
        b = penalised(cov[1:-1, 1:-1], cov[1:-1, -1], 0.0, 0.0)
        lm = float(n * (b @ cov[1:-1, -1]) / cov[-1, -1]) if cov[-1, -1] > 0 else 0.0
        out.append((row["fold"], int(round(n)), lm, chi2_tail(lm, len(features))))
    return df.sparkSession.createDataFrame(out, "fold int, n long, lm double, p_value double")
