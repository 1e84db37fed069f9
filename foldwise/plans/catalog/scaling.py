"""Feature scalers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.functions.scalar import ACKLAM, ACKLAM_CUT, inverse_normal
from foldwise.operators.quantiles import exact_quantiles
from foldwise.operators.scalers import NORMAL_LIMIT, QUANTILE_GRID, fit_power, scale_folds, yeo_johnson
from foldwise.plans.catalog.registry import query
from foldwise.plans.fixtures import EDGES, FOLDS, PTS, ROLES, binned, points
from foldwise.plans.scaler_study import scale_weighted, scaler_study, study_winners

SCALED = ["x1", "x2", "x3"]
_TRAIN = f"{PTS}, {ROLES}, tr AS (SELECT fold, pts.* FROM pts JOIN roles USING (bucket) WHERE role = 'train'), va AS (SELECT fold, pts.* FROM pts JOIN roles USING (bucket) WHERE role = 'val')"


def _scale_sql(stats: str, expr: str) -> str:
    """SQL: validation rows scaled by statistics of the training rows; ``$`` stands for the column."""
    s = ", ".join(stats.replace("$", c) for c in SCALED)
    e = ", ".join(f"round({expr.replace('$', c)}, 6) + 0e0 AS {c}" for c in SCALED)
    return f"WITH {_TRAIN}, st AS (SELECT fold, {s} FROM tr GROUP BY fold) SELECT fold, row_key, {e} FROM va JOIN st USING (fold)"


def _scaled(spark: SparkSession, d: str, kinds: list[str]) -> DataFrame:
    df = points(spark, d).select("row_key", "bucket", *SCALED)
    out = scale_folds(df, SCALED, kinds, ["val"], "train", "bucket", FOLDS)
    return out.select("fold", "row_key", *[(F.round(c, 6) + 0.0).alias(c) for c in SCALED])


@query("scale_standard", _scale_sql("avg($) AS m_$, stddev_pop($) AS s_$", "($ - m_$) / s_$"))
def scale_standard(spark: SparkSession, d: str) -> DataFrame:
    return _scaled(spark, d, ["StandardScaler"])


@query("scale_minmax", _scale_sql("min($) AS a_$, max($) AS z_$", "($ - a_$) / (z_$ - a_$)"))
def _minmax(spark: SparkSession, d: str) -> DataFrame:
    return _scaled(spark, d, ["MinMaxScaler"])


@query("scale_maxabs", _scale_sql("max(abs($)) AS m_$", "$ / m_$"))
def _maxabs(spark: SparkSession, d: str) -> DataFrame:
    return _scaled(spark, d, ["MaxAbsScaler"])


@query("scale_robust", _scale_sql(
    "quantile_cont($, 0.25) AS a_$, quantile_cont($, 0.5) AS m_$, quantile_cont($, 0.75) AS z_$", "($ - m_$) / (z_$ - a_$)"))
def scale_robust(spark: SparkSession, d: str) -> DataFrame:
    return _scaled(spark, d, ["RobustScaler"])


@query("scale_log", _scale_sql("count(*) AS n_$", "ln(1 + $)"))
def _log(spark: SparkSession, d: str) -> DataFrame:
    return _scaled(spark, d, ["LogScaler"])


@query("scale_identity", _scale_sql("count(*) AS n_$", "$"))
def _identity(spark: SparkSession, d: str) -> DataFrame:
    return _scaled(spark, d, ["IdentityScaler"])


@query("scale_log_standard", _scale_sql("avg(ln(1 + $)) AS m_$, stddev_pop(ln(1 + $)) AS s_$", "(ln(1 + $) - m_$) / s_$"))
def _log_standard(spark: SparkSession, d: str) -> DataFrame:
    return _scaled(spark, d, ["LogScaler", "StandardScaler"])


@query("scale_weighted", f"""
WITH {_TRAIN}, {EDGES}, {binned("tr", "b")}, c AS (SELECT fold, bin, count(*) AS n FROM b GROUP BY ALL),
w AS (SELECT fold, bin, (1 / (n + 1e-6)) / sum(1 / (n + 1e-6)) OVER (PARTITION BY fold) AS w FROM c),
h AS (SELECT fold, row_key, x1 * sqrt(w) AS x1, y * sqrt(w) AS y FROM b JOIN w USING (fold, bin)),
hs AS (SELECT fold, avg(x1) AS m, stddev_pop(x1) AS s FROM h GROUP BY fold),
ps AS (SELECT fold, avg(x1) AS m, stddev_pop(x1) AS s FROM tr GROUP BY fold)
SELECT fold, 'train' AS role, row_key, round((x1 - m) / s, 6) AS x1, round(y, 8) AS y FROM h JOIN hs USING (fold)
UNION ALL SELECT fold, 'val', row_key, round((x1 - m) / s, 6), round(y, 8) FROM va JOIN ps USING (fold)""")
def _weighted(spark: SparkSession, d: str) -> DataFrame:
    df = points(spark, d).select("row_key", "bucket", "x1", "y")
    train, val = scale_weighted(df, ["x1"], "y", "StandardScaler", "bucket", FOLDS)
    cols = ["fold", "role", "row_key", F.round("x1", 6).alias("x1"), F.round("y", 8).alias("y")]
    return train.select(*cols).unionByName(val.select(*cols))


@query("exact_quantiles", f"""
WITH {PTS}, q AS (SELECT bucket, unnest([0.1, 0.25, 0.5, 0.9])::DOUBLE AS prob,
  unnest(quantile_cont(x2, [0.1, 0.25, 0.5, 0.9])) AS x2, unnest(quantile_cont(y, [0.1, 0.25, 0.5, 0.9])) AS y FROM pts GROUP BY bucket)
SELECT bucket, 'x2' AS "column", prob, round(x2, 8) AS value FROM q UNION ALL SELECT bucket, 'y', prob, round(y, 8) FROM q""")
def _quantiles(spark: SparkSession, d: str) -> DataFrame:
    q = exact_quantiles(points(spark, d), ["bucket"], ["x2", "y"], [0.1, 0.25, 0.5, 0.9], FOLDS)
    return q.withColumn("value", F.round("value", 8))


@query("yeo_johnson_fixed", f"""
WITH {PTS}, t AS (SELECT row_key, (x1 - 25) / 5 AS x FROM pts)
SELECT row_key, round(CASE WHEN x >= 0 THEN ((x + 1) ** 5e-1 - 1) / 5e-1 ELSE -((1 - x) ** 15e-1 - 1) / 15e-1 END, 8) + 0e0 AS half,
  round(CASE WHEN x >= 0 THEN ln(1 + x) ELSE -((1 - x) ** 2 - 1) / 2 END, 8) + 0e0 AS zero,
  round(CASE WHEN x >= 0 THEN ((x + 1) ** 2 - 1) / 2 ELSE -ln(1 - x) END, 8) + 0e0 AS two FROM t""")
def _yeo(spark: SparkSession, d: str) -> DataFrame:
    x = (F.col("x1") - 25) / 5
    return points(spark, d).select(
        "row_key", *[(F.round(yeo_johnson(x, F.lit(v)), 8) + 0.0).alias(n) for n, v in (("half", 0.5), ("zero", 0.0), ("two", 2.0))]
    )


@query("power_transform")
def power_transform(spark: SparkSession, d: str) -> DataFrame:
    df = points(spark, d, heavy=True).select("row_key", "bucket", *SCALED)
    return scale_folds(df, SCALED, ["PowerTransformer"], ["val"], "train", "bucket", FOLDS).select("fold", "row_key", *SCALED)


@query("power_lambdas")
def _lambdas(spark: SparkSession, d: str) -> DataFrame:
    params = fit_power(points(spark, d, heavy=True), ["bucket"], SCALED, FOLDS)
    return params.select("bucket", F.explode("params").alias("column", "p")).select(
        "bucket", "column", F.col("p")[0].alias("lam"), F.col("p")[1].alias("mean"), F.col("p")[2].alias("sd")
    )


def _normal_sql(p: str) -> str:
    """SQL: quantile of the standard normal at a column ``p``."""
    def poly(coefs: list[float], x: str) -> str:
        out = f"{coefs[0]:.17e}"
        for k in coefs[1:]:
            out = f"({out} * {x} + {k:.17e})"
        return out

    a, b, c, e = ACKLAM
    low, high, r = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))", f"(({p} - 5e-1) * ({p} - 5e-1))"
    return (f"CASE WHEN {p} < {ACKLAM_CUT} THEN {poly(c, low)} / {poly(e, low)} WHEN {p} > 1 - {ACKLAM_CUT} THEN -{poly(c, high)} / {poly(e, high)} "
            f"ELSE {poly(a, r)} * ({p} - 5e-1) / {poly(b, r)} END")


def _quantile_sql() -> str:
    """SQL: a thousand exact quantiles per fold, and validation rows placed among them by an as-of join per column."""
    probs = ", ".join(f"{q:.17e}" for q in QUANTILE_GRID)
    parts = [f"WITH {_TRAIN}"]
    for c in SCALED:
        parts.append(f"""q_{c} AS (SELECT fold, q, min(i) AS a, max(i) AS z, lead(q) OVER (PARTITION BY fold ORDER BY q) AS nx FROM (
  SELECT fold, unnest(qs) AS q, unnest(range(1000)) AS i FROM (SELECT fold, quantile_cont({c}, [{probs}]) AS qs FROM tr GROUP BY fold)) GROUP BY fold, q),
p_{c} AS (SELECT va.fold, row_key, greatest(1e-7, least(1 - 1e-7, CASE WHEN q IS NULL THEN 0e0 WHEN {c} = q THEN (a + z) / 2e0 / 999e0 WHEN nx IS NULL THEN 1e0
  ELSE (z + ({c} - q) / (nx - q)) / 999e0 END)) AS p FROM va ASOF LEFT JOIN q_{c} ON va.fold = q_{c}.fold AND va.{c} >= q_{c}.q),
z_{c} AS (SELECT fold, row_key, greatest(-{NORMAL_LIMIT}, least({NORMAL_LIMIT}, {_normal_sql("p")})) AS z FROM p_{c})""")
    joined = " ".join(f"JOIN z_{c} USING (fold, row_key)" for c in SCALED[1:])
    cols = ", ".join(f"round(z_{c}.z, 6) + 0e0 AS {c}" for c in SCALED)
    return f"{', '.join(parts)} SELECT fold, row_key, {cols} FROM z_{SCALED[0]} {joined}"


@query("quantile_transform", _quantile_sql())
def quantile_transform(spark: SparkSession, d: str) -> DataFrame:
    return _scaled(spark, d, ["QuantileTransformer"])


@query("inverse_normal", f"WITH {PTS}, c AS (SELECT row_key, greatest(1e-7, least(1 - 1e-7, y)) AS p FROM pts) SELECT row_key, round({_normal_sql('p')}, 8) + 0e0 AS z FROM c")
def _inverse(spark: SparkSession, d: str) -> DataFrame:
    z = inverse_normal(F.least(F.greatest("y", F.lit(1e-7)), F.lit(1 - 1e-7)))
    return points(spark, d).select("row_key", (F.round(z, 8) + 0.0).alias("z"))


@query("scaler_study")
def _study(spark: SparkSession, d: str) -> DataFrame:
    df = points(spark, d, heavy=True).select("bucket", "y", *SCALED, "annotation_score", "protein_existence")
    return scaler_study(df, SCALED, ["annotation_score", "protein_existence"], "y", k=FOLDS)


@query("scaler_study_winners")
def _winners(spark: SparkSession, d: str) -> DataFrame:
    df = points(spark, d).select("bucket", "y", *SCALED, "annotation_score")
    study = scaler_study(df, SCALED, ["annotation_score"], "y", scalers=["StandardScaler", "MinMaxScaler", "LogScaler", "IdentityScaler"],
                         statuses=["unweighted"], k=FOLDS)
    return study_winners(study)
