"""Model fitting, cross-validation and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise import constants as K
from foldwise.operators import linear
from foldwise.operators.folds import assign_roles
from foldwise.operators.grid import linear_grid
from foldwise.operators.joins import join_small
from foldwise.operators.moments import fold_sums
from foldwise.operators.selection import best_params, rank_alphas
from foldwise.operators.trees import assembled
from foldwise.plans import search
from foldwise.plans.catalog.grids import shared_spaces
from foldwise.plans.catalog.registry import query
from foldwise.plans.fixtures import EDGES, FEATURES, FOLDS, LINE_FEATURES, PTS, ROLES, binned, metrics_sql, points, table
from foldwise.sources.models import missing_models, score_models

MOMENTS = """mom AS (SELECT fold, count(*) AS n, var_pop(x1) AS v, covar_pop(y, x1) AS c, avg(x1) AS mx, avg(y) AS my
  FROM pts JOIN roles USING (bucket) WHERE role = 'train' GROUP BY fold)"""
_EIGHT = """round(t.weighted_mse, 7) AS weighted_train_mse, round(t.weighted_r2, 7) AS weighted_train_r2, round(t.mse, 7) AS train_mse,
  round(t.r2, 7) AS train_r2, round(v.weighted_mse, 7) AS weighted_val_mse, round(v.weighted_r2, 7) AS weighted_val_r2,
  round(v.mse, 7) AS val_mse, round(v.r2, 7) AS val_r2"""
STATS8 = ["weighted_train_mse", "weighted_train_r2", "train_mse", "train_r2", "weighted_val_mse", "weighted_val_r2", "val_mse", "val_r2"]


def _round(df: DataFrame, digits: int = 7) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in STATS8})


def _one_feature_sql(fits: str) -> str:
    """SQL: eight metrics of one-feature fits ``fits(fold, key, b)`` through the training means."""
    return f"""WITH {PTS}, {ROLES}, {EDGES}, {MOMENTS}, fits AS ({fits}),
scored AS (SELECT f.key, r.fold, r.role, y, my + b * (x1 - mx) AS p FROM pts JOIN roles r USING (bucket) JOIN fits f ON f.fold = r.fold
  JOIN mom m ON m.fold = r.fold WHERE r.role IN ('train', 'val')), {binned("scored", "bb")}, {metrics_sql("bb", "key, fold, role")},
s AS (SELECT t.key, t.fold, {_EIGHT} FROM m t JOIN m v ON t.key = v.key AND t.fold = v.fold AND t.role = 'train' AND v.role = 'val')
SELECT s.* EXCLUDE (key), s.key AS param, round(b, 9) AS slope, round(my - b * mx, 8) AS intercept
FROM s JOIN fits f ON f.key = s.key AND f.fold = s.fold JOIN mom ON mom.fold = s.fold"""


def _one_feature(spark: SparkSession, d: str, model: str, points_: list[tuple[str, float, float]], scaler: str = "IdentityScaler") -> DataFrame:
    grid = spark.createDataFrame([(model, key, a, r) for key, a, r in points_], "model string, param_key string, alpha double, l1_ratio double")
    stats = search.linear_grid_search(points(spark, d), ["x1"], "y", grid, scaler, k=FOLDS)
    return _round(stats).select("fold", "param", *STATS8, F.round(F.col("coefs")[0], 9).alias("slope"), F.round("intercept", 8).alias("intercept"))


@query("ols_one_feature", _one_feature_sql("SELECT fold, 'ols_hp_0' AS key, c / v AS b FROM mom"))
def _ols(spark: SparkSession, d: str) -> DataFrame:
    return _one_feature(spark, d, "ols", [("ols_hp_0", 0.0, 0.0)])


_ALPHAS = "(VALUES ('hp_1', 1e-3), ('hp_2', 1e-1), ('hp_3', 1e1)) a(key, alpha)"
_ALPHA_POINTS = [("hp_1", 1e-3), ("hp_2", 1e-1), ("hp_3", 1e1)]


@query("ridge_one_feature", _one_feature_sql(f"SELECT fold, key, c / (v + alpha) AS b FROM mom, {_ALPHAS}"))
def _ridge(spark: SparkSession, d: str) -> DataFrame:
    return _one_feature(spark, d, "ridge", [(k, a, 0.0) for k, a in _ALPHA_POINTS])


@query("lasso_one_feature", _one_feature_sql(f"SELECT fold, key, sign(c) * greatest(abs(c) - alpha, 0) / v AS b FROM mom, {_ALPHAS}"))
def _lasso(spark: SparkSession, d: str) -> DataFrame:
    return _one_feature(spark, d, "lasso", [(k, a, 0.0) for k, a in _ALPHA_POINTS])


@query("elastic_one_feature", _one_feature_sql(
    f"SELECT fold, key, sign(c) * greatest(abs(c) - alpha * 5e-1, 0) / (v + alpha * 5e-1) AS b FROM mom, {_ALPHAS}"))
def _elastic(spark: SparkSession, d: str) -> DataFrame:
    return _one_feature(spark, d, "elasticnet", [(k, a, 0.5) for k, a in _ALPHA_POINTS])


@query("lasso_scaled_feature", _one_feature_sql(
    "SELECT fold, key, sign(c) * greatest(abs(c / sqrt(v)) - alpha, 0) / sqrt(v) AS b FROM mom, (VALUES ('hp_1', 1e-3), ('hp_2', 1e-1)) a(key, alpha)"))
def _lasso_scaled(spark: SparkSession, d: str) -> DataFrame:
    return _one_feature(spark, d, "lasso", [("hp_1", 1e-3, 0.0), ("hp_2", 1e-1, 0.0)], "StandardScaler")


@query("alpha_sweep", _one_feature_sql(
    """SELECT fold, 'lasso_alpha_' || i AS key, sign(c) * greatest(abs(c) - 10e0 ** (-5 + i * (5e0 / 99)), 0) / v AS b FROM mom, range(100) t(i)"""))
def alpha_sweep(spark: SparkSession, d: str) -> DataFrame:
    stats = search.alpha_sweep(points(spark, d), ["x1"], "y", ["lasso"], k=FOLDS)
    return _round(stats).select("fold", "param", *STATS8, F.round(F.col("coefs")[0], 9).alias("slope"), F.round("intercept", 8).alias("intercept"))


_TWO = f"""{PTS}, {ROLES}, m2 AS (SELECT fold, var_pop(x1) AS a, covar_pop(x1, x2) AS b, var_pop(x2) AS c, covar_pop(x1, y) AS e, covar_pop(x2, y) AS f,
  avg(x1) AS m1, avg(x2) AS mm, avg(y) AS my FROM pts JOIN roles USING (bucket) WHERE role = 'train' GROUP BY fold),
two AS (SELECT fold, (c * e - b * f) / (a * c - b * b) AS b1, (a * f - b * e) / (a * c - b * b) AS b2, my, m1, mm FROM m2)"""


@query("ols_two_features", f"""
WITH {_TWO} SELECT fold, round(b1, 9) AS b1, round(b2 * 1e5, 6) AS b2, round(my - b1 * m1 - b2 * mm, 8) AS intercept FROM two""")
def _two(spark: SparkSession, d: str) -> DataFrame:
    sums = fold_sums(points(spark, d), ["x1", "x2"], "y", "bucket", FOLDS)
    fits = linear.fits_table(spark, linear.fold_fits(sums), ["x1", "x2"], "ols")
    return fits.select("fold", F.round(F.col("coefs")[0], 9).alias("b1"), F.round(F.col("coefs")[1] * 1e5, 6).alias("b2"), F.round("intercept", 8).alias("intercept"))


@query("score_models", f"""
WITH {_TWO} SELECT fold, row_key, round(my + b1 * (x1 - m1) + b2 * (x2 - mm), 6) AS p FROM two JOIN roles r USING (fold) JOIN pts ON pts.bucket = r.bucket
WHERE r.role = 'test'""")
def _score_models(spark: SparkSession, d: str) -> DataFrame:
    df = points(spark, d).select("row_key", "bucket", "x1", "x2", "y")
    sums = fold_sums(df, ["x1", "x2"], "y", "bucket", FOLDS)
    stored = linear.fits_table(spark, linear.fold_fits(sums), ["x1", "x2"], "ols")
    test = df.withColumn("fold", F.col("bucket"))
    return score_models(test, stored, ["x1", "x2"], max_models=FOLDS).select("fold", "row_key", F.round("p", 6).alias("p"))


@query("missing_models", """
SELECT DISTINCT CAST(user_id % 7 AS INT) AS fold FROM events WHERE user_id % 7 >= 5""")
def _missing(spark: SparkSession, d: str) -> DataFrame:
    sums = fold_sums(points(spark, d), ["x1"], "y", "bucket", FOLDS)
    stored = linear.fits_table(spark, linear.fold_fits(sums), ["x1"], "ols")
    expected = table(spark, d, "events").select((F.col("user_id") % 7).cast("int").alias("fold")).distinct()
    return missing_models(expected, stored, ["fold"])


_WLS = f"""{PTS}, {ROLES}, tr AS (SELECT fold, x1, y FROM pts JOIN roles USING (bucket) WHERE role = 'train'),
o AS (SELECT fold, regr_slope(y, x1) AS b, regr_intercept(y, x1) AS a FROM tr GROUP BY fold),
r AS (SELECT fold, x1, y, y - a - b * x1 AS e, 1 / ((y - a - b * x1) ** 2 + 1e-6) AS w FROM tr JOIN o USING (fold)),
mu AS (SELECT fold, sum(w * x1) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM r GROUP BY fold),
wl AS (SELECT fold, sum(w * (x1 - mx) * (y - my)) / sum(w * (x1 - mx) ** 2) AS b FROM r JOIN mu USING (fold) GROUP BY fold)"""


@query("wls_two_stage", f"""
WITH {_WLS} SELECT 'ols_stat_models' AS model, fold, 'None yet: OLS' AS sample_weight, round(a, 7) AS intercept, round(b, 8) AS slope FROM o
UNION ALL SELECT 'wls_stat_models', fold, 'Manual: WLS', round(my - b * mx, 7), round(b, 8) FROM wl JOIN mu USING (fold)""")
def _wls(spark: SparkSession, d: str) -> DataFrame:
    df = points(spark, d)
    sums = fold_sums(df, ["x1"], "y", "bucket", FOLDS)
    out = linear.two_stage_report(df, ["x1"], "y", sums)
    return out.select("model", "fold", "sample_weight", F.round("intercept", 7).alias("intercept"), F.round(F.col("coefs")[0], 8).alias("slope"))


@query("wls_report")
def _wls_report(spark: SparkSession, d: str) -> DataFrame:
    df = points(spark, d, part=True)
    return linear.two_stage_report(df, FEATURES, "y", fold_sums(df, FEATURES, "y", "bucket", FOLDS))


@query("breusch_pagan", f"""
WITH {_WLS} SELECT fold, count(*) AS n, round(count(*) * corr(e * e, x1) ** 2, 4) AS lm FROM r GROUP BY fold""")
def _bp(spark: SparkSession, d: str) -> DataFrame:
    df = points(spark, d)
    sums = fold_sums(df, ["x1"], "y", "bucket", FOLDS)
    out = linear.breusch_pagan(df, ["x1"], "y", sums, linear.fold_fits(sums))
    return out.select("fold", "n", F.round("lm", 4).alias("lm"))


@query("bin_weighted_ols", f"""
WITH {PTS}, {ROLES}, {EDGES}, tr AS (SELECT fold, x1, y FROM pts JOIN roles USING (bucket) WHERE role = 'train'), {binned("tr", "b")},
c AS (SELECT fold, bin, count(*) AS n FROM b GROUP BY ALL),
w AS (SELECT fold, bin, (1 / (n + 1e-6)) / sum(1 / (n + 1e-6)) OVER (PARTITION BY fold) AS w FROM c),
h AS (SELECT fold, x1 * sqrt(w) AS x, y * sqrt(w) AS t FROM b JOIN w USING (fold, bin))
SELECT fold, round(covar_pop(t, x) / var_pop(x), 8) AS slope, round((avg(t) - covar_pop(t, x) / var_pop(x) * avg(x)) * 1e4, 6) AS intercept_e4 FROM h GROUP BY fold""")
def _bin_weighted(spark: SparkSession, d: str) -> DataFrame:
    sums = fold_sums(points(spark, d), ["x1"], "y", "bucket", FOLDS)
    fits = linear.fits_table(spark, [linear.bin_weighted_fit(sums, f, ["x1"]) for f in range(FOLDS)], ["x1"], "ols")
    return fits.select("fold", F.round(F.col("coefs")[0], 8).alias("slope"), F.round(F.col("intercept") * 1e4, 6).alias("intercept_e4"))


@query("ols_multi")
def _ols_multi(spark: SparkSession, d: str) -> DataFrame:
    df = points(spark, d, part=True)
    sums = fold_sums(df, FEATURES, "y", "bucket", FOLDS)
    return linear.score_fits(df, linear.fold_fits(sums), FEATURES, "y")


@query("linear_grid_cv")
def linear_grid_cv(spark: SparkSession, d: str) -> DataFrame:
    """Lasso, ridge and elastic-net grids with the table's own alphas, every fold."""
    spaces = shared_spaces(spark, d).filter("model != 'ols'")
    return search.linear_grid_search(points(spark, d), LINE_FEATURES, "y", linear_grid(spaces), k=FOLDS).drop("coefs")


@query("best_linear_params")
def _best_linear(spark: SparkSession, d: str) -> DataFrame:
    return best_params(linear_grid_cv(spark, d), ["model", "fold"], "param")


@query("refit_winners")
def refit_winners(spark: SparkSession, d: str) -> DataFrame:
    df = points(spark, d)
    sums = fold_sums(df, LINE_FEATURES, "y", "bucket", FOLDS)
    grid = linear_grid(shared_spaces(spark, d).filter("model IN ('lasso', 'ridge')"))
    stats = search.linear_grid_search(df, LINE_FEATURES, "y", grid, k=FOLDS, sums=sums)
    return search.refit_winners(stats, grid, sums).drop("coefs")


_SEARCH = f"""{PTS}, {ROLES}, {EDGES}, {MOMENTS},
tv AS (SELECT fold, var_pop(x1) AS v, covar_pop(y, x1) AS c, avg(x1) AS mx, avg(y) AS my FROM pts JOIN roles USING (bucket) WHERE role = 'train_val' GROUP BY fold),
a AS (SELECT CAST(row_number() OVER (ORDER BY alpha) - 1 AS INT) AS ai, alpha FROM (SELECT DISTINCT round(l_discount * 100) / 100 + 0e0 AS alpha FROM lineitem)
  UNION ALL SELECT -1, 1e-4),
fits AS (SELECT fold, model, ai, CASE model WHEN 'ridge' THEN c / (v + alpha) ELSE sign(c) * greatest(abs(c) - alpha, 0) / v END AS b
  FROM mom, a, (VALUES ('lasso'), ('ridge')) t(model)),
scored AS (SELECT f.model, f.ai, r.fold, y, my + b * (x1 - mx) AS p FROM pts JOIN roles r USING (bucket) JOIN fits f ON f.fold = r.fold
  JOIN mom m ON m.fold = r.fold WHERE r.role = 'val'), {binned("scored", "bb")}, {metrics_sql("bb", "model, ai, fold")},
ranked AS (SELECT *, row_number() OVER (PARTITION BY model, fold ORDER BY weighted_r2 DESC, weighted_mse, ai) AS rn FROM m),
best AS (SELECT model, fold, ai, model || '_hp_' || (ai + 1) AS param_key FROM ranked WHERE rn = 1)"""


def _search_one(spark: SparkSession, d: str):
    """Lasso and ridge grids with the table's discounts as penalties, on one feature."""
    sums = fold_sums(points(spark, d), ["x1"], "y", "bucket", FOLDS)
    grid = linear_grid(shared_spaces(spark, d).filter("model IN ('lasso', 'ridge')"))
    return sums, grid, search.linear_grid_search(None, ["x1"], "y", grid, "IdentityScaler", k=FOLDS, sums=sums)


@query("best_params_one_feature", f"""
WITH {_SEARCH} SELECT model, fold, param_key, CASE WHEN ai < 0 THEN 'single best answer by r2/mse' ELSE '2+ best params, without default' END AS reason,
  CAST(CASE WHEN ai < 0 THEN 1 ELSE 54 END AS BIGINT) AS tie_count FROM best""")
def _best_one(spark: SparkSession, d: str) -> DataFrame:
    # The 54 step sizes, batches and schedules of a penalty share its fit, hence the ties.
    _, _, stats = _search_one(spark, d)
    return best_params(stats, ["model", "fold"], "param")


@query("refit_one_feature", f"""
WITH {_SEARCH}, again AS (SELECT best.model, best.fold, param_key, CASE best.model WHEN 'ridge' THEN c / (v + alpha) ELSE sign(c) * greatest(abs(c) - alpha, 0) / v END AS b, mx, my
  FROM best JOIN a USING (ai) JOIN tv ON tv.fold = best.fold),
tested AS (SELECT g.model, g.fold, y, my + b * (x1 - mx) AS p FROM pts JOIN roles r USING (bucket) JOIN again g ON g.fold = r.fold WHERE r.role = 'test'),
{binned("tested", "tb")}, {metrics_sql("tb", "model, fold", "t_")}
SELECT t.model, t.fold, param_key AS param, round(t.weighted_mse, 7) AS weighted_test_mse, round(t.weighted_r2, 7) AS weighted_test_r2, round(t.mse, 7) AS test_mse,
  round(t.r2, 7) AS test_r2, round(b, 9) AS slope FROM t_m t JOIN again g ON g.model = t.model AND g.fold = t.fold""")
def _refit_one(spark: SparkSession, d: str) -> DataFrame:
    sums, grid, stats = _search_one(spark, d)
    out = search.refit_winners(stats, grid, sums, "IdentityScaler")
    cols = ["weighted_test_mse", "weighted_test_r2", "test_mse", "test_r2"]
    return out.select("model", "fold", "param", *[F.round(c, 7).alias(c) for c in cols], F.round(F.col("coefs")[0], 9).alias("slope"))


@query("alpha_ranking")
def _alpha_ranking(spark: SparkSession, d: str) -> DataFrame:
    return rank_alphas(search.alpha_sweep(points(spark, d), LINE_FEATURES, "y", ["lasso", "ridge", "elasticnet"], k=FOLDS), ["model"], top=22)


def _assembled(spark: SparkSession, d: str, tree: bool = True) -> DataFrame:
    return assembled(points(spark, d, heavy=True), [*LINE_FEATURES, "annotation_score", "protein_existence"], "y", tree=tree)


@query("forest_cv")
def forest_cv(spark: SparkSession, d: str) -> DataFrame:
    grid = [
        {"param_key": f"random_forest_hp_{i}", "n_bins": 32, "min_samples_leaf": 50, "n_estimators": 5, "max_depth": depth, "max_samples": 0.6, "max_features": "sqrt"}
        for i, depth in enumerate((4, 6))
    ]
    return search.forest_search(_assembled(spark, d), grid, FOLDS)


@query("gradient_linear_cv")
def _gradient(spark: SparkSession, d: str) -> DataFrame:
    grid = [{"param_key": "lasso_hp_0", "alpha": 0.0001, "epochs": 1000, "tol": 0.001}]
    return search.gradient_search(_assembled(spark, d, tree=False), "lasso", grid, FOLDS)


# Rounds, depth and step of the registered search; the other ten ranges are those of the wide search.
TRIALS = 4
BOOSTED_SPACE = [{"n_estimators": ("n_estimators", 10.0, 40.0, False, True), "max_depth": ("max_depth", 2.0, 5.0, False, True),
                  "learning_rate": ("learning_rate", 0.05, 1.0, True, False)}.get(r[0], r) for r in K.BOOSTED_SPACE]
TREE_FEATURES = [*LINE_FEATURES, "annotation_score", "protein_existence"]


def _boosted(spark: SparkSession, d: str) -> tuple:
    df = points(spark, d, heavy=True).select("bucket", "y", *TREE_FEATURES)
    return df, search.trial_search(df, TREE_FEATURES, "y", TRIALS, k=FOLDS, space=BOOSTED_SPACE)


def _naive_r2(role: str, other: str) -> str:
    """SQL: R2 on ``other`` rows of predicting the mean label of the ``role`` rows of the fold."""
    return f"""naive AS (SELECT fold, avg(y) AS m FROM pts JOIN roles USING (bucket) WHERE role = '{role}' GROUP BY fold),
bound AS (SELECT fold, 1 - sum((y - m) * (y - m)) / (var_pop(y) * count(*)) AS r2 FROM pts JOIN roles USING (bucket) JOIN naive USING (fold)
  WHERE role = '{other}' GROUP BY fold)"""


def _naive_bound(df: DataFrame, role: str, other: str) -> DataFrame:
    """(fold, bound): the same by Spark."""
    rows = assign_roles(df.select("bucket", "y"), "bucket", FOLDS, [role, other])
    naive = rows.filter(F.col("role") == role).groupBy("fold").agg(F.avg("y").alias("_m"))
    off = F.col("y") - F.col("_m")
    held = join_small(rows.filter(F.col("role") == other), naive, ["fold"], "inner", FOLDS)
    return held.groupBy("fold").agg((1 - F.sum(off * off) / (F.var_pop("y") * F.count("*"))).alias("bound"))


@query("boosted_cv", f"""WITH {PTS}, {ROLES}, {_naive_r2("train", "val")}
SELECT fold, round(r2, 6) + 0e0 AS bound, CAST({TRIALS} AS BIGINT) AS trials, CAST(0 AS BIGINT) AS failed, TRUE AS trees_do_better FROM bound""")
def boosted_cv(spark: SparkSession, d: str) -> DataFrame:
    """Several drawn trials per fold: does the best one beat the naive mean on the validation rows, and does none fail?"""
    df, (table, _, _) = _boosted(spark, d)
    best = table.groupBy("fold").agg(F.max("val_r2").alias("_best"), F.count("*").alias("trials"), F.count("failed").alias("failed"))
    return join_small(best, _naive_bound(df, "train", "val"), ["fold"], "inner", FOLDS).select(
        "fold", (F.round("bound", 6) + 0.0).alias("bound"), "trials", "failed", (F.col("_best") > F.col("bound")).alias("trees_do_better"))


@query("boosted_trials")
def _boosted_trials(spark: SparkSession, d: str) -> DataFrame:
    return _boosted(spark, d)[1][0]


@query("refit_boosted", f"""WITH {PTS}, {ROLES}, {_naive_r2("train_val", "test")}
SELECT fold, round(r2, 6) + 0e0 AS bound, TRUE AS trees_do_better FROM bound""")
def _refit_boosted(spark: SparkSession, d: str) -> DataFrame:
    """The best trial of each fold, grown again on train plus validation rows, on the test rows."""
    df, (table, machines, edges) = _boosted(spark, d)
    tested, _, _ = search.refit_boosters(df, TREE_FEATURES, "y", table, machines, k=FOLDS, edges=edges)
    return join_small(tested, _naive_bound(df, "train_val", "test"), ["fold"], "inner", FOLDS).select(
        "fold", (F.round("bound", 6) + 0.0).alias("bound"), (F.col("test_r2") > F.col("bound")).alias("trees_do_better"))


SVR_GRID = [{"param_key": f"svr_hp_{i}", "C": c, "epsilon": e} for i, (c, e) in enumerate([(c, e) for c in (0.001, 0.1, 1.0) for e in (0.01, 0.1)], 1)]
RBF_GRID = [{"param_key": f"svr_hp_{i}", "kernel": "rbf", "gamma": g, "C": 1.0, "epsilon": 0.01} for i, g in enumerate(("scale", 0.05), 1)]


@query("svr_linear")
def svr_linear(spark: SparkSession, d: str) -> DataFrame:
    return search.svr_search(points(spark, d, heavy=True), LINE_FEATURES, "y", SVR_GRID, k=FOLDS)


@query("svr_rbf")
def _svr_rbf(spark: SparkSession, d: str) -> DataFrame:
    return search.svr_search(points(spark, d, heavy=True), LINE_FEATURES, "y", RBF_GRID, k=FOLDS)


@query("svr_against_line", f"""WITH {PTS}, {ROLES}, {MOMENTS}, r AS (SELECT r.fold, 1 - sum((y - my - c / v * (x1 - mx)) ** 2) / (var_pop(y) * count(*)) AS r2
  FROM pts JOIN roles r USING (bucket) JOIN mom m ON m.fold = r.fold WHERE r.role = 'val' GROUP BY r.fold)
SELECT fold, CAST({len(SVR_GRID)} AS BIGINT) AS machines, CAST({len(SVR_GRID)} AS BIGINT) AS converged, TRUE AS better_than_one_feature FROM r WHERE r2 < 1""")
def _svr_against_line(spark: SparkSession, d: str) -> DataFrame:
    """Does every machine reach its tolerance, and the best one of each fold do better on the validation rows than least squares on one feature?"""
    stats = svr_linear(spark, d)
    best = stats.groupBy("fold").agg(F.count("*").alias("machines"), F.count_if(~F.isnan("val_r2")).alias("converged"), F.max(F.nanvl("val_r2", F.lit(-1.0))).alias("_best"))
    roled = assign_roles(points(spark, d).select("bucket", "x1", "y"), "bucket", FOLDS, ["train", "val"])
    line = roled.filter("role = 'train'").groupBy("fold").agg(F.regr_slope("y", "x1").alias("_b"), F.regr_intercept("y", "x1").alias("_a"))
    off = F.col("y") - F.col("_a") - F.col("_b") * F.col("x1")
    one = join_small(roled.filter("role = 'val'"), line, ["fold"], "inner", FOLDS).groupBy("fold").agg((1 - F.sum(off * off) / (F.var_pop("y") * F.count("*"))).alias("r2"))
    return join_small(best, one, ["fold"], "inner", FOLDS).select("fold", "machines", "converged", (F.col("_best") > F.col("r2")).alias("better_than_one_feature"))
