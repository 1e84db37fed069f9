"""Hyper-parameter grids over search spaces derived from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.functions.scalar import logspace
from foldwise.operators import grid
from foldwise.operators.folds import fold_bucket
from foldwise.operators.selection import best_params
from foldwise.plans.catalog.registry import query
from foldwise.plans.fixtures import FOLDS, STATS, run_stats, table

MODELS = ["mb_SGD", "lasso", "ridge", "elasticnet", "ols"]


def _alpha_spaces(spark: SparkSession, d: str) -> DataFrame:
    """One space per (order line number, model): the distinct discounts of those lines are its alphas."""
    # At most eleven different discounts exist, so the lists are bounded.
    lists = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("space")).agg(
        F.array_sort(F.collect_set((F.round(F.col("l_discount") * 100) / 100) + 0.0)).alias("alphas")
    )
    return lists.select("space", F.explode(F.array(*[F.lit(m) for m in MODELS])).alias("model"), "alphas")


def shared_spaces(spark: SparkSession, d: str) -> DataFrame:
    """One space per model: the distinct discounts of the whole table are its alphas."""
    lists = table(spark, d, "lineitem").agg(F.array_sort(F.collect_set((F.round(F.col("l_discount") * 100) / 100) + 0.0)).alias("alphas"))
    return lists.select(F.explode(F.array(*[F.lit(m) for m in MODELS])).alias("model"), "alphas")


def _values(name: str, rows: str) -> str:
    return f"{name} AS (SELECT * FROM (VALUES {rows}))"


_LINEAR = f"""
a AS (SELECT l_linenumber AS space, alpha, row_number() OVER (PARTITION BY l_linenumber ORDER BY alpha) - 1 AS ai, count(*) OVER (PARTITION BY l_linenumber) AS na
  FROM (SELECT DISTINCT l_linenumber, round(l_discount * 100) / 100 + 0e0 AS alpha FROM lineitem)),
{_values("e", "(1e-5, 0), (1e-4, 1), (1e-3, 2)")} , {_values("bs", "(32, 0), (128, 1), (256, 2)")}, {_values("tl", "(1e-4, 0), (1e-3, 1), (1e-2, 2)")},
{_values("lr", "('adaptive', 0), ('constant', 1)")}, {_values("ra", "(1e-1, 0), (5e-1, 1), (9e-1, 2)")},
base AS (SELECT e.col0 AS eta0, bs.col0 AS batch_size, tl.col0 AS tol, lr.col0 AS learning_rate,
  ((e.col1 * 3 + bs.col1) * 3 + tl.col1) * 2 + lr.col1 AS b FROM e, bs, tl, lr),
g AS (
  SELECT space, 'mb_SGD' AS model, base.*, 0e0 AS alpha, NULL::DOUBLE AS l1_ratio, b + 1 AS number FROM (SELECT DISTINCT space FROM a), base
  UNION ALL SELECT space, m, base.*, alpha, NULL, b * na + ai + 1 FROM a, base, (VALUES ('lasso'), ('ridge')) t(m)
  UNION ALL SELECT space, 'elasticnet', base.*, alpha, ra.col0, (b * na + ai) * 3 + ra.col1 + 1 FROM a, base, ra
  UNION ALL SELECT space, m, 1e-3, 32, 1e-3, 'constant', 0, al, 0.15::DOUBLE, 0 FROM (SELECT DISTINCT space FROM a),
    (VALUES ('mb_SGD', 0e0), ('lasso', 1e-4), ('ridge', 1e-4), ('elasticnet', 1e-4)) t(m, al)),
grid AS (SELECT space, model, model || '_hp_' || number AS param_key, CAST(number AS INT) AS number, eta0, batch_size, tol, 1000 AS epochs, learning_rate,
  5 AS n_iter_no_change, alpha, l1_ratio FROM g)"""


@query("grid_linear", f"WITH {_LINEAR} SELECT * FROM grid")
def grid_linear(spark: SparkSession, d: str) -> DataFrame:
    return grid.linear_grid(_alpha_spaces(spark, d))


@query("grid_sizes", f"WITH {_LINEAR} SELECT space, model, count(*) AS n FROM grid GROUP BY ALL")
def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return grid.linear_grid(_alpha_spaces(spark, d)).groupBy("space", "model").agg(F.count("*").alias("n"))


def _json_spaces(spark: SparkSession, d: str) -> DataFrame:
    """One JSON search space per part brand from the brand's own types and sizes (both small domains)."""
    sizes = F.transform(F.array_sort(F.collect_set("p_size")), lambda x: x.cast("string"))
    types = F.array_sort(F.collect_set("p_type"))
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("model")).agg(
        F.to_json(F.create_map(F.lit("max_depth"), sizes, F.lit("kernel"), types, F.lit("C"), F.array(F.lit("1"), F.lit("10")))).alias("space")
    )


_JSON = """
t AS (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY p_type) - 1 AS ti, count(*) OVER (PARTITION BY p_brand) AS nt FROM (SELECT DISTINCT p_brand, p_type FROM part)),
s AS (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size) - 1 AS si, count(*) OVER (PARTITION BY p_brand) AS ns FROM (SELECT DISTINCT p_brand, p_size FROM part)),
grid AS (SELECT t.p_brand AS model, c AS "C", p_type AS kernel, CAST(p_size AS VARCHAR) AS max_depth, (ci * nt + ti) * ns + si + 1 AS number
  FROM t JOIN s USING (p_brand), (VALUES ('1', 0), ('10', 1)) v(c, ci)),
keyed AS (SELECT *, model || '_hp_' || number AS param_key FROM grid)"""


def _json_grid(spark: SparkSession, d: str) -> DataFrame:
    return grid.json_grid(_json_spaces(spark, d))


def _params(df: DataFrame) -> list[Column]:
    return [F.col("params")[n].alias(n) for n in ("C", "kernel", "max_depth")]


@query("grid_json", f'WITH {_JSON} SELECT model, param_key, "C", kernel, max_depth FROM keyed')
def _grid_json(spark: SparkSession, d: str) -> DataFrame:
    g = _json_grid(spark, d)
    return g.select("model", "param_key", *_params(g))


_RANDOM = f"""{_JSON}, rnd AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY md5('42|' || param_key), param_key) AS r,
  count(*) OVER (PARTITION BY model) AS n FROM keyed), pick AS (SELECT * FROM rnd WHERE r <= floor(n * 0.198::DOUBLE))"""


@query("grid_random", f'WITH {_RANDOM} SELECT model, param_key, "C", kernel, max_depth FROM pick')
def _grid_random(spark: SparkSession, d: str) -> DataFrame:
    g = grid.random_search(_json_grid(spark, d), ["model"], 0.198, 42)
    return g.select("model", "param_key", *_params(g))


@query("fold_grid", f"WITH {_JSON} SELECT model, param_key, CAST(f AS INT) AS fold FROM keyed, range(5) t(f)")
def _fold_grid(spark: SparkSession, d: str) -> DataFrame:
    return grid.fold_grid(_json_grid(spark, d).select("model", "param_key"), list(range(FOLDS)))


@query("grid_seeded", f"""
WITH {STATS}, k AS (SELECT DISTINCT model, param_key, i FROM stats),
b AS (SELECT model, fold, arg_max(i, (weighted_val_r2, -i)) AS i FROM stats WHERE NOT isnan(weighted_val_r2) GROUP BY ALL),
tied AS (SELECT s.model, s.fold, s.i FROM stats s JOIN stats t ON s.model = t.model AND s.fold = t.fold JOIN b ON b.model = s.model AND b.fold = s.fold AND b.i = t.i
  WHERE s.weighted_val_r2 = t.weighted_val_r2 AND s.val_r2 = t.val_r2),
best AS (SELECT model, fold, min(i) AS i FROM tied GROUP BY ALL)
SELECT model, param_key, CAST(f AS INT) AS fold, i * 1e-2 AS alpha FROM k, range(5) t(f) WHERE i <> 0
UNION ALL SELECT model, model || '_hp__1', fold, i * 1e-2 FROM best""")
def _seeded(spark: SparkSession, d: str) -> DataFrame:
    s = run_stats(spark, d)
    keys = s.select("model", "param_key", (F.col("i") * 0.01).alias("alpha")).distinct()
    best = grid.resolve_params(best_params(s, ["model", "fold"]).select("model", "fold", "param_key"), keys)
    return grid.seed_grid(grid.fold_grid(keys, list(range(FOLDS))), best.drop("param_key"))


@query("logspace", """
WITH p AS (SELECT p_partkey, p_size AS n FROM part)
SELECT p_partkey, CAST(i AS INT) AS position, round(10e0 ** (-5 + i * (CASE WHEN n > 1 THEN 5e0 / (n - 1) ELSE 0 END)), 12) AS alpha
FROM p, LATERAL (SELECT unnest(range(n)) AS i)""")
def _logspace(spark: SparkSession, d: str) -> DataFrame:
    values = logspace(F.lit(-5), F.lit(0), F.col("p_size"))
    return table(spark, d, "part").select("p_partkey", F.posexplode(values).alias("position", "alpha")).withColumn("alpha", F.round("alpha", 12))


def _draw_sql(name: str) -> str:
    return f"CAST(('0x' || substr(md5('42|{name}|' || fold || '|' || trial), 1, 13)) AS BIGINT) / 4503599627370496e0"


@query("search_space_draws", f"""
WITH t AS (SELECT DISTINCT CAST(user_id % 5 AS INT) AS fold, user_id AS trial FROM events)
SELECT fold, trial, CAST(floor({_draw_sql("max_depth")} * 30 + 1) AS INT) AS max_depth,
  round(1e-5 * (1e0 / 1e-5) ** ({_draw_sql("learning_rate")}), 10) AS learning_rate, round({_draw_sql("subsample")} * 9e-1 + 1e-1, 10) AS subsample,
  CAST(floor({_draw_sql("n_estimators")} * 4951 + 50) AS INT) AS n_estimators FROM t""")
def _draws(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events").select(fold_bucket(F.col("user_id"), FOLDS).alias("fold"), F.col("user_id").alias("trial")).distinct()
    return grid.draw_space(t, ["fold", "trial"], 42).select(
        "fold", "trial", "max_depth", F.round("learning_rate", 10).alias("learning_rate"), F.round("subsample", 10).alias("subsample"), "n_estimators"
    )
