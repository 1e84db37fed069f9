from itertools import product

import pytest
from pyspark.sql import functions as F

from foldwise import constants as K
from foldwise.operators import grid

FOREST = '{"n_bins": [128, 256], "min_samples_leaf": [50, 500, 1000], "min_samples_split": [50, 500, 1000], "n_estimators": [50, 500, 1000], "max_depth": [8, 16], "max_samples": [0.6, 0.75, 1.0], "max_features": ["sqrt", "log2", 0.75], "min_impurity_decrease": [0.0, 0.0001, 0.001]}'
SUPPORT = '{"C": [0.001, 0.01, 0.1, 1, 10, 100, 1000], "epsilon": [0.0001, 0.001, 0.01, 0.1, 0.5, 1.0], "gamma": ["scale", "auto", 0.001, 0.01, 0.1, 1.0], "kernel": ["rbf"], "tol": [0.001, 0.01], "max_iter": [5000], "verbose": [6]}'


def test_linear_grid_sizes_and_order(spark):
    alphas = [10.0**-i for i in range(22)]
    spaces = spark.createDataFrame(
        [("mb_SGD", alphas), ("lasso", alphas), ("ridge", alphas), ("elasticnet", alphas[:7]), ("ols", alphas)], "model string, alphas array<double>"
    )
    g = grid.linear_grid(spaces).persist()
    sizes = {r["model"]: r["count"] for r in g.groupBy("model").count().collect()}
    assert sizes == {"mb_SGD": 55, "lasso": 1189, "ridge": 1189, "elasticnet": 1135}
    lists = [K.LINEAR_LISTS[n] for n in ("eta0", "batch_size", "tol", "epochs", "learning_rate", "n_iter_no_change")]
    want = list(product(*lists, alphas[:7], K.ELASTIC_L1_RATIOS))
    got = g.filter("model = 'elasticnet' AND number > 0").orderBy("number").select(*grid.LINEAR_COLUMNS[:6], "alpha", "l1_ratio").collect()
    assert [tuple(r) for r in got] == want
    default = g.filter("param_key = 'elasticnet_hp_0'").first()
    assert (default["alpha"], default["l1_ratio"], default["eta0"]) == (0.0001, 0.15, 0.001)


@pytest.mark.parametrize("model, space, size", [("random_forest", FOREST, 2916), ("svr", SUPPORT, 504)])
def test_json_grid_and_random_search(spark, model, space, size):
    spaces = spark.createDataFrame([(model, space)], "model string, space string")
    g = grid.json_grid(spaces)
    assert g.count() == size and g.select(F.to_json("params")).distinct().count() == size
    defaults = spark.createDataFrame([(model, f"{model}_hp_0")], "model string, param_key string")
    full = grid.with_default(g, defaults)
    picked = grid.random_search(full, ["model"], K.RANDOM_SHARE[model], 1)
    assert picked.count() == int((size + 1) * K.RANDOM_SHARE[model]) == {"random_forest": 291, "svr": 99}[model]
    assert picked.select("param_key").distinct().count() == picked.count()
    other = grid.random_search(full, ["model"], K.RANDOM_SHARE[model], 2)
    assert {r["param_key"] for r in other.collect()} != {r["param_key"] for r in picked.collect()}


def test_json_grid_order(spark):
    spaces = spark.createDataFrame([("m", '{"b": ["x", "y"], "a": [1, 2, 3]}'), ("n", '{"a": [], "b": [1]}')], "model string, space string")
    got = [(r["param_key"], r["params"]["a"], r["params"]["b"]) for r in grid.json_grid(spaces).orderBy("number").collect()]
    assert got == [(f"m_hp_{i + 1}", a, b) for i, (a, b) in enumerate(product("123", "xy"))]


def test_log_spaced_values(spark):
    r = spark.range(1).select(grid.alpha_sweep_values(-5, 2, 100).alias("v")).first()["v"]
    assert len(r) == 100 and r[0] == pytest.approx(1e-5) and r[-1] == pytest.approx(100.0)
    assert r[1] / r[0] == pytest.approx(10 ** (7 / 99))


def test_drawn_space_stays_in_range(spark):
    trials = spark.range(400).withColumnRenamed("id", "trial")
    drawn = grid.draw_space(trials, ["trial"], 7)
    for name, low, high, log, integer in K.BOOSTED_SPACE:
        r = drawn.agg(F.min(name), F.max(name), F.percentile_approx(name, 0.5)).first()
        assert low <= r[0] and r[1] <= high
        middle = (low * high) ** 0.5 if log else (low + high) / 2
        assert r[2] == pytest.approx(middle, rel=1.0 if log else 0.2)
    assert grid.draw_space(trials, ["trial"], 7).exceptAll(drawn).count() == 0


def test_network_space_sizes(spark):
    for layers, optimizers, size in ((9, 3, 135), (6, 3, 90), (14, 4, 280), (9, 1, 45)):
        cfg = spark.createDataFrame([(n, f"o{j}") for n in range(1, layers + 1) for j in range(optimizers)], "layers int, optimizer string")
        assert grid.network_space(cfg, list(range(5)), F.array(F.lit(8))).count() == size


def test_fold_grid(spark):
    g = spark.createDataFrame([("m", "m_hp_1")], "model string, param_key string")
    assert [r["fold"] for r in grid.fold_grid(g, [0, 1, 2]).orderBy("fold").collect()] == [0, 1, 2]
