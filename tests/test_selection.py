from foldwise import constants as K
from foldwise.operators import selection
from foldwise.operators.grid import seed_grid

NAN = float("nan")
SCHEMA = "model string, fold int, param_key string, weighted_val_mse double, weighted_val_r2 double, val_mse double, val_r2 double"


def pick(spark, rows):
    df = spark.createDataFrame([("lasso", 0, k, *v) for k, v in rows], SCHEMA)
    r = selection.best_params(df, ["model", "fold"]).first()
    return r["param_key"], r["reason"], r["tie_count"]


def test_tie_rules(spark):
    same = (0.1, 0.9, 0.1, 0.9)
    worse = (0.2, 0.8, 0.2, 0.8)
    assert pick(spark, [("lasso_hp_3", same), ("lasso_hp_0", same), ("lasso_hp_1", worse)]) == ("lasso_hp_0", K.REASON_TIE_DEFAULT, 2)
    assert pick(spark, [("lasso_hp_10", same), ("lasso_hp_9", same)]) == ("lasso_hp_9", K.REASON_TIE_FIRST, 2)
    assert pick(spark, [("lasso_hp_1", same), ("lasso_hp_0", worse)]) == ("lasso_hp_1", K.REASON_SINGLE, 1)
    # Equal in the two ordering metrics only: not a tie.
    assert pick(spark, [("lasso_hp_1", same), ("lasso_hp_2", (0.1, 0.9, 0.3, 0.9))]) == ("lasso_hp_1", K.REASON_SINGLE, 1)


def test_nan_never_wins(spark):
    failed = (NAN,) * 4
    assert pick(spark, [("lasso_hp_0", failed), ("lasso_hp_1", (0.2, -5.0, 0.2, -5.0))]) == ("lasso_hp_1", K.REASON_SINGLE, 1)
    assert pick(spark, [("lasso_hp_0", failed), ("lasso_hp_1", failed)]) == (None, K.REASON_NONE, 0)


def test_best_per_fold_skips_nan(spark):
    df = spark.createDataFrame([(0, "a", NAN), (0, "b", 0.1), (0, "c", 0.5), (1, "a", NAN)], "fold int, m string, r2 double")
    got = {r["fold"]: r["m"] for r in selection.best_per_fold(df, ["fold"], "r2", ["m"]).collect()}
    assert got == {0: "c", 1: "a"}


def test_best_scaler_order(spark):
    df = spark.createDataFrame(
        [("ols", "A", 0.9, 0.2), ("ols", "B", 0.9, 0.1), ("ols", "C", NAN, NAN)], "model string, scaler string, validation_r2 double, validation_mse double"
    )
    assert selection.best_scaler(df, ["model"]).first()["scaler"] == "B"


def test_seed_grid(spark):
    grid = spark.createDataFrame([("m", f"m_hp_{i}", f, i * 1.0) for i in range(3) for f in range(2)], "model string, param_key string, fold int, alpha double")
    best = spark.createDataFrame([("m", 0, 7.0), ("m", 1, 8.0)], "model string, fold int, alpha double")
    got = sorted((r["fold"], r["param_key"], r["alpha"]) for r in seed_grid(grid, best).collect())
    assert got == [(0, "m_hp_1", 1.0), (0, "m_hp_2", 2.0), (0, "m_hp__1", 7.0), (1, "m_hp_1", 1.0), (1, "m_hp_2", 2.0), (1, "m_hp__1", 8.0)]


def test_rank_and_summary(spark):
    df = spark.createDataFrame(
        [("l", 0.1, 0, 0.5, 0.1), ("l", 0.1, 1, NAN, NAN), ("l", 0.2, 0, 0.6, 0.1), ("l", 0.2, 1, 0.6, 0.1)],
        "model string, alpha double, fold int, weighted_val_r2 double, weighted_val_mse double",
    )
    assert [r["alpha"] for r in selection.rank_alphas(df, ["model"], top=1).collect()] == [0.2]
    assert selection.summarise_models(df, ["model"], ["weighted_val_r2"]).first()["n_folds"] == 4
