"""The stages end to end on small stored fold tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.operators.folds import assign_roles
from foldwise.operators.linear import fold_fits
from foldwise.operators.moments import fold_sums, split_sums
from foldwise.plans import jobs

FEATURES = ["a", "b", "Depth"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    n = 1000
    a, b = rng.uniform(size=n), rng.normal(size=n)
    y = np.clip(a**3 + 0.02 * b, 0, 1)
    return spark.createDataFrame(
        [(f"p{i}", int(i % 5), float(u), float(v), int(i % 3), bool(i % 2), float(t)) for i, (u, v, t) in enumerate(zip(a, b, y))],
        "Name string, bucket int, a double, b double, Depth int, Predicted_Ontology_F boolean, LinScore double",
    ).persist()


@pytest.fixture(scope="module")
def stored(spark, rows, tmp_path_factory):
    root = tmp_path_factory.mktemp("folds")
    roled = assign_roles(rows)
    spec = {}
    for role in ("train", "val", "train_val", "test"):
        paths = []
        for f in range(5):
            paths.append(f"{root}/in/{role}{f}")
            roled.filter((F.col("fold") == f) & (F.col("role") == role)).drop("fold", "role", "bucket").write.parquet(paths[-1])
        spec[role] = ",".join(paths)
    jobs.prepare(spark, spec, f"{root}/folds", ["Name"])
    return str(root)


def read(spark, path):
    return spark.read.parquet(path)


def test_prepare(spark, stored):
    t = read(spark, f"{stored}/folds")
    n = {(r["variant"], r["split"]): r["count"] for r in t.groupBy("variant", "split").count().collect()}
    assert n[("A", "train")] == 3000 and n[("A", "test")] == n[("B", "test")] == n[("A", "val")] == 1000
    assert n[("B", "train")] < n[("A", "train")]
    for r in t.filter("variant = 'B' AND split = 'train'").groupBy("fold").agg(
            F.count_if(F.col("LinScore") < 0.1).alias("low"), F.count_if(F.col("LinScore") > 0.9).alias("high")).collect():
        assert r["low"] == r["high"]


def test_split_sums_equal_bucket_sums(spark, rows, stored):
    by_bucket = fold_sums(rows, ["a", "b"], "LinScore")
    by_split = split_sums(jobs.read_folds(spark, f"{stored}/folds", "A", ["train", "val", "train_val", "test"]), ["a", "b"], "LinScore", role="role")
    for x, y in zip(fold_fits(by_bucket), fold_fits(by_split)):
        assert x.coefs == pytest.approx(y.coefs) and x.intercept == pytest.approx(y.intercept)


def test_naive_and_weights(spark, stored):
    out = jobs.naive_job(spark, f"{stored}/folds", f"{stored}/naive")
    assert out.count() == 2 * 5 * 2
    jobs.weights_job(spark, f"{stored}/folds", f"{stored}/weights", "A")
    per_bin = read(spark, f"{stored}/weights").groupBy("split", "fold", "bin").agg(F.max("weight").alias("w"))
    assert all(r["s"] == pytest.approx(1) for r in per_bin.groupBy("split", "fold").agg(F.sum("w").alias("s")).collect())


def test_linear_and_least_squares(spark, stored):
    spaces = spark.createDataFrame([("lasso", [0.0001, 0.01]), ("elasticnet", [0.001])], "model string, alphas array<double>")
    jobs.linear_job(spark, f"{stored}/folds", f"{stored}/linear", "A", FEATURES, spaces)
    assert read(spark, f"{stored}/linear/stats").count() == (54 * 2 + 1 + 54 * 3 + 1) * 5
    assert read(spark, f"{stored}/linear/best_params").count() == 10
    tested = read(spark, f"{stored}/linear/test_stats")
    assert tested.count() == 10 and tested.agg(F.min("test_r2")).first()[0] > 0.7
    jobs.least_squares_job(spark, f"{stored}/folds", f"{stored}/ols", "B", FEATURES)
    assert read(spark, f"{stored}/ols/test_stats").count() == 5


def test_forest(spark, stored):
    grid = jobs.json_space(spark, "random_forest", '{"n_estimators": [3], "max_depth": [3, 5], "n_bins": [16], "min_samples_leaf": [5]}')
    assert {g["param_key"] for g in grid} == {"random_forest_hp_0", "random_forest_hp_1", "random_forest_hp_2"}
    grid = [g for g in grid if g["param_key"] != "random_forest_hp_0"]
    jobs.forest_job(spark, f"{stored}/folds", f"{stored}/forest", "A", FEATURES, grid)
    assert read(spark, f"{stored}/forest/stats").count() == 10
    tested = read(spark, f"{stored}/forest/test_stats")
    assert tested.count() == 5 and tested.agg(F.min("test_r2")).first()[0] > 0.7


def test_support_vectors(spark, stored):
    grid = jobs.json_space(spark, "svr", '{"C": [1, 0.0001], "epsilon": [0.01], "kernel": ["rbf"], "gamma": ["scale"]}')
    jobs.svr_job(spark, f"{stored}/folds", f"{stored}/svr", "A", ["a", "b"], [g for g in grid if "C" in g], size=32)
    assert read(spark, f"{stored}/svr/stats").count() == 10
    tested = read(spark, f"{stored}/svr/test_stats")
    assert tested.count() == 5 and tested.agg(F.min("test_r2")).first()[0] > 0.9
    assert read(spark, f"{stored}/svr/models").filter("size(weights) = 33").count() == 5


def test_boosted(spark, stored):
    space = [("learning_rate", 0.3, 0.9, True, False), ("n_estimators", 5.0, 9.0, False, True), ("max_depth", 3.0, 4.0, False, True)]
    jobs.boosted_job(spark, f"{stored}/folds", f"{stored}/boosted", "A", FEATURES, 2, space=space)
    trials = read(spark, f"{stored}/boosted/trials")
    assert trials.count() == 10 and trials.filter("failed IS NOT NULL").count() == 0
    best = {r["fold"]: r for r in read(spark, f"{stored}/boosted/best_trials").collect()}
    tested = {r["fold"]: r for r in read(spark, f"{stored}/boosted/test_stats").collect()}
    assert set(tested) == set(best) == set(range(5)) and all(tested[f]["param_key"] == best[f]["param_key"] and tested[f]["test_r2"] > 0.7 for f in best)
    kept = {r["fold"]: r["n"] for r in read(spark, f"{stored}/boosted/models").groupBy("fold").agg(F.countDistinct("tree").alias("n")).collect()}
    assert kept == {f: best[f]["trees"] for f in best}


def test_network(spark, rows, stored):
    preds = rows.select(F.col("bucket").alias("fold"), (F.col("Depth") + 1).alias("layers"), F.lit("Adam").alias("optimizer"),
                        F.col("LinScore").alias("y"), (F.col("a") ** 3).alias("pred"))
    preds.write.parquet(f"{stored}/preds")
    jobs.network_job(spark, f"{stored}/preds", f"{stored}/network")
    assert read(spark, f"{stored}/network/results").count() == 15
    assert read(spark, f"{stored}/network/winners").count() == 5
    assert read(spark, f"{stored}/network/report").filter("total_wr2 IS NOT NULL").count() == 5
