import pytest
from pyspark.sql import functions as F

from foldwise.operators import cleaning
from foldwise.operators.linear import Fit, fits_table
from foldwise.operators.trees import assembled, forest
from foldwise.sources import models, tables


def test_write_and_load(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "x int, s string")
    bad = df.select(F.raise_error(F.lit("broken")).alias("x"))
    failed = tables.save_tables({str(tmp_path / "d"): {"good": df, "bad": bad, "later": df}})
    assert len(failed) == 1 and "bad.parquet" in next(iter(failed))
    loaded = tables.load_tables(spark, str(tmp_path / "d"), views=True)
    assert {"good", "later"} <= set(loaded)
    assert spark.sql("SELECT s FROM good").first()[0] == "a"


def test_missing_and_empty_folder(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.load_tables(spark, str(tmp_path / "none"))
    (tmp_path / "empty").mkdir()
    assert tables.load_tables(spark, str(tmp_path / "empty")) == {}


def test_declared_schema(spark, tmp_path):
    tables.write_table(spark.createDataFrame([(1, 2)], "x int, z int"), str(tmp_path / "t"))
    assert tables.read_table(spark, str(tmp_path / "t"), "x double").dtypes == [("x", "double")]
    with pytest.raises(ValueError, match="nope"):
        tables.read_table(spark, str(tmp_path / "t"), "nope int")


def test_folds_are_pruned_partitions(spark, tmp_path):
    paths = []
    for i in range(3):
        paths.append(str(tmp_path / f"f{i}"))
        tables.write_table(spark.createDataFrame([(i * 10,)], "x int"), paths[-1])
    folds = tables.fold_registry(spark, {"train": ", ".join(paths), "test": paths[0]}, "B")
    assert sorted((r["split"], r["fold"], r["x"]) for r in folds.collect()) == [("test", 0, 0), ("train", 0, 0), ("train", 1, 10), ("train", 2, 20)]
    tables.write_folds(folds, str(tmp_path / "all"))
    one = spark.read.parquet(str(tmp_path / "all")).filter("split = 'train' AND fold = 1")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and one.count() == 1


def test_models_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i % 5, float(i), i / 50) for i in range(50)], "bucket int, a double, y double")
    data = assembled(df, ["a"], "y")
    fitted = forest({"n_estimators": 2, "max_depth": 3, "n_bins": 8}).fit(data)
    models.save_model(fitted, str(tmp_path / "m"))
    again = models.load_model(str(tmp_path / "m"))
    assert [r["prediction"] for r in again.transform(data).collect()] == [r["prediction"] for r in fitted.transform(data).collect()]


def test_coefficient_models(spark, tmp_path):
    fits = fits_table(spark, [Fit(1.0, [2.0, 3.0]), Fit(0.0, [1.0, 1.0])], ["a", "b"], "ols")
    models.save_fits(fits, str(tmp_path / "c"))
    stored = models.read_best_params(spark, str(tmp_path / "c"))
    df = spark.createDataFrame([(0, 1.0, 1.0), (1, 1.0, 1.0), (2, 1.0, 1.0)], "fold int, a double, b double")
    assert sorted((r["fold"], r["p"]) for r in models.score_models(df, stored, ["a", "b"], max_models=2).collect()) == [(0, 6.0), (1, 2.0)]
    assert [r["fold"] for r in models.missing_models(df.select("fold"), stored, ["fold"]).collect()] == [2]
    tables.write_predictions(models.score_models(df, stored, ["a", "b"]), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).filter("model = 'ols'").count() == 2


def test_type_rules(spark):
    df = spark.createDataFrame([("1.5", True, 3, 4)], "s string, b boolean, i int, k int")
    out = cleaning.harmonise_types(df, ["k"])
    assert out.dtypes == [("s", "double"), ("b", "int"), ("i", "double"), ("k", "int")]
    assert cleaning.feature_columns(df, ["s", "b"]) == ["i", "k"]
    with pytest.raises(ValueError, match="zz"):
        cleaning.align_schema(df, spark.createDataFrame([], "zz int").schema)
    assert cleaning.schema_differences(df, spark.createDataFrame([], "s string, i long, q int").schema) == [
        ("i", "int", "bigint"), ("q", "absent", "int"), ("b", "boolean", "absent"), ("k", "int", "absent")]


def test_parse_source(spark):
    df = spark.createDataFrame([("/x/CV3_train_val_df_A.parquet",), ("s3://b/CV0_test_df_B",), ("other",)], "path string")
    got = [(r["fold"], r["split"], r["variant"]) for r in cleaning.parse_source(df).collect()]
    assert got == [(3, "train_val", "A"), (0, "test", "B"), (None, "", "")]
