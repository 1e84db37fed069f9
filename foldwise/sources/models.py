"""Stored models: Spark ML models as folders, closed-form models as coefficient tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.operators.joins import join_small
from foldwise.sources.tables import write_table


def save_model(model, path: str) -> None:
    """Overwrite a fitted Spark ML model."""
    model.write().overwrite().save(path)


def load_model(path: str):
    """A fitted Spark ML model of whatever kind the folder holds."""
    from pyspark.ml.util import DefaultParamsReader

    spark = SparkSession.getActiveSession()
    return DefaultParamsReader.loadParamsInstance(path, spark)


def save_fits(fits: DataFrame, path: str) -> None:
    """Coefficient table of closed-form models: model, fold, intercept, features, coefs."""
    write_table(fits, path)


def read_best_params(spark: SparkSession, path: str) -> DataFrame:
    """Winning parameters stored by an earlier search."""
    return spark.read.parquet(path)


def linear_score(features: list[str]) -> Column:
    """Dot product of the row's features with the ``coefs`` column plus ``intercept``."""
    x = F.array(*[F.col(c).cast("double") for c in features])
    products = F.zip_with(x, F.col("coefs"), lambda a, b: a * b)
    return F.col("intercept") + F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def score_models(data: DataFrame, models: DataFrame, features: list[str], on: list[str] | None = None,
                 max_models: int | None = None) -> DataFrame:
    """Every row scored by every stored model of its fold.

    Models without rows and rows without a model drop out; ``missing_models`` names them.
    """
    listed = models.filter(F.col("features") == F.array(*[F.lit(c) for c in features])).drop("features")
    scored = join_small(data, listed, on or ["fold"], "inner", max_models)
    return scored.withColumn("p", linear_score(features)).drop("coefs", "intercept")


def missing_models(expected: DataFrame, models: DataFrame, on: list[str]) -> DataFrame:
    """Expected keys without a stored model."""
    return expected.join(models, on, "left_anti")
