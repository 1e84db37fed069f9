"""Inverse-frequency weights of label bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwise import constants as K
from foldwise.functions.bins import bin_text, label_bin, report_bin
from foldwise.operators.joins import join_small


def _bound(groups: int | None, n_edges: int) -> int | None:
    return None if groups is None else groups * (n_edges - 1)


def bin_counts(df: DataFrame, label: str, by: list[str], n_edges: int = K.N_EDGES) -> DataFrame:
    """Rows per label bin; rows without a label are in no bin and have no share of the weights."""
    counts = df.groupBy(*by, label_bin(F.col(label), n_edges).alias("bin")).agg(F.count("*").alias("count"))
    return counts.filter(F.col("bin").isNotNull())


def bin_weights(counts: DataFrame, by: list[str]) -> DataFrame:
    """Inverse count, and its share among the occupied bins of the group."""
    group = Window.partitionBy(*by)
    return counts.withColumn("inverse_count", F.lit(1.0) / (F.col("count") + K.INVERSE_COUNT_EPS)).withColumn(
        "weight", F.col("inverse_count") / F.sum("inverse_count").over(group)
    )


def row_weights(df: DataFrame, label: str, by: list[str], n_edges: int = K.N_EDGES,
                groups: int | None = None) -> DataFrame:
    """Every row that has a label and a group, with the count, inverse count and weight of its label bin.

    ``groups`` is the number of groups in ``by`` where it is known; it bounds the weight table.
    """
    # Both uses of the rows ask for the same filter, so a shuffle below them (a dedup) runs once.
    binned = df.withColumn("bin", label_bin(F.col(label), n_edges)).filter(F.col("bin").isNotNull())
    for c in by:
        binned = binned.filter(F.col(c).isNotNull())
    weights = bin_weights(binned.groupBy(*by, "bin").agg(F.count("*").alias("count")), by)
    return join_small(binned, weights, [*by, "bin"], "inner", _bound(groups, n_edges)).withColumn(
        "bin_range", bin_text(F.col("bin"), n_edges)
    )


def training_weights(df: DataFrame, label: str, by: list[str], n_edges: int = K.N_EDGES,
                     groups: int | None = None) -> DataFrame:
    """Row weights after dropping rows that are equal in every column."""
    return row_weights(df.dropDuplicates(), label, by, n_edges, groups)


def inverse_count_weights(df: DataFrame, label: str, weight: str = "weight") -> DataFrame:
    """Rows with 1/count of their report bin; rows outside every bin drop out."""
    binned = df.withColumn("_bin", report_bin(F.col(label))).filter(F.col("_bin").isNotNull())
    counts = binned.groupBy("_bin").agg((F.lit(1.0) / F.count("*")).alias(weight))
    return join_small(binned, counts, ["_bin"], "inner", 102).drop("_bin")
