"""Fold roles from a bucket number.

With ``k`` buckets, fold ``f`` tests on bucket ``f``, validates on bucket
``f + 1`` (modulo ``k``) and trains on the rest; ``train_val`` is train plus val.
The roles of a bucket are a literal array, so they are attached by ``explode``
inside the stage. Attach them to aggregated tables where the statistic allows it:
that costs nothing, while exploding rows multiplies the work by up to ``2k - 1``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLES = ["train", "val", "train_val", "test"]


def fold_bucket(key: Column, k: int = 5) -> Column:
    """Bucket of an integer key."""
    return F.pmod(key, F.lit(k)).cast("int")


def role_of(bucket: Column, fold: Column, k: int = 5) -> Column:
    """Basic role of a bucket in a fold: test, val or train."""
    return (
        F.when(bucket == fold, "test")
        .when(bucket == F.pmod(fold + 1, F.lit(k)), "val")
        .otherwise("train")
    )


def roles_of_bucket(bucket: Column, k: int = 5, roles: list[str] | None = None) -> Column:
    """Array of (fold, role) pairs of a bucket."""
    roles = roles or ROLES
    pairs = []
    for fold in range(k):
        basic = role_of(bucket, F.lit(fold), k)
        for role in roles:
            holds = basic.isin("train", "val") if role == "train_val" else basic == role
            pairs.append(F.when(holds, F.struct(F.lit(fold).alias("fold"), F.lit(role).alias("role"))))
    return F.filter(F.array(*pairs), lambda p: p.isNotNull())


def assign_roles(df: DataFrame, bucket: str = "bucket", k: int = 5,
                 roles: list[str] | None = None) -> DataFrame:
    """One row per (row, fold, role)."""
    return df.withColumn("_pair", F.explode(roles_of_bucket(F.col(bucket), k, roles))).select(
        "*", F.col("_pair.fold").alias("fold"), F.col("_pair.role").alias("role")
    ).drop("_pair")


def passthrough(df: DataFrame, split: str, column: str = "split") -> DataFrame:
    """Rows of one split, unchanged."""
    return df.filter(F.col(column) == split)


def fold_of_position(position: Column, rows_per_fold: int) -> Column:
    """Fold number of a carried row position."""
    return F.floor(position / rows_per_fold).cast("int")
