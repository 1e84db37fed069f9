"""Joins against small tables, broadcast only under a proven row bound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


def single_key() -> Column:
    """Join key for a table that is one group.

    Not a literal: the optimizer removes a literal key and is left with a nested-loop join.
    """
    return F.spark_partition_id() * 0


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner",
               max_rows: int | None = None) -> DataFrame:
    """Equi-join with a table of at most ``max_rows`` rows.

    Within the limit the table is broadcast. With no bound, or one above the
    limit, no hint is given: the join shuffles, and adaptive execution splits
    hot keys or broadcasts by the measured size.
    """
    if max_rows is not None and max_rows <= BROADCAST_ROWS:
        small = F.broadcast(small)
    return big.join(small, on, how)


def attach_winner(results: DataFrame, best: DataFrame, on: list[str]) -> DataFrame:
    """Every result row with its fold's winner beside it, where it is the winner."""
    return results.join(best, on, "left")


def pair_roles(df: DataFrame, on: list[str], role: str, values: list[str],
               left: str = "train", right: str = "val") -> DataFrame:
    """Values of two roles side by side, one row per key, by conditional aggregation."""
    wanted = df.filter(F.col(role).isin(left, right))
    return wanted.groupBy(*on).agg(
        *[
            F.max(F.when(F.col(role) == side, F.col(v))).alias(f"{side}_{v}")
            for side in (left, right)
            for v in values
        ]
    )
