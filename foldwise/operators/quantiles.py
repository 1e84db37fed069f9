"""Exact quantiles by radix selection on order-preserving keys.

``percentile`` keeps every distinct value of a group in one task. Here a value is a 64-bit key that sorts as the value does
(`functions.bits.with_order_key`). A pass counts rows per (group, next ``BITS`` bits of the key) inside the cells that hold a wanted rank; the
counts name the finer cell of each rank, and the next pass reads only rows of such cells, until every wanted cell holds a single value. That
takes four passes at most whatever the range of the values, infinities included. Cells are shared by all groups, so a fold's ranks follow
from bucket counts and no row is repeated per fold. A pass is one scan with partial aggregation and one lookup of the wanted
cells; no group is gathered anywhere, and a value held by a third of all rows is one cell.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.functions.bits import KEY_BITS, with_order_key
from foldwise.functions.scalar import nan_to_null
from foldwise.operators.folds import roles_of_bucket
from foldwise.operators.joins import join_small
from foldwise.session import settled
from foldwise.sources.tables import spread

BITS = 16


def exact_quantiles(df: DataFrame, by: list[str], cols: list[str], probs: list[float],
                    groups: int | None = None, bits: int = BITS) -> DataFrame:
    """(by, column, prob, value) with linear interpolation between order statistics.

    ``groups`` bounds the number of groups where it is known.
    """
    return _quantiles(df, by, by, cols, probs, lambda counts: counts, groups if by else 1, bits)


def fold_quantiles(df: DataFrame, cols: list[str], probs: list[float], role: str = "train", bucket: str = "bucket",
                   k: int = 5, bits: int = BITS) -> DataFrame:
    """Quantiles of one role's rows per ``fold``, from counts per bucket."""

    def to_folds(counts: DataFrame) -> DataFrame:
        paired = counts.withColumn("_p", F.explode(roles_of_bucket(F.col(bucket), k, [role])))
        return paired.withColumn("fold", F.col("_p.fold")).drop("_p", bucket)

    return _quantiles(df, [bucket], ["fold"], cols, probs, to_folds, k, bits)


def _cell(depth: int, bits: int) -> Column:
    """The first ``depth * bits`` bits of the key."""
    return F.shiftright("key", max(KEY_BITS - depth * bits, 0)) if depth else F.lit(0).cast("long")


def _quantiles(df: DataFrame, row_by: list[str], by: list[str], cols: list[str], probs: list[float],
               regroup: Callable[[DataFrame], DataFrame], groups: int | None, bits: int) -> DataFrame:
    values = F.array(*[F.struct(F.lit(i).alias("c"), nan_to_null(F.col(c).cast("double")).alias("x")) for i, c in enumerate(cols)])
    # Equal values of a group are one row with a count.
    counted = spread(df.select(*row_by, *cols)).select(*row_by, F.inline(values)).filter(F.col("x").isNotNull()).groupBy(*row_by, "c", "x").agg(F.count("*").alias("n"))
    rows = with_order_key(counted, F.col("x"), "key")
    # Read once per pass; lost blocks are computed again from the source.
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        ends, found = _selected(rows, row_by, by, probs, regroup, groups, len(cols), bits)
    finally:
        rows.unpersist()
    wanted = ends.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("pos"), F.ceil("pos")))))
    near = wanted.join(found, [*by, "c", "rank"]).groupBy(*by, "c", "prob", "pos").agg(
        F.min_by("v", "rank").alias("_a"), F.max_by("v", "rank").alias("_z")
    )
    names = F.array(*[F.lit(c) for c in cols])
    # Equal neighbours stand for themselves, infinite ones too.
    between = F.when(F.col("_a") == F.col("_z"), F.col("_a")).otherwise(F.col("_a") + (F.col("pos") - F.floor("pos")) * (F.col("_z") - F.col("_a")))
    return near.select(*by, F.element_at(names, F.col("c") + 1).alias("column"), "prob", between.alias("value"))


def _selected(rows: DataFrame, row_by: list[str], by: list[str], probs: list[float], regroup: Callable[[DataFrame], DataFrame],
              groups: int | None, n_cols: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """(by, c, prob, pos) of the wanted places and (by, c, rank, v) of the order statistics around them."""
    bound = None if groups is None else groups * n_cols
    most = None if bound is None else bound * len(probs) * 2
    keys = [*by, "c", "parent"]
    ends = state = None
    depth = 1
    while True:
        parent, cell = _cell(depth - 1, bits), _cell(depth, bits)
        inside = rows.withColumns({"parent": parent, "id": cell})
        if state is not None:
            open_ = state.filter("lo < hi")
            inside = join_small(inside, open_.select("c", F.col("id").alias("parent")).distinct(), ["c", "parent"], "inner", most)
        counts = inside.groupBy(*row_by, "c", "parent", "id").agg(
            F.sum("n").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.min("x").alias("v")
        )
        cells = regroup(counts).groupBy(*keys, "id").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("v").alias("v"))
        if state is None:
            # The first counts also give the sizes, hence the wanted ranks.
            cells = settled(cells, None if bound is None else bound << bits)
            sizes = cells.groupBy(*by, "c").agg(F.sum("n").alias("n"))
            ends = settled(sizes.withColumn("prob", F.explode(F.array(*[F.lit(float(q)) for q in probs]))).withColumn(
                "pos", (F.col("n") - 1) * F.col("prob")
            ).drop("n"), most)
            ranks = ends.select(*by, "c", F.explode(F.array(F.floor("pos"), F.ceil("pos"))).alias("rank")).distinct()
            asked = ranks.withColumns({"parent": F.lit(0).cast("long"), "base": F.lit(0).cast("long")})
            done = None
        else:
            asked = open_.select(*by, "c", "rank", F.col("id").alias("parent"), "base")
            done = state.filter("lo >= hi")
        state = _held(cells, asked, keys)
        state = settled(state if done is None else done.unionByName(state), most)
        if depth * bits >= KEY_BITS or state.select(F.bool_and(F.col("lo") >= F.col("hi"))).first()[0] is not False:
            return ends, state.select(*by, "c", "rank", "v")
        depth += 1


def _held(cells: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """The cell that holds each asked rank, as the last cell that begins at or before it: one sort of cells and ranks together."""
    own = [k for k in keys if k != "parent"]
    starts = cells.withColumn("at", F.sum("n").over(Window.partitionBy(*keys).orderBy("id")) - F.col("n"))
    starts = starts.select(*keys, "at", F.lit(0).alias("_kind"), F.struct("id", "lo", "hi", "v", "at").alias("_cell"), F.lit(None).cast("long").alias("rank"), F.lit(None).cast("long").alias("base"))
    wanted = asked.select(*keys, (F.col("rank") - F.col("base")).alias("at"), F.lit(1).alias("_kind"), F.lit(None).alias("_cell"), "rank", "base")
    order = Window.partitionBy(*keys).orderBy("at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    placed = starts.unionByName(wanted).withColumn("_cell", F.last("_cell", ignorenulls=True).over(order)).filter(F.col("_kind") == 1)
    return placed.select(*own, "rank", "_cell.id", "_cell.lo", "_cell.hi", "_cell.v", (F.col("base") + F.col("_cell.at")).alias("base"))
