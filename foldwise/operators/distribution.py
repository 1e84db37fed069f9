"""Histogram and density curve data."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwise.functions.bins import bin_centre, histogram_bin
from foldwise.operators.joins import join_small, single_key

KDE_POINTS = 200
KDE_CUT = 3


def histogram(df: DataFrame, by: list[str], col: str, n: int) -> DataFrame:
    """Count per equal-width bin on [0, 1]; empty bins are listed with 0, outside values ignored."""
    counts = (
        df.groupBy(*by, histogram_bin(F.col(col), n).alias("bin"))
        .agg(F.count("*").alias("count"))
        .filter(F.col("bin").isNotNull())
    )
    # At most n entries per group.
    packed = counts.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("bin", "count"))).alias("_m"))
    return packed.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(
        *by, "bin", bin_centre(F.col("bin"), n).alias("centre"),
        F.coalesce(F.try_element_at("_m", F.col("bin")), F.lit(0)).cast("long").alias("count"),
    )


def density_histogram(df: DataFrame, by: list[str], col: str, n: int) -> DataFrame:
    """Histogram scaled to an area of one."""
    h = histogram(df, by, col, n)
    # The histogram has n rows per group.
    total = F.sum("count").over(Window.partitionBy(*by))
    return h.withColumn("density", F.col("count") / total / F.lit(1.0 / n))


def kde(df: DataFrame, by: list[str], col: str, points: int = KDE_POINTS, cut: int = KDE_CUT,
        groups: int | None = None) -> DataFrame:
    """Gaussian density curve with Scott's bandwidth on an even grid, exact over all rows.

    Every row adds its kernel to each grid point inside the stage; the partial
    sums leave a task as ``points`` rows per group, whatever the number of rows.
    """
    x = F.col(col).cast("double")
    stats = (
        df.groupBy(*by)
        .agg(F.count(x).alias("_n"), F.stddev_samp(x).alias("_sd"), F.min(x).alias("_lo"), F.max(x).alias("_hi"))
        .withColumn("_h", F.col("_sd") * F.pow(F.col("_n"), F.lit(-0.2)))
        .withColumn("_from", F.col("_lo") - F.lit(float(cut)) * F.col("_h"))
        .withColumn("_step", (F.col("_hi") + F.lit(float(cut)) * F.col("_h") - F.col("_from")) / (points - 1))
        .select(*by, "_n", "_h", "_from", "_step")
    )
    rows = df.select(*by, x.alias("_x")).filter(F.col("_x").isNotNull())
    if by:
        joined = join_small(rows, stats, by, "inner", groups)
    else:
        key = single_key().alias("_k")
        joined = join_small(rows.select("*", key), stats.select("*", key), ["_k"], "inner", 1).drop("_k")
    kernel = F.exp(-((F.col("_from") + F.col("point") * F.col("_step") - F.col("_x")) ** 2) / (F.col("_h") ** 2 * 2.0))
    return (
        joined.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .groupBy(*by, "point", "_n", "_h", "_from", "_step")
        .agg(F.sum(kernel).alias("_s"))
        .select(
            *by, "point", (F.col("_from") + F.col("point") * F.col("_step")).alias("x"),
            (F.col("_s") / (F.col("_n") * F.col("_h") * math.sqrt(2 * math.pi))).alias("density"),
        )
    )
