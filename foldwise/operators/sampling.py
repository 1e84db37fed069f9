"""Exact-size samples without a global sort.

Rows are ordered by a seeded digest of their key columns, so a sample does not
depend on partitioning and survives a re-run of any task. To take the ``n`` first
rows of a group, rows are counted per digest prefix, the prefix that holds the
``n``-th row is found on the counts, rows below it are kept by a plain filter, and
only rows of that one prefix are ranked. Equal rows share a digest and are
interchangeable: they are counted, not ranked, and written back from their count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise import constants as K
from foldwise.functions.scalar import nan_to_null
from foldwise.operators.joins import join_small
from foldwise.session import cut_lineage

PREFIX_HEX = 5
_CHUNK = 100_000


def order_digest(cols: list[str], seed: int) -> Column:
    """Seeded digest that orders rows; the same text in any engine gives the same order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def take_first(df: DataFrame, sizes: DataFrame, by: list[str], order_cols: list[str], seed: int,
               max_groups: int | None = None) -> DataFrame:
    """Per group the first ``take`` rows in digest order.

    ``sizes`` holds one row per group with the wanted number ``take``. A group
    with fewer rows stops the job, as a draw without replacement must.
    """
    tagged = _tagged(df, F.lit(True), order_cols, seed)
    counts = tagged.groupBy(*by, "_p").agg(F.count("*").alias("_n"))
    return _draw(df, tagged, counts, sizes, by, F.lit(False), max_groups)


def _tagged(df: DataFrame, drawn: Column, order_cols: list[str], seed: int) -> DataFrame:
    """Digest and digest prefix of the rows to draw from; other rows have none."""
    return df.withColumn("_d", F.when(drawn, order_digest(order_cols, seed))).withColumn("_p", F.substring("_d", 1, PREFIX_HEX))


def _draw(df: DataFrame, tagged: DataFrame, counts: DataFrame, sizes: DataFrame, by: list[str], kept: Column,
          max_groups: int | None) -> DataFrame:
    """Rows that are ``kept`` anyway, and of each group's tagged rows the first ``take``.

    One scan counts, one writes the rows below the cut, one handles the prefix of the cut.
    """
    columns = df.columns
    running = Window.partitionBy(*by).orderBy("_p")
    placed = counts.withColumn("_upto", F.sum("_n").over(running))
    totals = counts.groupBy(*by).agg(F.sum("_n").alias("_total"))
    # Lets no row through, but stops the job when a group is too small, even one without any row.
    short = F.coalesce("_total", F.lit(0)) < F.col("take")
    guard = join_small(sizes, totals, by, "left", max_groups).filter(
        F.when(short, F.raise_error(F.lit("group smaller than the sample")).cast("boolean")).otherwise(F.lit(False))
    ).select(*[F.lit(None).cast(t).alias(c) for c, t in df.dtypes])
    cut = (
        join_small(placed, sizes, by, "inner", max_groups)
        .filter((F.col("_upto") >= F.col("take")) & (F.col("_upto") - F.col("_n") < F.col("take")))
        .select(*by, F.col("_p").alias("_cut"), (F.col("take") - F.col("_upto") + F.col("_n")).alias("_left"))
    )
    below = join_small(tagged, cut, by, "left", max_groups).filter(kept | (F.col("_p") < F.col("_cut"))).select(*columns)
    edge = (
        join_small(tagged.filter(F.col("_p").isNotNull()), cut, by, "inner", max_groups)
        .filter(F.col("_p") == F.col("_cut"))
        .groupBy(*columns, "_d", "_left")
        .agg(F.count("*").alias("_copies"))
        .withColumn(
            "_before",
            F.sum("_copies").over(
                Window.partitionBy(*by).orderBy("_d", *columns).rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
        .withColumn("_keep", F.least("_copies", F.col("_left") - F.coalesce("_before", F.lit(0))))
        .filter("_keep > 0")
    )
    return below.unionByName(_repeat(edge, "_keep").select(*columns)).unionByName(guard)


def _repeat(df: DataFrame, times: str) -> DataFrame:
    """Each row ``times`` times, spread in chunks so that no task builds one long array."""
    chunks = F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / _CHUNK))
    return (
        df.withColumn("_c", F.explode(chunks))
        .withColumn("_size", F.least(F.lit(_CHUNK).cast("long"), F.col(times) - F.col("_c") * _CHUNK))
        .withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_size"))))
    )


def filter_label(df: DataFrame, label: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Rows with ``low <= label < high``; a bound left out does not apply."""
    tests = []
    if low is not None:
        tests.append((F.col(label) >= low) & ~F.isnan(label))
    if high is not None:
        tests.append(F.col(label) < high)
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def downsample(df: DataFrame, by: list[str], label: str, order_cols: list[str], seed: int = 42,
               low: float = K.LOW_BAND, high: float = K.HIGH_BAND, max_groups: int | None = None) -> DataFrame:
    """All rows with label >= ``low``, and of the rest exactly as many as lie above ``high``.

    Rows without a label drop out.
    """
    y = nan_to_null(F.col(label).cast("double"))
    tagged = _tagged(df, y < low, order_cols, seed)
    # High rows have no prefix, so the counting scan also gives the number to draw. The
    # counts (at most one row per group and prefix) are kept, or each use would scan again.
    counts = cut_lineage(tagged.filter((y < low) | (y > high)).groupBy(*by, "_p").agg(F.count("*").alias("_n")))
    sizes = counts.filter(F.col("_p").isNull()).select(*by, F.col("_n").alias("take"))
    return _draw(df, tagged, counts.filter(F.col("_p").isNotNull()), sizes, by, F.coalesce(y >= low, F.lit(False)), max_groups)


def make_variants(df: DataFrame, by: list[str], label: str, order_cols: list[str], seed: int = 42,
                  max_groups: int | None = None) -> DataFrame:
    """Variant A (every row) and variant B (down-sampled) in one table."""
    small = downsample(df, by, label, order_cols, seed, max_groups=max_groups)
    return df.withColumn("variant", F.lit("A")).unionByName(small.withColumn("variant", F.lit("B")))


def sample_fraction(df: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Bernoulli sample; the size is close to the fraction, not exact."""
    return df.sample(False, fraction, seed)


def sample_by_digest(df: DataFrame, fraction: float, key: list[str], seed: int) -> DataFrame:
    """Bernoulli sample decided by the key, so every table with that key keeps the same rows."""
    # The first 13 hex digits are 52 bits, exact in a double.
    share = F.conv(F.substring(order_digest(key, seed), 1, 13), 16, 10).cast("double") / float(16**13)
    return df.filter(share < fraction)


def sample_aligned(x: DataFrame, y: DataFrame, key: list[str], fraction: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """The same sampled keys from two tables, without a join."""
    return sample_by_digest(x, fraction, key, seed), sample_by_digest(y, fraction, key, seed)


def sample_n(df: DataFrame, n: int, order_cols: list[str], seed: int) -> DataFrame:
    """``min(n, rows)`` rows without replacement, by a top-n over the digest."""
    columns = df.columns
    return df.orderBy(order_digest(order_cols, seed), *columns).limit(n)
