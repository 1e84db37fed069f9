"""Mixing sources to target weights with exact word budgets, DataFrame functions only.

Every document gets a hash-random key; within a source the documents stand in key order, the
mix takes them from the front until the source's budget is used up, and starts again from the
front (another epoch) where the budget exceeds the source. The order is never held in one task:
words are summed per source and leading key digits (at most 65,536 cells a source), the cells
get their prefix sums, and only the documents of one cell are sorted together.

Defined results: a null or empty text has size 0 and takes 0; a null source is a source of its own,
last in order; repeated rows each count; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldwise.llm.common import WORD, kept, table
from foldwise.llm.registry import query

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = 17
CELL_DIGITS = 4


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per source of (source, size): source_size, weight, target.

    All words are shared by weight; a source stops at ``cap`` times its size and the excess goes to
    the others by weight. Sources in order of cap / weight fill up one after another, so the
    capped ones are a prefix of that order, found from prefix sums instead of rounds.
    """
    named = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # The windows below hold one row per source, not per document.
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    limit = (F.col("source_size") * cap).cast("double")
    named = named.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double"))
    filling = W.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    total = F.sum("source_size").over(everything).cast("double")
    level = named.withColumns({
        "limit": limit,
        "total": total,
        "open": total - F.coalesce(F.sum(limit).over(before), F.lit(0.0)),
        "rest": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    level = level.withColumn("capped", F.col("open") * F.col("weight") >= F.col("limit") * F.col("rest"))
    free = F.col("total") - F.sum(F.when(F.col("capped"), F.col("limit")).otherwise(0.0)).over(everything)
    weight_left = F.sum(F.when(~F.col("capped"), F.col("weight")).otherwise(0.0)).over(everything)
    target = F.when(F.col("capped"), F.col("limit")).otherwise(free * F.col("weight") / F.nullif(weight_left, F.lit(0.0)))
    return level.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken), one row per input row.

    ``taken`` is whole epochs times the size, plus what the last, partial epoch takes: everything
    before the cut, the leading words of the document at the cut, nothing after it.
    """
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                        word_count(F.col(text_col)).alias("size"))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("size").cast("string")))
    rows = kept(sizes.withColumn("key", key).withColumn("cell", F.substring("key", 1, CELL_DIGITS)))
    targets = source_targets(rows, weights, cap).alias("t")
    cells = rows.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    earlier = W.partitionBy("source").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("cell_before", F.coalesce(F.sum("cell_size").over(earlier), F.lit(0)))
    cells = cells.alias("c").join(targets, F.col("c.source").eqNullSafe(F.col("t.source"))).select(
        "c.source", "c.cell", "cell_before", "source_size", "target")
    budget = F.floor("target").cast("long")
    within = W.partitionBy("r.source", "r.cell").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.alias("r").join(cells.alias("c"), (F.col("r.cell") == F.col("c.cell")) & F.col("r.source").eqNullSafe(F.col("c.source")))
    placed = placed.select(
        "doc_id", F.col("r.source").alias("source"), "size", "source_size", "target", budget.alias("budget"),
        (F.col("cell_before") + F.coalesce(F.sum("size").over(within), F.lit(0))).alias("before"),
    )
    epochs = F.coalesce((F.col("budget") - F.col("budget") % F.nullif("source_size", F.lit(0))) / F.nullif("source_size", F.lit(0)), F.lit(0)).cast("long")
    placed = placed.withColumn("epochs", epochs)
    last = F.col("budget") - F.col("epochs") * F.col("source_size")
    taken = F.col("size") * F.col("epochs") + F.greatest(F.lit(0), F.least(F.col("size"), last - F.col("before")))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS n FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, n * 3 AS cap FROM s),
l AS (SELECT *, sum(n) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open,
  sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(n) OVER () AS total FROM w),
f AS (SELECT *, open * w >= cap * rest AS capped FROM l),
t AS (SELECT source, n::BIGINT AS source_size, CASE WHEN capped THEN cap ELSE
  (total - sum(CASE WHEN capped THEN cap ELSE 0.0::DOUBLE END) OVER ()) * w / nullif(sum(CASE WHEN capped THEN 0.0::DOUBLE ELSE w END) OVER (), 0) END AS target FROM f),
o AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(concat_ws(':', '{SEED}', doc_id::VARCHAR, size::VARCHAR)), doc_id, size
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM d)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * coalesce(floor(target)::BIGINT // nullif(source_size, 0), 0)
   + greatest(0, least(size, floor(target)::BIGINT - coalesce(floor(target)::BIGINT // nullif(source_size, 0), 0) * source_size - prior)))::BIGINT AS taken
FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source
"""


@query("op3_mix_sources", SQL)
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
