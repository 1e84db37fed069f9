"""Hard-negative mining by exact integer products of anchor and candidate tiles.

Vectors are scaled and floored to 64-bit integers. The rows are dealt into parts, the anchors into slots; a task takes one (slot, part) pair and
multiplies its tiles by Strassen's recursion: halves of both matrices, padded with zeros to even sizes, seven products in place of eight,
sums and differences of integers, which are exact. Two sweeps over the tiles: the first keeps a heap of the best rows of the anchor's own label,
the second a heap of the best other rows inside the score window of each of those positives. Heaps merge: tile by tile in a task, then over
tasks by a limited rank, of which every task sends its first few rows only.

At scale: a group is at most ``SLOT_ROWS`` anchors against about ``PART_ROWS`` rows, whatever the input; each row is sent once per slot, each anchor
once per part, and no score leaves a task but those of the heaps. Parts and slots follow from a row number, so neither a label, a
vector nor an id of a third of all rows is a hot group.

Defined results: rows with a null id, label or vector, or with a null or non-finite component take no part, nor do vectors whose squared
length after scaling reaches 2^55 (their scores would not fit); vectors of different dimension are not compared; ties go to the smaller
id; repeated rows and rows of one id are rows like others, so a copy of an anchor may be its positive and a repeated anchor
has its rows twice; an anchor without positives, or a positive with an empty window, gives no rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldwise.llm.common import kept, table
from foldwise.llm.registry import query

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
# A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 30, 90
SLOT_ROWS, PART_ROWS, TILE_ROWS = 1024, 4096, 1024
# Below this size a product is taken directly.
LEAF = 32
LARGEST = 2.0**55


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Exact product of two int64 matrices whose true values fit 64 bits."""
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
        return strassen(a, b, leaf)[:m, :n]
    i, j, h = m // 2, n // 2, k // 2
    a11, a12, a21, a22 = a[:i, :h], a[:i, h:], a[i:, :h], a[i:, h:]
    b11, b12, b21, b22 = b[:h, :j], b[:h, j:], b[h:, :j], b[h:, j:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((m, n), np.int64)
    out[:i, :j] = p1 + p4 - p5 + p7
    out[:i, j:] = p3 + p5
    out[i:, :j] = p2 + p4
    out[i:, j:] = p1 - p2 + p3 + p6
    return out


def best(scores: np.ndarray, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``size`` by score from above, ties by smaller id."""
    if len(scores) > size:
        least = np.partition(scores, len(scores) - size)[len(scores) - size]
        near = scores >= least
        scores, ids = scores[near], ids[near]
    order = np.lexsort((ids, -scores))[:size]
    return scores[order], ids[order]


class Heaps:
    """The best (score, id) of many keys; takes any number of further ones."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.held: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, key: tuple, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(scores):
            return
        if key in self.held:
            scores, ids = np.concatenate([self.held[key][0], scores]), np.concatenate([self.held[key][1], ids])
        self.held[key] = best(scores, ids, self.size)

    def table(self, names: list[str]) -> pa.Table:
        """One row per entry: the parts of the key, id, score."""
        keys = list(self.held)
        size = [len(self.held[k][0]) for k in keys]
        columns = [pa.array(np.repeat(np.array([k[i] for k in keys], np.int64), size)) for i in range(len(names))]
        for which in (1, 0):
            columns.append(pa.array(np.concatenate([self.held[k][which] for k in keys]) if keys else np.zeros(0, np.int64), pa.int64()))
        return pa.Table.from_arrays(columns, names=[*names, "id", "score"])


def _matrix(vectors: pa.ChunkedArray, rows: int) -> np.ndarray:
    return pa.concat_arrays([c.flatten() for c in vectors.chunks]).to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows, -1)


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.int64)


def _tiles(anchors: pa.Table, rows: pa.Table) -> Iterator[tuple[slice, np.ndarray]]:
    """Score tiles of all anchors against runs of rows."""
    a, b = _matrix(anchors.column("ints"), len(anchors)), _matrix(rows.column("ints"), len(rows))
    for at in range(0, len(rows), TILE_ROWS):
        run = slice(at, min(at + TILE_ROWS, len(rows)))
        yield run, strassen(a, np.ascontiguousarray(b[run].T))


def _positive_heaps(size: int):
    def task(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        heaps = Heaps(size)
        if len(rows) and len(anchors):
            ids, labels, numbers = (_numbers(rows.column(c)) for c in ("id", "label", "row"))
            a_labels, a_numbers = (_numbers(anchors.column(c)) for c in ("label", "row"))
            for run, scores in _tiles(anchors, rows):
                for i, (label, number) in enumerate(zip(a_labels, a_numbers)):
                    mine = np.flatnonzero((labels[run] == label) & (numbers[run] != number))
                    heaps.add((number,), scores[i, mine], ids[run][mine])
        return heaps.table(["anchor"])

    return task


def _window_heaps(size: int, low: int, high: int):
    def task(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        heaps = Heaps(size)
        if len(rows) and len(anchors):
            ids, labels = (_numbers(rows.column(c)) for c in ("id", "label"))
            a_labels, a_numbers = (_numbers(anchors.column(c)) for c in ("label", "row"))
            windows = anchors.column("windows").to_pylist()
            for run, scores in _tiles(anchors, rows):
                for i, (label, number) in enumerate(zip(a_labels, a_numbers)):
                    # 100 * score lies between these bounds of each positive's score.
                    wide = [(low * p, high * p) for p in windows[i]]
                    hundred = 100 * scores[i]
                    others = np.flatnonzero((labels[run] != label) & (hundred >= min(w[0] for w in wide)) & (hundred <= max(w[1] for w in wide)))
                    hundred, found, names = hundred[others], scores[i, others], ids[run][others]
                    for rank, (least, most) in enumerate(wide, 1):
                        inside = (hundred >= least) & (hundred <= most)
                        heaps.add((number, rank), found[inside], names[inside])
        return heaps.table(["anchor", "place"])

    return task


def prepared(rows: DataFrame, label: Column, id_col: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, label, ints, dimension, row) of the rows that take part; written once, with a number per row."""
    v = F.col("_v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sized = F.aggregate(v, F.lit(0.0), lambda s, x: s + F.floor(x * scale).cast("double") * F.floor(x * scale).cast("double"))
    taken = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("_v"))
    taken = taken.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull()).filter(~bad).filter(sized < LARGEST)
    ints = F.transform(v, lambda x: F.floor(x * scale).cast("long"))
    written = kept(taken.select("id", "label", ints.alias("ints"), F.size(v).alias("dimension")))
    # The written rows keep their order, so the numbers are the same at every reading.
    return written.withColumn("row", F.monotonically_increasing_id())


def first_by_score(found: DataFrame, by: list[str], size: int) -> DataFrame:
    """The first rows of each group with their ``rank``; every task sends its first few only."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)


def mine(rows: DataFrame, label: Column, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
         id_col: str = "vec_id", vector: str = "embedding", scale: int = SCALE, slot_rows: int = SLOT_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the hard negatives of every anchor and positive.

    ``label`` is an expression over ``rows``, ``anchors`` a condition on ``id`` and ``label`` of those that take part.
    """
    every = prepared(rows, label, id_col, vector, scale)
    asking = every.filter(anchors)
    slots, parts = (max(1, -(-df.count() // size)) for df, size in ((asking, slot_rows), (every, part_rows)))

    def dealt(df: DataFrame, fixed: str, count: int, spread: str, times: int) -> DataFrame:
        return df.withColumn(fixed, F.col("row") % count).withColumn(spread, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(times - 1).cast("long"))))

    def swept(anchor_rows: DataFrame, task, schema: str) -> DataFrame:
        keys = ["dimension", "slot", "part"]
        left = dealt(every, "part", parts, "slot", slots).groupBy(*keys)
        return left.cogroup(dealt(anchor_rows, "slot", slots, "part", parts).groupBy(*keys)).applyInArrow(task, schema)

    near = swept(asking, _positive_heaps(positives), "anchor long, id long, score long")
    near = kept(first_by_score(near, ["anchor"], positives))
    # At most ``positives`` entries per anchor.
    windows = near.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda p: p["score"]).alias("windows"))
    asked = kept(asking.join(windows, F.col("row") == F.col("anchor")).drop("anchor"))
    hard = swept(asked, _window_heaps(negatives, low, high), "anchor long, place long, id long, score long")
    hard = first_by_score(hard, ["anchor", "place"], negatives)
    named = near.select(F.col("anchor").alias("_a"), F.col("rank").alias("_p"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = named.join(asked.select(F.col("row").alias("_a"), F.col("id").alias("anchor_id")), "_a")
    return hard.join(named, (F.col("anchor") == F.col("_a")) & (F.col("place") == F.col("_p"))).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


SQL = """
WITH taken AS (
  SELECT row_number() OVER () AS rn, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS ints
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.rn AS anchor, a.id AS anchor_id, b.id, a.label = b.label AS same,
         CAST(coalesce(list_sum(list_transform(range(1, len(a.ints) + 1), lambda i: a.ints[i] * b.ints[i])), 0) AS BIGINT) AS score
  FROM taken a JOIN taken b ON a.rn <> b.rn AND len(a.ints) = len(b.ints) WHERE a.id % 100 = 0
), positives AS (
  SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) AS place FROM scored WHERE same
  QUALIFY place <= 5
)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
       n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10
"""


@query("op12_hard_negatives", SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor of ``embeddings``; where the id is divisible by seven, the label is moved on by one first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), label, F.col("id") % 100 == 0)
