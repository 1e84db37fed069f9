"""Near-duplicate embeddings by collision-counting projections.

Vectors of length one are projected on many random lines. Projections are cut into tables of ``DEPTH`` lines; the vectors of a table are
sorted by their cells (width ``WIDTH``, random offset) on all its lines, and runs of equal cells are compared.
For each pair of a run the lines are counted on which one lies in the window of half-width ``REACH`` around the other; pairs that reach
``least_collisions()``, calibrated so that a pair at the threshold is missed with chance ``MISS``, are verified by cosine in double
precision. One-dimensional windows alone would keep a fixed share of all pairs, so the sorted cells of several lines choose whom
to compare; a pair counts in the first table that brings it together. Runs above ``BLOCK`` vectors are compared block by block,
and a block returns link counts and a spanning forest, never its pairs. Equal vectors fall together first.

With the lines and tables given a pair of cosine 0.95 meets in some table with chance 0.997, one of 0.9 with 0.95.

Defined results: a vector that is null, empty or zero, or holds null or non-finite components, links with nothing and keeps itself; vectors of
different dimension are not compared; equal vectors link with each other; repeated rows count as other vectors; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm.common import kept, mixed, table
from foldwise.llm.components import components
from foldwise.llm.registry import query

THRESHOLD = 0.9
TABLES, DEPTH, WIDTH = 20, 10, 2.0
LINES, REACH, MISS = 32, 1.0, 1e-4
BLOCK = 1024


@functools.cache
def least_collisions(threshold: float = THRESHOLD) -> int:
    """The largest count that a pair at the threshold reaches with chance 1 - MISS; its projections differ by a
    normal deviate of variance 2 - 2 * threshold."""
    p = math.erf(REACH / math.sqrt(2 * (2 - 2 * threshold)))
    below, count = 0.0, 0
    while True:
        below += math.comb(LINES, count) * p**count * (1 - p) ** (LINES - count)
        if below > MISS:
            return count
        count += 1


@functools.cache
def _lines(dimension: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng([29, dimension])
    return random.standard_normal((dimension, TABLES * DEPTH)), random.uniform(0, WIDTH, TABLES * DEPTH)


def project(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Projections of unit-length copies on all lines, and one cell number per table."""
    lines, offsets = _lines(vectors.shape[1])
    # Scaled by the largest component first, so that huge or tiny vectors keep a finite norm.
    unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    places = unit @ lines
    cells = np.floor((places + offsets) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(vectors), TABLES, DEPTH)
    keys = np.full((len(vectors), TABLES), vectors.shape[1], np.uint64)
    for k in range(DEPTH):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, k])
    return places, keys.view(np.int64)


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = batch.column("vector").to_pylist()
        cells: list = [None] * len(raw)
        for d in {len(v) for v in raw}:
            rows = [i for i, v in enumerate(raw) if len(v) == d]
            _, keys = project(np.array([raw[i] for i in rows], float))
            for i, k in zip(rows, keys):
                cells[i] = k.tolist()
        packed = pa.array([np.array(v, float).tobytes() for v in raw], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("copies"), packed, pa.array(cells, pa.list_(pa.int64()))],
                                         names=["key", "copies", "packed", "cells"])


def _links(vectors: np.ndarray, copies: np.ndarray, own: np.ndarray, number: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Per vector of a run: copies of the vectors it links with for the first time here, and the run's component."""
    n = len(vectors)
    places, keys = project(vectors)
    near = places[:, :LINES].astype(np.float32)
    left, right = [], []
    for at in range(0, n, 64):
        part = near[at : at + 64]
        counts = (np.abs(part[:, None, :] - near[None, :, :]) <= REACH).sum(axis=2)
        i, j = np.nonzero(counts >= least_collisions(threshold))
        i = i + at
        good = i < j
        left.append(i[good])
        right.append(j[good])
    i, j = np.concatenate(left), np.concatenate(right)
    if own.min() != own.max():
        good = own[i] != own[j]
        i, j = i[good], j[good]
    if number:
        good = ~(keys[i, :number] == keys[j, :number]).any(axis=1)
        i, j = i[good], j[good]
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    norms = np.linalg.norm(scaled, axis=1)
    good = np.einsum("ij,ij->i", scaled[i], scaled[j]) / (norms[i] * norms[j]) >= threshold
    i, j = i[good], j[good]
    total = np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
    root = np.arange(n)
    while True:
        lower = root.copy()
        np.minimum.at(lower, i, root[j])
        np.minimum.at(lower, j, root[i])
        lower = lower[lower]
        if (lower == root).all():
            return total.astype(np.int64), root
        root = lower


def _compare(threshold: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of equal (number, cell, x, y) in sorted rows; a run's rows may lie in several batches."""
        held: list[dict] = []
        run = None

        def finish() -> pa.RecordBatch | None:
            if len(held) < 2:
                return None
            vectors = np.frombuffer(b"".join(r["packed"] for r in held), float).reshape(len(held), -1)
            total, root = _links(vectors, np.array([r["copies"] for r in held]), np.array([r["own"] for r in held]), run[0], threshold)
            some = np.flatnonzero(total)
            if not len(some):
                return None
            return pa.RecordBatch.from_arrays(
                [pa.array([held[k]["key"] for k in some]), pa.array([held[root[k]]["key"] for k in some]), pa.array(total[some])], names=["key", "root", "links"])

        for batch in batches:
            for row in batch.to_pylist():
                name = (row["number"], row["cell"], row["x"], row["y"], len(row["packed"]))
                if name != run:
                    out = finish()
                    if out is not None:
                        yield out
                    held.clear()
                    run = name
                held.append(row)
        out = finish()
        if out is not None:
            yield out
    return compare


def _key(vector: Column) -> Column:
    """Names a vector by its content."""
    return F.md5(F.array_join(F.transform(vector, lambda x: x.cast("string")), ","))


def cluster(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce((F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("key", F.when(usable, _key(F.col("vector"))))
    classes = kept(rows.filter(F.col("key").isNotNull()).groupBy("key").agg(
        F.first("vector").alias("vector"), F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")))
    placed = kept(classes.select("key", "copies", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(
        _place, "key string, copies long, packed binary, cells array<long>"))
    cells = placed.select("key", F.posexplode("cells").alias("number", "cell"))
    sizes = cells.groupBy("number", "cell").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    shared = cells.join(sizes, ["number", "cell"]).withColumn("blocks", blocks).withColumn(
        "own", (F.abs(F.xxhash64("key", "number")) % F.col("blocks")).cast("int"))
    shared = shared.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    shared = shared.select("key", "number", "cell", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    # Within a pair of different blocks only pairs across count; a block's own pairs stand in (own, own).
    runs = shared.join(placed.select("key", "copies", "packed"), "key")
    order = ["number", "cell", "x", "y"]
    runs = runs.repartition(*order).sortWithinPartitions(*order, F.length("packed"))
    found = kept(runs.mapInArrow(_compare(threshold), "key string, root string, links long"))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    known = classes.select("key", "vec_id", "copies").join(links, "key", "left").join(roots.withColumnRenamed("node", "key"), "key", "left")
    known = known.withColumn("root", F.coalesce("root", "key"))
    least = known.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    known = known.join(least, "root").select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "key").join(known, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.col("vec_id").eqNullSafe(component).alias("kept"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r(vec_id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.vec_id),
m AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, component_id = vec_id AS kept FROM m LEFT JOIN n USING (vec_id)
"""


@query("op6_embedding_duplicates", SQL)
def op6_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))
