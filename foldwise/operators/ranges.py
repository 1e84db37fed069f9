"""As-of join: every row with the last table entry at or before its value.

Joining on a range alone compares every row with every entry. Here the entries of a group form a tree over the leading bits of the
order-preserving key: a node with more than ``LEAF`` entries has sixteen children, one per next four bits, so the leaves cover all keys, and a leaf
holds its few entries and the one before them. A row meets exactly one leaf: its key's prefix at that leaf's depth. So the join is an equi-join
on (group, depth, prefix) whatever the spread of the keys, and the leaf's entries settle the rest inside the row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.functions.bits import KEY_BITS, with_order_key
from foldwise.operators.joins import join_small
from foldwise.session import settled

STEP = 4
LEAF = 8


def leaves(keys: np.ndarray, leaf: int = LEAF) -> list[tuple[int, int, int, int]]:
    """(depth, prefix, first, end) of the leaves over sorted keys; entries first..end - 1 are those a row of the leaf may need."""
    out = []
    stack = [(0, 0, 0, len(keys))]
    while stack:
        depth, prefix, start, end = stack.pop()
        if depth and (end - start <= leaf or depth * STEP == KEY_BITS):
            out.append((depth, prefix, max(start - 1, 0), end))
            continue
        shift = KEY_BITS - (depth + 1) * STEP
        digits = range(-8, 8) if depth == 0 else range(16)
        children = [prefix * 16 + d for d in digits]
        cuts = [start, *np.searchsorted(keys[start:end], np.array([c << shift for c in children[1:]], np.int64)) + start, end]
        stack += [(depth + 1, c, int(a), int(z)) for c, a, z in zip(children, cuts, cuts[1:])]
    return out


def asof_join(rows: DataFrame, table: DataFrame, by: list[str], value: str, key: str, into: str,
              max_rows: int | None = None, leaf: int = LEAF) -> DataFrame:
    """``rows`` with ``into``, the other columns of the last entry of their group whose ``key`` is at most ``value``; null where none is.

    ``table`` has one row per (``by``, ``key``), the entries of a group fit one task, and ``max_rows`` bounds all of them where that is known.
    Rows with a null or NaN value get null. Rows of a group without entries are left out.
    """
    others = [c for c in table.columns if c not in by]
    numbered = with_order_key(table, F.col(key), "_k").filter(F.col("_k").isNotNull()).select(*by, "_k", F.struct(*others).alias("_entry")).withColumn(
        "_i", F.row_number().over(Window.partitionBy(*by).orderBy("_k")) - 1)
    # A few leaves per entry; the bound holds for keys that part within their first bits, the usual case, and is checked by count.
    entries = settled(numbered, max_rows)
    fields = [f for f in entries.schema.fields if f.name in by]
    schema = T.StructType([*fields, *[T.StructField(n, T.LongType()) for n in ("_depth", "_prefix", "_first", "_end")]])

    def grow(group: pa.Table) -> pa.Table:
        found = leaves(np.sort(group.column("_k").to_numpy()), leaf)
        columns = {b: group.column(b).slice(0, 1).combine_chunks().take(pa.array(np.zeros(len(found), np.int64))) for b in by}
        for i, name in enumerate(("_depth", "_prefix", "_first", "_end")):
            columns[name] = pa.array([f[i] for f in found], pa.int64())
        return pa.table(columns)

    cut = entries.select(*by, "_k").groupBy(*by).applyInArrow(grow, schema)
    places = F.when(F.col("_end") > F.col("_first"), F.sequence("_first", F.col("_end") - 1))
    held = cut.withColumn("_i", F.explode_outer(places)).join(entries.withColumn("_i", F.col("_i").cast("long")), [*by, "_i"], "left")
    held = held.groupBy(*by, "_depth", "_prefix").agg(F.collect_list(F.when(F.col("_k").isNotNull(), F.struct("_k", "_entry"))).alias("_held"))
    held = settled(held, None if max_rows is None else max_rows * 8)
    depths = sorted(r[0] for r in held.select("_depth").distinct().collect())
    keyed = with_order_key(rows, F.col(value), "_key")
    steps = F.array(*[F.struct(F.lit(d).cast("long").alias("_depth"), F.shiftright("_key", KEY_BITS - d * STEP).alias("_prefix")) for d in depths])
    met = join_small(keyed.filter(F.col("_key").isNotNull()).select("*", F.inline(steps)), held, [*by, "_depth", "_prefix"], "inner", None if max_rows is None else max_rows * 8)
    # The entries of a leaf are in no order; the one of the largest key counts.
    last = F.aggregate("_held", F.lit(None).cast(held.schema["_held"].dataType.elementType), lambda a, e: F.when((e["_k"] <= F.col("_key")) & (a["_k"].isNull() | (e["_k"] > a["_k"])), e).otherwise(a))["_entry"]
    out = met.withColumn(into, last).select(*rows.columns, into)
    blank = keyed.filter(F.col("_key").isNull()).select(*rows.columns, F.lit(None).cast(out.schema[into].dataType).alias(into))
    return out.unionByName(blank)
