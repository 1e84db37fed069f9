"""Cross-product tables: one scan from which a whole linear grid is fitted and scored.

For ``z = (1, scaled features, centred label)`` the sums of ``z_i * z_j`` are taken per
(bucket, label bin). Training sums of a fold are sums over its buckets, and a bin
weight multiplies a whole bin, so ordinary, ridge, lasso and elastic-net fits and
all plain and weighted errors follow from this table. It has ``k`` times a hundred
rows whatever the size of the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise import constants as K
from foldwise.functions.bins import label_bin
from foldwise.operators.folds import roles_of_bucket
from foldwise.session import settled

# Above this many columns the sums leave generated code for a vectorised partial sum per task.
MAX_SQL_WIDTH = 20
MAX_DRIVER_CELLS = 50_000_000


def packed_size(width: int) -> int:
    return width * (width + 1) // 2


def unpack(values: list[float], width: int) -> np.ndarray:
    """Symmetric matrix from its packed upper triangle."""
    m = np.zeros((width, width))
    m[np.triu_indices(width)] = values
    return m + np.triu(m, 1).T


def cross_sums(df: DataFrame, by: list[str], z: list[Column], weight: Column | None = None, costly: bool = False) -> DataFrame:
    """(by, pos, v): sums of ``weight * z_i * z_j``, ``pos`` counting the upper triangle row by row.

    One rule for missing values whatever the width: a row with a null or NaN in any ``z`` or in the weight is left out whole,
    so its count, sums and products agree. Fill values beforehand to keep such rows. ``costly`` says that ``z`` takes work per row: generated code would
    do it once for every product and test of a column, the vectorised sum once a row.
    """
    width = len(z)
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    if width <= MAX_SQL_WIDTH and not costly:
        for c in [*z, *([weight] if weight is not None else [])]:
            df = df.filter(c.isNotNull() & ~F.isnan(c.cast("double")))
        named = df.select(*by, *[c.alias(f"_z{i}") for i, c in enumerate(z)],
                          *([weight.alias("_w")] if weight is not None else []))
        w = F.col("_w") if weight is not None else F.lit(1.0)
        sums = named.groupBy(*by).agg(F.array(*[F.sum(w * F.col(f"_z{i}") * F.col(f"_z{j}")) for i, j in pairs]).alias("_g"))
        return sums.select(*by, F.posexplode("_g").alias("pos", "v"))

    nothing = F.lit(float("nan"))
    packed = df.select(*by, F.array(*[F.coalesce(c.cast("double"), nothing) for c in z]).alias("_z"),
                       (F.coalesce(weight.cast("double"), nothing) if weight is not None else F.lit(1.0)).alias("_w"))
    upper = np.triu_indices(width)
    schema = T.StructType([packed.schema[b] for b in by] + [
        T.StructField("pos", T.IntegerType()), T.StructField("v", T.DoubleType())])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = batch.column("_z").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            w = batch.column("_w").to_numpy(zero_copy_only=False)
            whole = ~(np.isnan(rows).any(axis=1) | np.isnan(w))
            if not whole.all():
                rows, w, batch = rows[whole], w[whole], batch.filter(pa.array(whole))
                if not len(w):
                    continue
            # One number per group of the batch; a null key is a group.
            code, groups = np.zeros(len(w), np.int64), [()]
            for b in by:
                part = batch.column(b).dictionary_encode()
                named = [*part.dictionary.to_pylist(), None]
                code = code * len(named) + part.indices.fill_null(len(named) - 1).to_numpy(zero_copy_only=False)
                groups = [(*g, v) for g in groups for v in named]
            for g in np.unique(code):
                key, at = groups[g], np.flatnonzero(code == g)
                block = rows[at]
                g = (block * w[at, None]).T @ block
                sums[key] = sums[key] + g if key in sums else g
        out_schema = pa.schema([batch_type(f) for f in schema.fields])
        for key, g in sums.items():
            n = packed_size(width)
            cols = [pa.array([v] * n, type=out_schema.field(i).type) for i, v in enumerate(key)]
            cols += [pa.array(np.arange(n, dtype="int32")), pa.array(g[upper])]
            yield pa.RecordBatch.from_arrays(cols, schema=out_schema)

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = {f.name: to_arrow_type(f.dataType) for f in schema.fields}

    def batch_type(f: T.StructField) -> pa.Field:
        return pa.field(f.name, arrow[f.name])

    return packed.mapInArrow(partial, schema).groupBy(*by, "pos").agg(F.sum("v").alias("v"))


@dataclass
class Sums:
    """Cross products of one (fold, role): plain, root-weighted and weighted."""

    plain: np.ndarray
    rooted: np.ndarray
    weighted: np.ndarray


@dataclass
class FoldSums:
    """Cross products of every (fold, role) with the shift and scale used for ``z``."""

    features: list[str]
    shift: np.ndarray
    scale: np.ndarray
    label_shift: float
    k: int
    table: dict[tuple[int, str], Sums] = field(default_factory=dict)

    @property
    def width(self) -> int:
        return len(self.features) + 2

    def residual_vector(self, intercept: float, coefs: np.ndarray) -> np.ndarray:
        """Coefficients of ``label - prediction`` over ``z``."""
        const = self.label_shift - intercept - float(coefs @ self.shift)
        return np.concatenate([[const], -coefs * self.scale, [1.0]])

    def to_raw(self) -> np.ndarray:
        """Matrix that turns ``z`` into (1, raw features, raw label)."""
        s = np.eye(self.width)
        s[1:-1, 0] = self.shift
        s[1:-1, 1:-1] = np.diag(self.scale)
        s[-1, 0] = self.label_shift
        return s


def _centre(df: DataFrame, features: list[str], label: str) -> tuple[np.ndarray, np.ndarray, float]:
    nothing = F.lit(None).cast("double")
    cols = [F.nanvl(F.col(c).cast("double"), nothing) for c in features]
    row = df.agg(
        F.array(*[F.avg(c) for c in cols]).alias("m"),
        F.array(*[F.stddev_pop(c) for c in cols]).alias("s"),
        F.avg(F.nanvl(F.col(label).cast("double"), nothing)).alias("y"),
    ).first()
    s = np.asarray(row["s"], dtype=float)
    return np.asarray(row["m"], dtype=float), np.where(s > 0, s, 1.0), float(row["y"])


def _scaled(features: list[str], label: str, shift: np.ndarray, scale: np.ndarray, label_shift: float) -> list[Column]:
    """``z``: one, the scaled features, the centred label."""
    z = [(F.col(c).cast("double") - float(m)) / float(s) for c, m, s in zip(features, shift, scale)]
    return [F.lit(1.0), *z, F.col(label).cast("double") - label_shift]


def fold_sums(df: DataFrame, features: list[str], label: str, bucket: str = "bucket", k: int = 5,
              roles: list[str] | None = None, n_edges: int = K.N_EDGES) -> FoldSums:
    """Cross products per (fold, role) of the whole table, in two scans (centre, sums)."""
    out = FoldSums(features, *_centre(df, features, label), k)
    binned = df.withColumn("_bin", label_bin(F.col(label), n_edges))
    sums = cross_sums(binned, [bucket, "_bin"], _scaled(features, label, out.shift, out.scale, out.label_shift))
    # Used more than once below: computed now, or each use would scan the data.
    sums = settled(sums, k * (n_edges - 1) * packed_size(out.width))
    roled = sums.withColumn("_pair", F.explode(roles_of_bucket(F.col(bucket), k, roles))).select(
        F.col("_pair.fold").alias("fold"), F.col("_pair.role").alias("role"), "_bin", "pos", "v"
    )
    return _filled(out, roled.groupBy("fold", "role", "_bin", "pos").agg(F.sum("v").alias("v")))


def split_sums(df: DataFrame, features: list[str], label: str, k: int = 5, fold: str = "fold", role: str = "split",
               n_edges: int = K.N_EDGES) -> FoldSums:
    """The same table for rows that already carry their fold and split."""
    out = FoldSums(features, *_centre(df, features, label), k)
    binned = df.withColumns({"fold": F.col(fold), "role": F.col(role), "_bin": label_bin(F.col(label), n_edges)})
    z = _scaled(features, label, out.shift, out.scale, out.label_shift)
    sums = cross_sums(binned, ["fold", "role", "_bin"], z)
    return _filled(out, settled(sums, k * 4 * (n_edges - 1) * packed_size(out.width)))


def _filled(out: FoldSums, sums: DataFrame) -> FoldSums:
    """Bin weights applied to (fold, role, bin) sums, the results of each (fold, role) collected."""
    # Position 0 is the row count of the bin.
    n = sums.filter("pos = 0").select("fold", "role", "_bin", (F.lit(1.0) / (F.col("v") + K.INVERSE_COUNT_EPS)).alias("_inv"))
    total = n.groupBy("fold", "role").agg(F.sum("_inv").alias("_total"))
    weights = n.join(total, ["fold", "role"]).select("fold", "role", "_bin", (F.col("_inv") / F.col("_total")).alias("_w"))
    flat = (
        sums.join(weights, ["fold", "role", "_bin"])
        .groupBy("fold", "role", "pos")
        .agg(F.sum("v").alias("v"), F.sum(F.col("v") * F.sqrt("_w")).alias("s"), F.sum(F.col("v") * F.col("_w")).alias("w"))
        .groupBy("fold", "role")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "v", "s", "w"))).alias("g"))
    )
    cells = out.k * 4 * 3 * packed_size(out.width)
    if cells > MAX_DRIVER_CELLS:
        raise ValueError(f"{out.width} columns need {cells} numbers per fold table; reduce the features")
    for r in flat.select("fold", "role", F.col("g.v").alias("v"), F.col("g.s").alias("s"), F.col("g.w").alias("w")).collect():
        out.table[(r["fold"], r["role"])] = Sums(*[unpack(r[c], out.width) for c in ("v", "s", "w")])
    return out


def sums_by_fold(rows: DataFrame, features: list[str], label: str, k: int, role: str = "train") -> FoldSums:
    """Plain cross products of rows that already carry their ``fold``."""
    out = FoldSums(features, *_centre(rows, features, label), k)
    z = _scaled(features, label, out.shift, out.scale, out.label_shift)
    # Scaled columns are expressions here.
    packed = cross_sums(rows, ["fold"], z, costly=True).groupBy("fold").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("g"))
    for r in packed.select("fold", F.col("g.v").alias("v")).collect():
        m = unpack(r["v"], out.width)
        out.table[(r["fold"], role)] = Sums(m, m, m)
    return out
