"""Feature scalers: fitted per group, applied by column name.

A fitted scaler is a table with one row per group and one ``params`` map from
column name to its numbers, so values never lose their names and any two scalers
can be chained. Statistics of a fold's training rows are merged from bucket
statistics where they can be (mean, deviation, range); quantiles and the power
transform need the rows themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.functions.scalar import ACKLAM, ACKLAM_CUT, inverse_normal
from foldwise.operators.folds import assign_roles, roles_of_bucket
from foldwise.operators.joins import BROADCAST_ROWS, join_small, single_key
from foldwise.operators.quantiles import exact_quantiles, fold_quantiles
from foldwise.operators.ranges import asof_join
from foldwise.session import settled

STATELESS = {"LogScaler", "IdentityScaler"}
AFFINE = {"StandardScaler", "MinMaxScaler", "MaxAbsScaler", "RobustScaler"}
SCALERS = [
    "RobustScaler", "StandardScaler", "PowerTransformer", "MaxAbsScaler",
    "MinMaxScaler", "QuantileTransformer", "LogScaler", "IdentityScaler",
]
# Quantile transform grid and output limit.
N_QUANTILES = 1000
NORMAL_LIMIT = 5.199337582605575
NORMAL_EDGE = 1e-7
QUANTILE_GRID = [i / (N_QUANTILES - 1) for i in range(N_QUANTILES)]
QUARTILES = [0.25, 0.5, 0.75]


def _unit_if_zero(c: Column) -> Column:
    return F.when(c == 0, 1.0).otherwise(c)


def _params(pairs: list[tuple[str, Column]]) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(c) for c, _ in pairs]), F.array(*[s for _, s in pairs]))


def _column_stats(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(
        *[
            F.struct(
                F.count(c).alias("n"), F.avg(c).alias("mean"), (F.var_pop(c) * F.count(c)).alias("m2"),
                F.min(c).alias("lo"), F.max(c).alias("hi"),
            ).alias(c)
            for c in cols
        ]
    )


def _merge_stats(stats: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """Statistics of a few buckets merged by the exact rule for central moments."""
    return stats.groupBy(*by).agg(*[F.collect_list(c).alias(c) for c in cols]).select(
        *by,
        *[
            F.aggregate(
                c,
                F.struct(
                    F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"),
                    F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"),
                ),
                lambda a, b: F.struct(
                    (a["n"] + b["n"]).alias("n"),
                    (a["mean"] + (b["mean"] - a["mean"]) * b["n"] / F.greatest(a["n"] + b["n"], F.lit(1).cast("long"))).alias("mean"),
                    (a["m2"] + b["m2"] + (b["mean"] - a["mean"]) ** 2 * a["n"] * b["n"]
                     / F.greatest(a["n"] + b["n"], F.lit(1).cast("long"))).alias("m2"),
                    F.least(a["lo"], b["lo"].cast("double")).alias("lo"),
                    F.greatest(a["hi"], b["hi"].cast("double")).alias("hi"),
                ),
            ).alias(c)
            for c in cols
        ],
    )


def _from_stats(stats: DataFrame, by: list[str], cols: list[str], kind: str) -> DataFrame:
    def one(c: str) -> Column:
        s = F.col(c)
        if kind == "StandardScaler":
            shift, scale = s["mean"], F.sqrt(s["m2"] / s["n"])
        elif kind == "MinMaxScaler":
            shift, scale = s["lo"], s["hi"] - s["lo"]
        else:
            shift, scale = F.lit(0.0), F.greatest(F.abs(s["lo"]), F.abs(s["hi"]))
        return F.array(shift.cast("double"), _unit_if_zero(scale.cast("double")))

    return stats.select(*by, _params([(c, one(c)) for c in cols]).alias("params"))


def _from_quantiles(q: DataFrame, by: list[str]) -> DataFrame:
    at = {p: F.max(F.when(F.col("prob") == p, F.col("value"))) for p in (0.25, 0.5, 0.75)}
    per = q.groupBy(*by, "column").agg(F.array(at[0.5], _unit_if_zero(at[0.75] - at[0.25])).alias("p"))
    return per.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("column", "p"))).alias("params"))


def yeo_johnson(x: Column, lam: Column) -> Column:
    """Yeo-Johnson power transform for a given lambda."""
    two = F.lit(2.0) - lam
    positive = F.when(F.abs(lam) < 1e-12, F.log1p(x)).otherwise((F.pow(x + 1.0, lam) - 1.0) / F.when(F.abs(lam) < 1e-12, 1.0).otherwise(lam))
    negative = F.when(F.abs(two) < 1e-12, -F.log1p(-x)).otherwise(-(F.pow(F.lit(1.0) - x, two) - 1.0) / F.when(F.abs(two) < 1e-12, 1.0).otherwise(two))
    return F.when(x >= 0, positive).otherwise(negative)


def value_counts(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """(by, c, x, n): how many rows of a group hold which value of column number ``c``."""
    values = F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("x")) for i, c in enumerate(cols)])
    return df.select(*by, F.inline(values)).groupBy(*by, "c", "x").agg(F.count("*").alias("n"))


def fit_power(df: DataFrame, by: list[str], cols: list[str], groups: int | None = None,
              span: float = 5.0, points: int = 11, tolerance: float = 0.01, rounds: int = 60) -> DataFrame:
    """Lambda of largest likelihood per column, then mean and deviation of the transformed values.

    One round scores a batch of lambdas per column in one scan of the distinct values of each group. A best lambda at the end of its
    bracket moves and widens the bracket; one inside it narrows the bracket to its
    neighbours, around the top of the parabola through the three of them, until it is known
    to ``tolerance``. A likelihood without a top within ``rounds`` is an error, not a result.
    """
    return _power(value_counts(df, by, cols), by, cols, groups, span, points, tolerance, rounds)


def _power(counts: DataFrame, by: list[str], cols: list[str], groups: int | None, span: float = 5.0, points: int = 11,
           tolerance: float = 0.01, rounds: int = 60) -> DataFrame:
    """``fit_power`` of rows given as counts of values."""
    counts = counts.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _power_of_counts(counts.withColumn("_one", single_key()), by, cols, groups, span, points, tolerance, rounds)
    finally:
        counts.unpersist()


def _power_of_counts(rows: DataFrame, by: list[str], cols: list[str], groups: int | None, span: float, points: int, tolerance: float, rounds: int) -> DataFrame:
    keys = ["_one", *by]
    groups = groups if by else 1
    bound = None if groups is None else groups * len(cols)
    # Values are taken about one of their own near the mean, so that squares of sums lose no digits and a constant column has no spread at all.
    means = rows.groupBy(*keys, "c").agg((F.sum(F.col("n") * F.col("x")) / F.sum(F.when(F.col("x").isNotNull(), F.col("n")))).alias("_m"))
    middles = join_small(rows, settled(means, bound), [*keys, "c"], "inner", bound).groupBy(*keys, "c").agg(F.min_by("x", F.abs(F.col("x") - F.col("_m"))).alias("ref"))
    middles = settled(middles, bound)
    state = middles.select(*keys, "c", F.lit(0.0).alias("mid"), F.lit(span).alias("half"))

    def scored(state: DataFrame) -> DataFrame:
        tries = F.array_distinct(F.transform(
            F.sequence(F.lit(0), F.lit(points - 1)),
            lambda i: F.col("mid") + F.col("half") * (i * 2.0 / (points - 1) - 1.0),
        ))
        tried = state.join(middles, [*keys, "c"]).select(*keys, "c", F.transform(tries, lambda lam: F.struct(lam.alias("lam"), yeo_johnson(F.col("ref"), lam).alias("at"))).alias("_t"))
        spread = join_small(rows, tried, [*keys, "c"], "inner", bound).select(*keys, "c", "n", "x", F.inline("_t"))
        off = yeo_johnson(F.col("x"), F.col("lam")) - F.col("at")
        sums = spread.withColumn("_off", off).groupBy(*keys, "c", "lam").agg(
            F.sum(F.when(F.col("_off").isNotNull(), F.col("n"))).alias("n"), F.first("at").alias("at"), F.sum(F.col("n") * F.col("_off")).alias("s"),
            F.sum(F.col("n") * F.col("_off") * F.col("_off")).alias("q"), F.sum(F.col("n") * F.signum("x") * F.log1p(F.abs("x"))).alias("jac"),
        )
        off = F.col("s") / F.col("n")
        return sums.select(*keys, "c", "lam", "n", "jac", (F.col("at") + off).alias("mean"), F.greatest(F.col("q") / F.col("n") - off * off, F.lit(0.0)).alias("var"))

    for _ in range(rounds):
        like = F.when(
            # A variance that overflowed is no candidate; NaN counts as above infinity.
            (F.col("var") > 0) & (F.col("var") < float("inf")), -F.col("n") / 2 * F.log("var") + (F.col("lam") - 1) * F.col("jac")
        ).otherwise(F.lit(float("-inf")))
        w = Window.partitionBy(*keys, "c").orderBy("lam")
        tried = scored(state).withColumn("_l", like).withColumns(
            {"_a": F.lag("_l").over(w), "_z": F.lead("_l").over(w), "_h": F.col("lam") - F.lag("lam").over(w)}
        )
        bend = F.col("_a") - 2 * F.col("_l") + F.col("_z")
        # A missing or infinite neighbour, or a flat top, keeps the grid point.
        move = F.col("_h") / 2 * (F.col("_a") - F.col("_z")) / F.when(bend < 0, bend)
        move = F.when(F.abs(move) <= F.col("_h"), move).otherwise(0.0)
        end = (F.col("_a").isNull() | F.col("_z").isNull()) & (F.col("_l") > float("-inf"))
        best = tried.groupBy(*keys, "c").agg(F.max_by(F.struct((F.col("lam") + move).alias("mid"), end.alias("end")), "_l").alias("_m"))
        half = F.when(F.col("_m.end"), F.col("half") * 2.0).otherwise(F.col("half") * 2.0 / (points - 1))
        found = best.join(state.select(*keys, "c", "half"), [*keys, "c"])
        state = settled(found.select(*keys, "c", F.col("_m.mid").alias("mid"), half.alias("half")), bound)
        widest = state.agg(F.max("half")).first()[0]
        if widest is None or widest <= tolerance:
            break
    else:
        raise ValueError(f"no lambda of largest likelihood after {rounds} rounds")
    # The last batch holds its middle point, whose moments standardise the output.
    final = scored(state.withColumn("half", F.lit(0.0)))
    names = F.array(*[F.lit(c) for c in cols])
    per = settled(final, bound).select(
        *by, F.element_at(names, F.col("c") + 1).alias("column"),
        F.array("lam", "mean", _unit_if_zero(F.sqrt("var"))).alias("p"),
    )
    return per.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("column", "p"))).alias("params"))


def _from_grid(q: DataFrame, by: list[str]) -> DataFrame:
    per = q.groupBy(*by, "column").agg(F.transform(F.array_sort(F.collect_list(F.struct("prob", "value"))), lambda e: e["value"]).alias("p"))
    return per.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("column", "p"))).alias("params"))


def fit_quantile(df: DataFrame, by: list[str], cols: list[str], groups: int | None = None) -> DataFrame:
    """A thousand exact quantiles of all rows per column, in place of those of a 10,000-row subsample."""
    return _from_grid(exact_quantiles(df, by, cols, QUANTILE_GRID, groups), by)


def fit_scaler(df: DataFrame, by: list[str], cols: list[str], kind: str, groups: int | None = None) -> DataFrame | None:
    """Parameters per group; nothing to fit for a stateless scaler."""
    if kind in STATELESS:
        return None
    if kind == "RobustScaler":
        return _from_quantiles(exact_quantiles(df, by, cols, QUARTILES, groups), by)
    if kind == "PowerTransformer":
        return fit_power(df, by, cols, groups)
    if kind == "QuantileTransformer":
        return fit_quantile(df, by, cols, groups)
    if kind not in AFFINE:
        raise ValueError(f"unknown scaler {kind}")
    return _from_stats(_column_stats(df, by, cols), by, cols, kind)


def fit_fold_scaler(df: DataFrame, cols: list[str], kind: str, role: str = "train", bucket: str = "bucket",
                    k: int = 5) -> DataFrame | None:
    """Parameters per fold, fitted on the rows of one role."""
    if kind in STATELESS:
        return None
    if kind in AFFINE - {"RobustScaler"}:
        stats = _column_stats(df, [bucket], cols)
        roled = stats.withColumn("_pair", F.explode(roles_of_bucket(F.col(bucket), k, [role]))).withColumn(
            "fold", F.col("_pair.fold")
        )
        return _from_stats(_merge_stats(roled, ["fold"], cols), ["fold"], cols, kind)
    if kind == "RobustScaler":
        return _from_quantiles(fold_quantiles(df, cols, QUARTILES, role, bucket, k), ["fold"])
    if kind == "QuantileTransformer":
        return _from_grid(fold_quantiles(df, cols, QUANTILE_GRID, role, bucket, k), ["fold"])
    if kind == "PowerTransformer":
        counts = assign_roles(value_counts(df, [bucket], cols), bucket, k, [role]).groupBy("fold", "c", "x").agg(F.sum("n").alias("n"))
        return _power(counts, ["fold"], cols, k)
    raise ValueError(f"unknown scaler {kind}")


def _quantile_shares(df: DataFrame, params: DataFrame, by: list[str], cols: list[str], groups: int | None) -> DataFrame:
    """Position of each value among the quantiles of its group, linear between them, ties at their middle; an as-of join per column."""
    key = [] if by else ["_one"]
    grid = params.select(*by, *[F.lit(0).alias(k) for k in key], F.explode("params").alias("_c", "_q"))
    entries = grid.select(*by, *key, "_c", (F.size("_q") - 1).alias("last"), F.posexplode("_q").alias("i", "q")).groupBy(*by, *key, "_c", "last", "q").agg(
        F.min("i").alias("first"), F.max("i").alias("end")
    )
    w = Window.partitionBy(*by, *key, "_c").orderBy("q")
    bound = (groups if by else 1) and (groups if by else 1) * len(cols) * N_QUANTILES
    entries = settled(entries.withColumns({"next": F.lead("q").over(w)}), bound)
    out = df.withColumns({k: F.lit(0) for k in key})
    for c in cols:
        x, e = F.col(c).cast("double"), F.col("_entry")
        out = asof_join(out, entries.filter(F.col("_c") == c).drop("_c"), [*by, *key], c, "q", "_entry", None if bound is None else bound // len(cols))
        share = (
            F.when(x.isNull() | F.isnan(x), x).when(e.isNull(), 0.0)
            .when(x == e["q"], (e["first"] + e["end"]) / 2 / e["last"])
            .when(e["next"].isNull(), 1.0)
            .otherwise((e["end"] + (x - e["q"]) / (e["next"] - e["q"])) / e["last"])
        )
        out = out.withColumn(c, share).drop("_entry")
    return out.drop(*key)


def normal_scores(share: np.ndarray) -> np.ndarray:
    """``inverse_normal`` of an array of positions, kept off 0 and 1 and within the output limit; NaN stays."""
    a, b, c, d = (np.array(x) for x in ACKLAM)
    p = np.clip(share, NORMAL_EDGE, 1 - NORMAL_EDGE)
    q = p - 0.5
    r = q * q
    z = np.polyval(a, r) * q / np.polyval(b, r)
    for tail, t, sign in ((p < ACKLAM_CUT, p, 1.0), (p > 1 - ACKLAM_CUT, 1.0 - p, -1.0)):
        t = np.sqrt(np.log(t[tail]) * -2.0)
        z[tail] = sign * np.polyval(c, t) / np.polyval(d, t)
    return np.clip(z, -NORMAL_LIMIT, NORMAL_LIMIT)


def _placed(df: DataFrame, params: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """The normal quantile of that position, for few groups, whose quantiles go out with the tasks: a search in a sorted array per value.

    As a column, the approximation of three features together is more code than the compiler takes, and is interpreted row by row.
    """
    tables: dict[tuple, dict[str, tuple[np.ndarray, ...]]] = {}
    for r in params.select(*by, "params").collect():
        tables[tuple(r[b] for b in by)] = {c: (*(a for a in np.unique(np.array(q, float), return_index=True)), len(q)) for c, q in r["params"].items()}
    df = df.withColumns({c: F.col(c).cast("double") for c in cols})
    names = df.columns

    def share(x: np.ndarray, table: tuple[np.ndarray, ...]) -> np.ndarray:
        q, first, size = table
        end = np.append(first[1:], size) - 1
        at = np.searchsorted(q, x, "right") - 1
        low = np.maximum(at, 0)
        above = q[np.minimum(low + 1, len(q) - 1)]
        with np.errstate(divide="ignore", invalid="ignore"):
            between = (end[low] + (x - q[low]) / (above - q[low])) / (size - 1)
        between = np.where(low + 1 == len(q), 1.0, between)
        return np.where(np.isnan(x), x, np.where(at < 0, 0.0, np.where(x == q[low], (first[low] + end[low]) / 2 / (size - 1), between)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            # One number per group of the batch; a null key is a group, of no entries.
            code, groups = np.zeros(rows, np.int64), [()]
            for b in by:
                part = batch.column(b).dictionary_encode()
                named = [*part.dictionary.to_pylist(), None]
                code = code * len(named) + part.indices.fill_null(len(named) - 1).to_numpy(zero_copy_only=False)
                groups = [(*g, v) for g in groups for v in named]
            values = {c: batch.column(c).to_numpy(zero_copy_only=False).copy() for c in cols}
            stay = np.ones(rows, bool)
            for g in np.flatnonzero(np.bincount(code, minlength=len(groups))):
                mine = code == g
                table = tables.get(groups[g], {})
                for c in cols:
                    if c in table:
                        values[c][mine] = normal_scores(share(values[c][mine], table[c]))
                    else:
                        # A value of a group without entries has no place; a missing one needs none.
                        stay &= ~mine | np.isnan(values[c])
            columns = [pa.array(values[n], mask=np.asarray(batch.column(n).is_null())) if n in values else batch.column(n) for n in names]
            out = pa.RecordBatch.from_arrays(columns, names=names)
            yield out if stay.all() else out.filter(pa.array(stay))

    schema = T.StructType([T.StructField(f.name, T.DoubleType() if f.name in cols else f.dataType) for f in df.schema])
    return df.mapInArrow(place, schema)


def apply_scaler(df: DataFrame, params: DataFrame | None, by: list[str], cols: list[str], kind: str,
                 groups: int | None = None) -> DataFrame:
    """Scaled columns under their own names; every other column passes through."""
    if kind == "IdentityScaler":
        return df
    if kind == "LogScaler":
        return df.withColumns({c: F.log1p(F.col(c).cast("double")) for c in cols})
    if kind == "QuantileTransformer":
        if not by or (groups is not None and groups * len(cols) * N_QUANTILES <= BROADCAST_ROWS):
            return _placed(df, params, by, cols)

        def normal(c: str) -> Column:
            z = inverse_normal(F.least(F.greatest(F.col(c), F.lit(NORMAL_EDGE)), F.lit(1 - NORMAL_EDGE)))
            return F.when(F.isnan(c), F.col(c)).otherwise(F.least(F.greatest(z, F.lit(-NORMAL_LIMIT)), F.lit(NORMAL_LIMIT)))

        shares = _quantile_shares(df, params, by, cols, groups).withColumns({c: F.when(F.col(c).isNotNull(), normal(c)) for c in cols})
        return shares.select(*df.columns)
    # Numbers of a group as columns, taken out of the map once a group and not once a use.
    width = 3 if kind == "PowerTransformer" else 2
    at = {(c, j): f"_p{i}_{j}" for i, c in enumerate(cols) for j in range(width)}
    flat = params.select(*by, *[F.col("params")[c][j].alias(n) for (c, j), n in at.items()])
    if by:
        joined = join_small(df, flat, by, "inner", groups)
    else:
        key = single_key().alias("_k")
        joined = join_small(df.select("*", key), flat.select("*", key), ["_k"], "inner", 1).drop("_k")

    def p(c: str, j: int) -> Column:
        return F.col(at[(c, j)])

    if kind == "PowerTransformer":
        done = {c: (yeo_johnson(F.col(c).cast("double"), p(c, 0)) - p(c, 1)) / p(c, 2) for c in cols}
    else:
        done = {c: (F.col(c) - p(c, 0)) / p(c, 1) for c in cols}
    return joined.withColumns(done).drop(*at.values())


def scale_folds(df: DataFrame, cols: list[str], kinds: list[str], roles: list[str], fit_role: str = "train",
                bucket: str = "bucket", k: int = 5, fit_df: DataFrame | None = None) -> DataFrame:
    """Rows of the wanted roles, scaled by one or more scalers fitted on each fold's training rows."""
    out = assign_roles(df, bucket, k, roles)
    train = assign_roles(fit_df if fit_df is not None else df, bucket, k, [fit_role])
    for i, kind in enumerate(kinds):
        if i == 0:
            params = fit_fold_scaler(fit_df if fit_df is not None else df, cols, kind, fit_role, bucket, k)
        else:
            params = fit_scaler(train, ["fold"], cols, kind, groups=k)
        out = apply_scaler(out, params, ["fold"], cols, kind, groups=k)
        if i + 1 < len(kinds):
            train = apply_scaler(train, params, ["fold"], cols, kind, groups=k)
    return out
