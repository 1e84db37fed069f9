"""Hyper-parameter grids as DataFrames.

A search space is a row of value lists; its grid is generated from a running
number decoded in mixed radix, so no list of combinations is built and no table is
crossed with another. Many spaces expand in parallel.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise import constants as K
from foldwise.functions.scalar import is_default_key, logspace, param_key
from foldwise.operators.sampling import order_digest

LINEAR_COLUMNS = ["eta0", "batch_size", "tol", "epochs", "learning_rate", "n_iter_no_change", "alpha", "l1_ratio"]


def expand_lists(df: DataFrame, lists: dict[str, Column], number: str = "number") -> DataFrame:
    """Every combination of the value lists of each row, numbered from 1; the last list varies fastest."""
    sized = df.withColumns({f"_l_{n}": c for n, c in lists.items()})
    total = reduce(lambda a, b: a * b, [F.size(f"_l_{n}") for n in lists])
    out = sized.withColumn("_i", F.explode(F.when(total > 0, F.sequence(F.lit(0), total - 1))))
    stride: Column = F.lit(1)
    picks = {}
    for n in reversed(list(lists)):
        at = F.floor(F.col("_i") / stride) % F.size(f"_l_{n}")
        picks[n] = F.element_at(f"_l_{n}", (at + 1).cast("int"))
        stride = stride * F.size(f"_l_{n}")
    return out.withColumns({n: picks[n] for n in lists}).withColumn(number, F.col("_i") + 1).drop(
        "_i", *[f"_l_{n}" for n in lists]
    )


def linear_grid(spaces: DataFrame, alphas: str = "alphas") -> DataFrame:
    """Grid of the penalised linear models, one space per input row, default rows included.

    ``spaces`` holds ``model`` and a list of alphas, and any key columns. The plain
    gradient model ignores the alphas, only the elastic net varies its l1 share, and
    ordinary least squares has no grid.
    """
    keys = [c for c in spaces.columns if c != alphas]

    def values(v: list) -> Column:
        return F.array(*[F.lit(x) for x in v])

    tuned = spaces.filter(F.col("model") != "ols")
    lists = {n: values(v) for n, v in K.LINEAR_LISTS.items()}
    lists["alpha"] = F.when(F.col("model") == "mb_SGD", F.array(F.lit(0.0))).otherwise(F.col(alphas))
    lists["l1_ratio"] = F.when(F.col("model") == "elasticnet", values(K.ELASTIC_L1_RATIOS)).otherwise(
        F.array(F.lit(None).cast("double"))
    )
    grid = expand_lists(tuned, lists)
    default_alpha = F.element_at(
        F.create_map(*[F.lit(x) for pair in K.LINEAR_DEFAULT_ALPHA.items() for x in pair]), F.col("model")
    )
    default = tuned.select(
        *keys, *[F.lit(K.LINEAR_DEFAULTS[n]).alias(n) for n in LINEAR_COLUMNS if n not in ("alpha", "l1_ratio")],
        default_alpha.alias("alpha"), F.lit(K.LINEAR_DEFAULTS["l1_ratio"]).alias("l1_ratio"), F.lit(0).alias("number"),
    )
    both = grid.select(*keys, *LINEAR_COLUMNS, "number").unionByName(default)
    return both.withColumn("param_key", param_key(F.col("model"), F.col("number")))


def json_grid(spaces: DataFrame, json: str = "space", model: str = "model") -> DataFrame:
    """Grid of JSON search spaces: an object of value lists per row, names in sorted order, values kept as text."""
    parsed = F.from_json(F.col(json), "map<string,array<string>>")
    entries = F.array_sort(F.map_entries(parsed))
    sized = spaces.withColumn("_e", entries).withColumn("_sizes", F.transform("_e", lambda e: F.size(e["value"])))
    total = F.aggregate("_sizes", F.lit(1), lambda a, s: a * s)
    numbered = sized.withColumn("_i", F.explode(F.when(total > 0, F.sequence(F.lit(0), total - 1))))

    def stride(i: Column) -> Column:
        return F.aggregate(F.slice("_sizes", i + 2, F.size("_sizes")), F.lit(1), lambda a, s: a * s)

    picked = F.transform(
        "_e", lambda e, i: F.struct(
            e["key"], F.element_at(e["value"], (F.floor(F.col("_i") / stride(i)) % F.size(e["value"]) + 1).cast("int"))
        )
    )
    return numbered.withColumn("params", F.map_from_entries(picked)).withColumn("number", F.col("_i") + 1).withColumn(
        "param_key", param_key(F.col(model), F.col("number"))
    ).drop("_e", "_sizes", "_i", json)


def with_default(grid: DataFrame, defaults: DataFrame) -> DataFrame:
    """Grid plus the ``hp_0`` rows of its models."""
    return grid.unionByName(defaults, allowMissingColumns=True)


def random_search(grid: DataFrame, by: list[str], share: float, seed: int, key: str = "param_key") -> DataFrame:
    """``floor(share * n)`` keys per group without replacement, in digest order."""
    g = Window.partitionBy(*by)
    ranked = grid.withColumn("_n", F.count("*").over(g)).withColumn(
        "_r", F.row_number().over(g.orderBy(order_digest([key], seed), key))
    )
    return ranked.filter(F.col("_r") <= F.floor(F.col("_n") * F.lit(share))).drop("_n", "_r")


def fold_grid(grid: DataFrame, folds: list[int]) -> DataFrame:
    """Every parameter set for every fold, generated from a fold list."""
    return grid.withColumn("fold", F.explode(F.array(*[F.lit(f) for f in folds])))


def seed_grid(grid: DataFrame, best: DataFrame, model: str = "model", drop_default: bool = True) -> DataFrame:
    """Each fold's earlier winner joins its grid as ``<model>_hp__1``; the default key leaves.

    ``grid`` has a ``fold`` column; ``best`` holds one row per (model, fold) with the
    parameter columns of the grid.
    """
    kept = grid.filter(~is_default_key(F.col("param_key"))) if drop_default else grid
    winners = best.withColumn("param_key", F.concat(F.col(model), F.lit("_hp__1")))
    return kept.unionByName(winners.select(*[c for c in kept.columns if c in winners.columns]), allowMissingColumns=True)


def resolve_params(best: DataFrame, grid: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Parameter values of the winning keys."""
    return best.join(grid, on or ["model", "param_key"])


def alpha_sweep_values(low: float = -5.0, high: float = 0.0, n: int = 100) -> Column:
    """Log-spaced list of penalties."""
    return logspace(F.lit(low), F.lit(high), F.lit(n))


def draw_space(trials: DataFrame, trial_cols: list[str], seed: int,
               space: list[tuple[str, float, float, bool, bool]] | None = None) -> DataFrame:
    """One random point of a search space per trial row, decided by seed, trial and parameter name.

    Ranges are (name, low, high, log, integer); ``log`` draws the logarithm evenly.
    """
    out = {}
    for name, low, high, log, integer in space or K.BOOSTED_SPACE:
        text = F.concat_ws("|", F.lit(str(seed)), F.lit(name), *[F.col(c).cast("string") for c in trial_cols])
        u = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(16**13)
        if integer:
            out[name] = F.floor(u * (high - low + 1) + low).cast("int")
        elif log:
            out[name] = F.pow(F.lit(high / low), u) * low
        else:
            out[name] = u * (high - low) + low
    return trials.withColumns(out)


def network_space(configs: DataFrame, folds: list[int], widths: Column) -> DataFrame:
    """Network search space: (layers, optimizer) configurations for every fold with their hidden widths."""
    return fold_grid(configs, folds).withColumn("widths", widths)
