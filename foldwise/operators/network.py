"""Analytics on network searches: histories, stopping rules, winners, gradients.

Training itself is not part of the package; these operators work on the histories
and predictions a training run leaves behind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise import constants as K
from foldwise.operators.joins import attach_winner, single_key
from foldwise.operators.metrics import metrics, pooled_metrics
from foldwise.operators.selection import best_per_fold
from foldwise.session import cut_lineage

BLOCK_EPOCHS = 50_000


def history_long(df: DataFrame, history: str = "history") -> DataFrame:
    """Map of metric to values per epoch as rows (metric, epoch, value)."""
    rest = [c for c in df.columns if c != history]
    return df.select(*rest, F.explode(history).alias("metric", "_v")).select(
        *rest, "metric", F.posexplode("_v").alias("epoch", "value")
    )


def history_map(long: DataFrame, by: list[str]) -> DataFrame:
    """Rows (metric, epoch, value) as one map per network; a run has at most a few hundred epochs."""
    series = long.groupBy(*by, "metric").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("epoch", "value"))), lambda p: p["value"]).alias("_v")
    )
    return series.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("metric", "_v"))).alias("history"))


def best_epoch(history: DataFrame, by: list[str], epoch: str = "epoch", loss: str = "val_loss") -> DataFrame:
    """Epoch of the lowest validation loss; the earliest one on a tie."""
    real = history.filter(F.col(loss).isNotNull() & ~F.isnan(loss))
    return real.groupBy(*by).agg(
        F.min_by(F.col(epoch), F.struct(F.col(loss), F.col(epoch))).alias("best_epoch"), F.min(loss).alias("best_loss")
    )


def _replay(history: DataFrame, by: list[str], epoch: str, loss: str, start: Column,
            step: Callable[[Column, Column], Column], block: int) -> DataFrame:
    """Run a per-series state over the epochs in order, one block of epochs per pass.

    A pass gathers at most ``block`` epochs of a series; longer histories carry their
    state to the next pass through a checkpointed table.
    """
    first, last = history.agg(F.min(epoch), F.max(epoch)).first()
    state = None
    if first is None:
        return history.select(*by).distinct().withColumn("state", start)
    for low in range(first, last + 1, block):
        part = history.filter(F.col(epoch).between(low, low + block - 1)).groupBy(*by).agg(
            F.array_sort(F.collect_list(F.struct(F.col(epoch).cast("long").alias("epoch"), F.col(loss).cast("double").alias("loss")))).alias("_e")
        )
        if state is None:
            state = part.select(*by, F.aggregate("_e", start, step).alias("state"))
        else:
            both = cut_lineage(state).join(part, by, "full_outer").withColumn("state", F.coalesce("state", start))
            state = both.select(*by, F.when(F.col("_e").isNull(), F.col("state")).otherwise(F.aggregate("_e", F.col("state"), step)).alias("state"))
    return state


def early_stop(history: DataFrame, by: list[str], epoch: str = "epoch", loss: str = "val_loss",
               min_delta: float = K.EARLY_STOP_MIN_DELTA, patience: int = K.EARLY_STOP_PATIENCE,
               block: int = BLOCK_EPOCHS) -> DataFrame:
    """Where training stops and which epoch is restored.

    An epoch improves when its loss is below the best by more than ``min_delta``;
    ``patience`` epochs without improvement stop the run.
    """
    start = F.struct(
        F.lit(float("inf")).alias("best"), F.lit(None).cast("long").alias("best_epoch"),
        F.lit(0).alias("wait"), F.lit(None).cast("long").alias("stop_epoch"),
    )

    def step(s: Column, e: Column) -> Column:
        better = e["loss"] < s["best"] - min_delta
        wait = F.when(better, 0).otherwise(s["wait"] + 1)
        moved = F.struct(
            F.when(better, e["loss"]).otherwise(s["best"]).alias("best"),
            F.when(better, e["epoch"]).otherwise(s["best_epoch"]).alias("best_epoch"),
            wait.alias("wait"),
            F.when(wait >= patience, e["epoch"]).alias("stop_epoch"),
        )
        return F.when(s["stop_epoch"].isNotNull(), s).otherwise(moved)

    done = _replay(history, by, epoch, loss, start, step, block)
    return done.select(*by, "state.best_epoch", F.col("state.best").alias("best_loss"), "state.stop_epoch")


def lr_plateau(history: DataFrame, by: list[str], initial: float = 0.001, epoch: str = "epoch", loss: str = "val_loss",
               factor: float = K.PLATEAU_FACTOR, patience: int = K.PLATEAU_PATIENCE,
               min_delta: float = K.PLATEAU_MIN_DELTA, floor: float = K.PLATEAU_MIN_LR,
               block: int = BLOCK_EPOCHS) -> DataFrame:
    """Learning rate after the run and the number of cuts the plateau rule made."""
    start = F.struct(
        F.lit(float("inf")).alias("best"), F.lit(0).alias("wait"),
        F.lit(float(initial)).alias("rate"), F.lit(0).alias("cuts"), F.lit(None).cast("long").alias("last_cut"),
    )

    def step(s: Column, e: Column) -> Column:
        better = e["loss"] < s["best"] - min_delta
        wait = F.when(better, 0).otherwise(s["wait"] + 1)
        cut = (wait >= patience) & (s["rate"] > floor)
        return F.struct(
            F.when(better, e["loss"]).otherwise(s["best"]).alias("best"),
            F.when(cut, 0).otherwise(wait).alias("wait"),
            F.when(cut, F.greatest(s["rate"] * factor, F.lit(floor))).otherwise(s["rate"]).alias("rate"),
            (s["cuts"] + F.when(cut, 1).otherwise(0)).alias("cuts"),
            F.when(cut, e["epoch"]).otherwise(s["last_cut"]).alias("last_cut"),
        )

    done = _replay(history, by, epoch, loss, start, step, block)
    return done.select(*by, F.col("state.rate").alias("final_rate"), "state.cuts", "state.last_cut")


def network_report(moments: DataFrame, fold: str, config: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all results, winner per fold with pooled metrics, all results joined to the winners).

    ``moments`` are bin moments of the test predictions per (fold, configuration). They
    are kept (a hundred rows per configuration), so the predictions are read once.
    """
    moments = cut_lineage(moments)
    results = metrics(moments, [fold, *config])
    best = best_per_fold(results, [fold], "weighted_r2", config)
    won = moments.join(best.select(fold, *config), [fold, *config], "left_semi")
    key = single_key().alias("_k")
    total = pooled_metrics(won.select("*", key), ["_k"]).select(
        "_k", F.col("mse").alias("total_mse"), F.col("r2").alias("total_r2"),
        F.col("weighted_mse").alias("total_wmse"), F.col("weighted_r2").alias("total_wr2"),
    )
    winners = best.select("*", key).join(total, "_k").drop("_k")
    marked = winners.select(fold, *config, "total_mse", "total_r2", "total_wmse", "total_wr2")
    return results, winners, attach_winner(results, marked, [fold, *config])


def gradient_summary(df: DataFrame, by: list[str], values: str) -> DataFrame:
    """Mean size and norm per weight from arrays of gradient values; arrays are summed row by row, not exploded."""
    v = F.transform(values, lambda x: x.cast("double"))
    size = F.aggregate(v, F.lit(0.0), lambda a, x: a + F.abs(x))
    square = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    return df.groupBy(*by).agg(
        F.sum(F.size(values)).cast("long").alias("n"),
        (F.sum(size) / F.sum(F.size(values))).alias("mean_abs"),
        F.sqrt(F.sum(square)).alias("l2_norm"),
        F.min(F.array_min(v)).alias("low"),
        F.max(F.array_max(v)).alias("high"),
    )


def layer_listing(df: DataFrame, widths: str = "widths", first: int = 512, last: int = 1) -> DataFrame:
    """Dense layers with their role: the input layer, the hidden widths, the output layer."""
    rest = [c for c in df.columns if c != widths]
    layers = F.concat(F.array(F.lit(first)), F.col(widths), F.array(F.lit(last)))
    listed = df.select(*rest, F.size(layers).alias("_n"), F.posexplode(layers).alias("position", "neurons"))
    return listed.withColumn(
        "role", F.when(F.col("position") == 0, "Input").when(F.col("position") == F.col("_n") - 1, "Output").otherwise("Hidden")
    ).withColumn("position", F.col("position") + 1).drop("_n")
