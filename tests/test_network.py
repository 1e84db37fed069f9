import random

import pytest
from pyspark.sql import functions as F

from foldwise.functions.scalar import hidden_widths, linear_funnel, log_funnel, run_stamp
from foldwise.operators import network

SCHEMA = "s string, epoch int, val_loss double"


def brute_stop(losses, delta=1e-6, patience=10):
    best, at, wait = float("inf"), None, 0
    for e, loss in enumerate(losses):
        if loss < best - delta:
            best, at, wait = loss, e, 0
        else:
            wait += 1
            if wait >= patience:
                return at, e
    return at, None


def brute_rate(losses, rate=0.001):
    best, wait, cuts = float("inf"), 0, 0
    for loss in losses:
        if loss < best - 1e-4:
            best, wait = loss, 0
        else:
            wait += 1
            if wait >= 10 and rate > 1e-6:
                rate, wait, cuts = max(rate * 0.5, 1e-6), 0, cuts + 1
    return rate, cuts


@pytest.fixture(scope="module")
def series():
    rng = random.Random(0)
    out = {f"walk{i}": [rng.random() for _ in range(rng.randint(1, 60))] for i in range(8)}
    out["falling"] = [1 - i / 100 for i in range(40)]
    out["flat"] = [1 - i / 100 for i in range(20)] + [0.8] * 15
    out["tiny gain"] = [0.5] + [0.5 - 9e-7] * 12
    out["nan"] = [0.5, float("nan"), 0.4] + [float("nan")] * 12
    out["very long flat"] = [0.5] * 150
    return out


@pytest.fixture(scope="module")
def frame(spark, series):
    return spark.createDataFrame([(s, e, v) for s, vs in series.items() for e, v in enumerate(vs)], SCHEMA).persist()


@pytest.mark.parametrize("block", [1000, 7])
def test_early_stop_in_one_pass_and_in_blocks(frame, series, block):
    got = {r["s"]: (r["best_epoch"], r["stop_epoch"]) for r in network.early_stop(frame, ["s"], block=block).collect()}
    assert got == {s: brute_stop(v) for s, v in series.items()}
    assert got["flat"] == (19, 30) if series["flat"][20] >= series["flat"][19] else True
    assert got["tiny gain"] == (0, 10)


@pytest.mark.parametrize("block", [1000, 11])
def test_plateau_in_one_pass_and_in_blocks(frame, series, block):
    got = {r["s"]: (r["final_rate"], r["cuts"]) for r in network.lr_plateau(frame, ["s"], block=block).collect()}
    assert got == {s: brute_rate(v) for s, v in series.items()}


def test_best_epoch_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([("a", 0, 0.3), ("a", 1, 0.1), ("a", 2, 0.1), ("a", 3, float("nan"))], SCHEMA)
    r = network.best_epoch(df, ["s"]).first()
    assert (r["best_epoch"], r["best_loss"]) == (1, 0.1)


def test_history_round_trip(spark):
    df = spark.createDataFrame([(1, {"loss": [3.0, 2.0], "mae": [1.0]})], "fold int, history map<string,array<double>>")
    long = network.history_long(df)
    assert sorted(tuple(r) for r in long.collect()) == [(1, "loss", 0, 3.0), (1, "loss", 1, 2.0), (1, "mae", 0, 1.0)]
    assert network.history_map(long, ["fold"]).first()["history"] == {"loss": [3.0, 2.0], "mae": [1.0]}


def funnel(n):
    if n == 1:
        return [256]
    return [max(8 * round((256 + i * (8 - 256) / (n - 1)) / 8), 8) for i in range(n)]


def test_funnels(spark):
    df = spark.createDataFrame([(n,) for n in range(1, 40)], "n int")
    got = {r["n"]: r for r in df.select("n", linear_funnel(F.col("n")).alias("lin"), log_funnel(F.col("n")).alias("log")).collect()}
    for n in range(1, 40):
        assert got[n]["lin"] == funnel(n)
    assert got[1]["log"] == [256] and got[6]["log"] == [256, 128, 64, 32, 16, 8]


def test_explicit_widths(spark):
    table = F.create_map(F.lit(2), F.array(F.lit(64), F.lit(8)), F.lit(12), F.array(F.lit(1)))
    df = spark.createDataFrame([(2,), (3,), (12,)], "n int")
    got = {r["n"]: r["w"] for r in df.select("n", hidden_widths(F.col("n"), table).alias("w")).collect()}
    assert got == {2: [64, 8], 3: funnel(3), 12: funnel(12)}


def test_layer_listing(spark):
    df = spark.createDataFrame([(1, [64, 8])], "id int, widths array<int>")
    got = sorted((r["position"], r["neurons"], r["role"]) for r in network.layer_listing(df).collect())
    assert got == [(1, 512, "Input"), (2, 64, "Hidden"), (3, 8, "Hidden"), (4, 1, "Output")]


def test_run_stamp(spark):
    assert len(spark.range(1).select(run_stamp().alias("t")).first()["t"]) == 15
