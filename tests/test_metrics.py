import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.operators import metrics
from foldwise.operators.distribution import density_histogram, histogram, kde


def frame(spark, y, p):
    return spark.createDataFrame([("m", float(a), float(b)) for a, b in zip(y, p)], "model string, y double, p double")


def one(spark, y, p):
    return metrics.score(frame(spark, y, p), ["model"], "y", "p").first()


def slow(y, p):
    y, p = np.asarray(y), np.asarray(p)
    bins = np.minimum(np.floor(y * 100 + 1e-9).astype(int), 99)
    n = np.bincount(bins, minlength=100)
    w = 1 / (n[bins] + 1e-6)
    mw = (w * y).sum() / w.sum()
    return {
        "mse": ((y - p) ** 2).mean(), "mae": np.abs(y - p).mean(), "r2": 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum(),
        "weighted_mse": (w * (y - p) ** 2).sum() / w.sum(), "weighted_r2": 1 - (w * (y - p) ** 2).sum() / (w * (y - mw) ** 2).sum(),
    }


def test_metrics_equal_row_formulas(spark):
    rng = np.random.default_rng(0)
    y = rng.beta(0.5, 3, 3000)
    p = y + rng.normal(0, 0.1, 3000)
    got = one(spark, y, p)
    for name, value in slow(y, p).items():
        assert got[name] == pytest.approx(value, rel=1e-9)


def test_zero_denominator_rules(spark):
    assert one(spark, [0.3] * 4, [0.3] * 4)["r2"] == 1.0
    missed = one(spark, [0.3] * 4, [0.3, 0.3, 0.3, 0.4])
    assert missed["r2"] == 0.0 and missed["weighted_r2"] == 0.0
    assert math.isnan(one(spark, [0.3], [0.2])["r2"])


@pytest.mark.parametrize("bad", [1e151, float("nan"), float("inf"), float("-inf")])
def test_guard(spark, bad):
    got = one(spark, [0.1, 0.2, 0.9], [0.1, bad, 0.3])
    assert got["bad"] == 1 and all(math.isnan(got[m]) for m in metrics.METRICS)


def test_per_bin_r2_needs_three_rows(spark):
    y = [0.005, 0.105, 0.106, 0.205, 0.206, 0.207]
    got = {r["bin"]: r for r in metrics.per_bin_metrics(frame(spark, y, [0.1] * 6), ["model"], "y", "p").collect()}
    assert [got[b]["count"] for b in (1, 11, 21)] == [1, 2, 3]
    assert got[1]["r2"] is None and got[11]["r2"] is None and got[21]["r2"] is not None
    assert got[21]["centre"] == pytest.approx(0.205)


def test_global_weights_leave_out_rows_outside(spark):
    y = [0.0, 0.005, 1.0, 1.2]
    df = spark.createDataFrame([("m", v, 0.5) for v in y], "model string, y double, p double")
    moments = metrics.bin_moments(df, ["model"], "y", "p", "report")
    assert {r["bin"] for r in moments.collect()} == {0, 1, 101, None}
    got = metrics.global_metrics(df, ["model"], "y", "p").first()
    assert got["n"] == 4
    assert got["mse"] == pytest.approx(np.mean([(v - 0.5) ** 2 for v in y]))
    assert got["weighted_mse"] == pytest.approx(np.mean([(v - 0.5) ** 2 for v in y[:3]]))


def test_pooled_weights_come_from_the_pooled_labels(spark):
    rng = np.random.default_rng(1)
    y, p, fold = rng.uniform(size=500), rng.uniform(size=500), rng.integers(0, 5, 500)
    df = spark.createDataFrame([("m", int(f), float(a), float(b)) for f, a, b in zip(fold, y, p)], "model string, fold int, y double, p double")
    got = metrics.pooled_metrics(metrics.bin_moments(df, ["model", "fold"], "y", "p"), ["model"]).first()
    for name, value in slow(y, p).items():
        assert got[name] == pytest.approx(value, rel=1e-9)


def test_sweep_moments_equal_scoring_each_model(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(int(b), float(v)) for b, v in zip(rng.integers(0, 5, 300), rng.uniform(size=300))], "bucket int, y double")
    preds = {k: [F.col("y") * a + f * 0.01 for f in range(5)] for k, a in (("a", 0.5), ("b", 0.9))}
    got = {(r["param_key"], r["fold"], r["role"]): r["mse"] for r in
           metrics.metrics(metrics.sweep_moments(df, "y", preds), ["param_key", "fold", "role"]).collect()}
    assert len(got) == 2 * 5 * 4
    y = np.array([(r["bucket"], r["y"]) for r in df.collect()])
    for (key, fold, role), mse in got.items():
        a = 0.5 if key == "a" else 0.9
        b = y[:, 0]
        val = (fold + 1) % 5
        used = {"test": b == fold, "val": b == val, "train": (b != fold) & (b != val), "train_val": b != fold}[role]
        assert mse == pytest.approx(((y[used, 1] * (1 - a) - fold * 0.01) ** 2).mean(), rel=1e-9)


def test_histogram_lists_empty_bins(spark):
    df = spark.createDataFrame([(0.0,), (0.05,), (1.0,), (1.5,)], "y double")
    h = {r["bin"]: r["count"] for r in histogram(df, [], "y", 10).collect()}
    assert h == {0: 2, 9: 1, **{i: 0 for i in range(1, 9)}}
    area = sum(r["density"] for r in density_histogram(df, [], "y", 10).collect()) / 10
    assert area == pytest.approx(1)


def test_kde_by_group_equals_numpy(spark):
    rng = np.random.default_rng(3)
    data = {g: rng.beta(2, 5, 200) for g in (0, 1)}
    df = spark.createDataFrame([(g, float(v)) for g in data for v in data[g]], "g int, y double")
    rows = kde(df, ["g"], "y", groups=2).collect()
    for g, v in data.items():
        h = v.std(ddof=1) * len(v) ** -0.2
        mine = sorted((r["x"], r["density"]) for r in rows if r["g"] == g)
        assert len(mine) == 200
        for x, dens in mine[::20]:
            assert dens == pytest.approx(np.exp(-((x - v) ** 2) / (2 * h * h)).sum() / (len(v) * h * math.sqrt(2 * math.pi)), rel=1e-9)
