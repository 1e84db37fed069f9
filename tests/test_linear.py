import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise import constants as K
from foldwise.operators import linear
from foldwise.operators import moments
from foldwise.operators.grid import linear_grid
from foldwise.operators.metrics import fold_stats
from foldwise.plans import search

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    n = 1500
    x = np.column_stack([rng.normal(1e5, 10, n), rng.exponential(1, n), rng.integers(0, 2, n)]).astype(float)
    y = np.clip(0.4 + 0.005 * (x[:, 0] - 1e5) + 0.1 * x[:, 1] - 0.05 * x[:, 2] + rng.normal(0, 0.05, n), 0, 1)
    b = rng.integers(0, 5, n)
    df = spark.createDataFrame([(int(k), *map(float, r), float(t)) for k, r, t in zip(b, x, y)], "bucket int, a double, b double, c double, y double").persist()
    return df, b, x, y


@pytest.fixture(scope="module")
def sums(data):
    return moments.fold_sums(data[0], FEATURES, "y")


def train_rows(b, fold):
    return (b != fold) & (b != (fold + 1) % 5)


def test_least_squares_equals_numpy(data, sums):
    _, b, x, y = data
    for f, fit in enumerate(linear.fold_fits(sums)):
        t = train_rows(b, f)
        want = np.linalg.lstsq(np.column_stack([np.ones(t.sum()), x[t]]), y[t], rcond=None)[0]
        # The first column sits far from zero, which numpy's own solution feels too.
        assert fit.coefs == pytest.approx(want[1:], rel=1e-6)


def test_sums_score_like_the_rows(data, sums):
    df = data[0]
    fits = linear.fold_fits(sums)
    rows = {(r["fold"], r["role"]): r for r in linear.score_fits(df, fits, FEATURES, "y").collect()}
    for (fold, role), r in rows.items():
        got = linear.score_sums(sums, fits[fold], fold, role)
        for m in ("mse", "r2", "weighted_mse", "weighted_r2"):
            assert got[m] == pytest.approx(r[m], rel=1e-8)


def test_wide_tables_leave_generated_code(data, sums, monkeypatch):
    monkeypatch.setattr(moments, "MAX_SQL_WIDTH", 2)
    wide = moments.fold_sums(data[0], FEATURES, "y")
    for key, s in sums.table.items():
        assert wide.table[key].plain == pytest.approx(s.plain, rel=1e-9, abs=1e-9)
        assert wide.table[key].weighted == pytest.approx(s.weighted, rel=1e-9, abs=1e-9)


def test_lasso_optimality(sums):
    m = sums.table[(0, "train")].plain
    n = m[0, 0]
    cov = m / n - np.outer(m[0] / n, m[0] / n)
    for alpha in (1e-4, 1e-2, 0.05):
        b = linear.penalised(cov[1:-1, 1:-1], cov[1:-1, -1], alpha, 1.0)
        g = cov[1:-1, -1] - cov[1:-1, 1:-1] @ b
        for j in range(len(b)):
            assert abs(g[j]) <= alpha + 1e-9 if b[j] == 0 else g[j] == pytest.approx(math.copysign(alpha, b[j]), abs=1e-9)


def test_penalties_behave(sums):
    free = linear.fit_sums(sums, 0)
    assert linear.fit_sums(sums, 0, alpha=0.0, ratio=1.0).coefs == pytest.approx(free.coefs)
    norms = [np.linalg.norm(linear.fit_sums(sums, 0, alpha=a, scaler="StandardScaler").coefs * sums.scale) for a in (0.0, 0.1, 1.0, 10.0)]
    assert norms == sorted(norms, reverse=True)
    assert np.count_nonzero(linear.fit_sums(sums, 0, alpha=10.0, ratio=1.0, scaler="StandardScaler").coefs) == 0


def test_constant_column_gets_no_weight(spark):
    df = spark.createDataFrame([(i % 5, i / 100, 7.0, i / 100) for i in range(100)], "bucket int, a double, k double, y double")
    fit = linear.fit_sums(moments.fold_sums(df, ["a", "k"], "y"), 0)
    assert fit.coefs == pytest.approx([1.0, 0.0], abs=1e-9)


def test_grid_keys_and_parameter_sharing(spark, data, sums):
    spaces = spark.createDataFrame([("lasso", [0.001, 0.01]), ("ridge", [0.001])], "model string, alphas array<double>")
    grid = linear_grid(spaces)
    stats = search.linear_grid_search(data[0], FEATURES, "y", grid, sums=sums)
    assert stats.count() == (54 * 2 + 1 + 54 + 1) * 5
    assert stats.filter("model = 'lasso'").select(F.round("val_mse", 12)).distinct().count() <= 3 * 5
    done = search.refit_winners(stats, grid, sums).collect()
    assert len(done) == 10 and all(r["test_r2"] > 0.5 for r in done)


def test_failed_points_stay_as_nan_rows(spark, sums):
    grid = spark.createDataFrame([("lasso", "ok", 0, 0.1, 1.0), ("lasso", "bad", 99, 0.1, 1.0)], "model string, param_key string, fold int, alpha double, l1_ratio double")
    got = {r["param"]: r["val_mse"] for r in linear.grid_stats(spark, sums, grid).collect()}
    assert math.isnan(got["bad"]) and got["ok"] > 0


def test_two_stage_weights(data, sums):
    df, b, x, y = data
    first, second = linear.two_stage_fits(df, FEATURES, "y", sums)
    t = train_rows(b, 2)
    centred = np.column_stack([np.ones(t.sum()), x[t] - x[t].mean(0)])
    r = y[t] - centred @ np.linalg.lstsq(centred, y[t], rcond=None)[0]
    root = np.sqrt(1 / (r**2 + K.INVERSE_COUNT_EPS))
    want = np.linalg.lstsq(centred * root[:, None], y[t] * root, rcond=None)[0]
    assert second[2].coefs == pytest.approx(want[1:], rel=1e-5)
    assert not np.allclose(first[2].coefs, second[2].coefs, rtol=1e-6)


def test_breusch_pagan(data, sums):
    df, b, x, y = data
    got = {r["fold"]: r for r in linear.breusch_pagan(df, FEATURES, "y", sums, linear.fold_fits(sums)).collect()}
    t = train_rows(b, 1)
    centred = np.column_stack([np.ones(t.sum()), x[t] - x[t].mean(0)])
    e = (y[t] - centred @ np.linalg.lstsq(centred, y[t], rcond=None)[0]) ** 2
    fit = centred @ np.linalg.lstsq(centred, e, rcond=None)[0]
    lm = t.sum() * (1 - ((e - fit) ** 2).sum() / ((e - e.mean()) ** 2).sum())
    assert got[1]["lm"] == pytest.approx(lm, rel=1e-6)
    assert got[1]["p_value"] == pytest.approx(linear.chi2_tail(lm, 3), rel=1e-6)


@pytest.mark.parametrize("x, df, p", [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (7.814727903251179, 3, 0.05), (18.307038053275146, 10, 0.05), (11.0705, 5, 0.05)])
def test_chi2_tail(x, df, p):
    assert linear.chi2_tail(x, df) == pytest.approx(p, rel=1e-5)


def test_bin_weighted_rows(spark, data, sums):
    _, b, x, y = data
    t = train_rows(b, 3)
    bins = np.minimum(np.searchsorted(np.arange(101) * 0.01, y[t], side="right") - 1, 99)
    inv = 1 / (np.bincount(bins, minlength=100) + 1e-6)
    w = inv / inv[np.bincount(bins, minlength=100) > 0].sum()
    root = np.sqrt(w[bins])
    z = np.column_stack([np.ones(t.sum()), x[t, 0] * root, x[t, 1] * root, x[t, 2]])
    want = np.linalg.lstsq(z, y[t] * root, rcond=None)[0]
    fit = linear.bin_weighted_fit(sums, 3, ["a", "b"])
    assert z @ np.concatenate([[fit.intercept], fit.coefs]) == pytest.approx(z @ want, abs=1e-6)


def test_naive_report_against_row_scores(data):
    df, b, _, y = data
    got = {(r["fold"], r["role"]): r for r in linear.naive_report(df, "y").collect()}
    mean = y[train_rows(b, 0)].mean()
    assert got[(0, "test")]["mae"] == pytest.approx(np.abs(y[b == 0] - mean).mean())
    assert got[(0, "train")]["r2"] == pytest.approx(0, abs=1e-12)
    wide = fold_stats(linear.naive_report(df, "y").select("fold", "role", "mse", "r2", "weighted_mse", "weighted_r2"), ["fold"], "train", "test")
    assert wide.count() == 5 and "weighted_val_r2" in wide.columns


def test_costly_columns_are_summed_once_a_row_to_the_same_sums(spark):
    from pyspark.sql import functions as F

    from foldwise.operators.moments import cross_sums

    rows = [(i % 3, float(i % 11), None if i % 7 == 0 else float(i % 5), math.nan if i % 13 == 0 else 1.0 + i) for i in range(300)] + [(None, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "g int, a double, b double, w double")
    z = [F.lit(1.0), F.pow(F.col("a") + 1, F.lit(0.3)), F.log1p("b")]
    plain, once = ({(r.g, r.pos): r.v for r in cross_sums(df, ["g"], z, F.col("w"), costly).collect()} for costly in (False, True))
    assert plain.keys() == once.keys() and len(plain) == 24
    assert all(once[k] == pytest.approx(v) for k, v in plain.items())
