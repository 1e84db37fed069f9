import math
from statistics import NormalDist

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foldwise.functions.scalar import inverse_normal
from foldwise.operators.quantiles import exact_quantiles
from foldwise.operators.scalers import SCALERS, apply_scaler, fit_fold_scaler, fit_power, fit_scaler, scale_folds
from foldwise.plans.scaler_study import MODELS, scaler_study, study_winners

PROBS = [0.0, 0.25, 0.5, 0.9, 1.0]


def quantiles(spark, values, bits=12):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    return {r["prob"]: r["value"] for r in exact_quantiles(df, [], ["x"], PROBS, bits=bits).collect()}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.floats(-1e12, 1e12), min_size=1, max_size=80))
def test_quantiles_equal_numpy(spark, values):
    got = quantiles(spark, values, bits=5)
    for p in PROBS:
        assert got[p] == pytest.approx(np.quantile(values, p), rel=1e-9, abs=1e-6)


def test_quantiles_with_a_hot_value(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([np.full(500, 3.0), rng.lognormal(0, 4, 1000)])
    got = quantiles(spark, values, bits=8)
    for p in PROBS:
        assert got[p] == pytest.approx(np.quantile(values, p), rel=1e-9)


def test_quantiles_by_group_skip_missing(spark):
    df = spark.createDataFrame([(0, 1.0, None), (0, 3.0, 5.0), (0, float("nan"), 7.0), (1, 9.0, None)], "g int, a double, b double")
    got = {(r["g"], r["column"]): r["value"] for r in exact_quantiles(df, ["g"], ["a", "b"], [0.5], 2).collect()}
    assert got == {(0, "a"): 2.0, (0, "b"): 6.0, (1, "a"): 9.0}


@pytest.mark.parametrize("kind", ["StandardScaler", "MinMaxScaler"])
def test_constant_column_becomes_zero(spark, kind):
    df = spark.createDataFrame([(0, 4.0), (0, 4.0)], "fold int, x double")
    out = apply_scaler(df, fit_scaler(df, ["fold"], ["x"], kind), ["fold"], ["x"], kind, 1)
    assert [r["x"] for r in out.collect()] == [0.0, 0.0]


def test_zero_column_stays(spark):
    df = spark.createDataFrame([(0, 0.0), (0, 0.0)], "fold int, x double")
    for kind in ("MaxAbsScaler", "RobustScaler"):
        out = apply_scaler(df, fit_scaler(df, ["fold"], ["x"], kind, 1), ["fold"], ["x"], kind, 1)
        assert [r["x"] for r in out.collect()] == [0.0, 0.0]


def test_names_stay_with_values(spark):
    df = spark.createDataFrame([(0, 1.0, 10.0, 100.0), (0, 3.0, 20.0, 300.0)], "fold int, a double, keep double, b double")
    out = apply_scaler(df, fit_scaler(df, ["fold"], ["a", "b"], "MinMaxScaler"), ["fold"], ["a", "b"], "MinMaxScaler", 1)
    assert out.columns == df.columns
    assert sorted((r["a"], r["keep"], r["b"]) for r in out.collect()) == [(0.0, 10.0, 0.0), (1.0, 20.0, 1.0)]


def test_bucket_statistics_merge_to_fold_statistics(spark):
    rng = np.random.default_rng(1)
    data = [(int(b), float(v)) for b, v in zip(rng.integers(0, 5, 500), rng.normal(1e6, 1, 500))]
    df = spark.createDataFrame(data, "bucket int, x double")
    for kind, want in (("StandardScaler", lambda v: (v.mean(), v.std())), ("MinMaxScaler", lambda v: (v.min(), np.ptp(v))),
                       ("MaxAbsScaler", lambda v: (0.0, np.abs(v).max())), ("RobustScaler", lambda v: (np.median(v), np.subtract(*np.quantile(v, [0.75, 0.25]))))):
        got = {r["fold"]: r["params"]["x"] for r in fit_fold_scaler(df, ["x"], kind).collect()}
        for f in range(5):
            v = np.array([x for b, x in data if b not in (f, (f + 1) % 5)])
            assert got[f] == pytest.approx(want(v), rel=1e-9)


def yeo_johnson(x, lam):
    with np.errstate(all="ignore"):
        pos = np.log1p(x) if abs(lam) < 1e-12 else ((x + 1) ** lam - 1) / lam
        neg = -np.log1p(-x) if abs(lam - 2) < 1e-12 else -((1 - x) ** (2 - lam) - 1) / (2 - lam)
    return np.where(x >= 0, pos, neg)


def likelihood(x, lam):
    return -len(x) / 2 * math.log(yeo_johnson(x, lam).var()) + (lam - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()


def test_power_lambda_has_the_largest_likelihood(spark):
    rng = np.random.default_rng(2)
    cols = {"a": rng.lognormal(0, 0.7, 800), "b": rng.normal(0, 1, 800), "c": -rng.exponential(2, 800)}
    df = spark.createDataFrame([tuple(float(v[i]) for v in cols.values()) for i in range(800)], "a double, b double, c double")
    params = fit_power(df, [], list(cols)).first()["params"]
    for name, x in cols.items():
        grid = np.linspace(-5, 5, 4001)
        best = grid[np.argmax([likelihood(x, g) for g in grid])]
        assert params[name][0] == pytest.approx(best, abs=0.004)
        z = yeo_johnson(x, params[name][0])
        assert params[name][1:] == pytest.approx([z.mean(), z.std()], rel=1e-6)


def test_quantile_transform_is_normal(spark):
    rng = np.random.default_rng(3)
    x = rng.exponential(1, 4000)
    df = spark.createDataFrame([(0, float(v)) for v in x], "fold int, x double")
    out = apply_scaler(df, fit_scaler(df, ["fold"], ["x"], "QuantileTransformer"), ["fold"], ["x"], "QuantileTransformer")
    z = np.array([r["x"] for r in out.collect()])
    inner = z[np.abs(z) < 5]
    assert abs(inner.mean()) < 0.02 and abs(inner.std() - 1) < 0.03 and np.abs(z).max() <= 5.2
    assert z.max() == pytest.approx(5.199337582605575)


def test_inverse_normal(spark):
    ps = [1e-7, 1e-3, 0.02, 0.3, 0.5, 0.77, 0.98, 1 - 1e-6]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = {r["p"]: r["z"] for r in df.select("p", inverse_normal(F.col("p")).alias("z")).collect()}
    for p in ps:
        assert got[p] == pytest.approx(NormalDist().inv_cdf(p), abs=1e-7)


def test_log_then_standard(spark):
    rng = np.random.default_rng(4)
    data = [(int(b), float(v)) for b, v in zip(rng.integers(0, 5, 200), rng.exponential(5, 200))]
    df = spark.createDataFrame(data, "bucket int, x double")
    out = scale_folds(df, ["x"], ["LogScaler", "StandardScaler"], ["train"])
    for f in range(5):
        z = np.array([r["x"] for r in out.filter(F.col("fold") == f).collect()])
        assert z.mean() == pytest.approx(0, abs=1e-9) and z.std() == pytest.approx(1)


def test_scaler_study(spark):
    rng = np.random.default_rng(5)
    n = 400
    a, b = rng.exponential(1, n), rng.normal(size=n)
    y = np.clip(0.3 * np.log1p(a) + 0.02 * b + 0.2, 0, 1)
    df = spark.createDataFrame([(int(i % 5), float(v), float(w), float(t)) for i, (v, w, t) in enumerate(zip(a, b, y))], "bucket int, a double, b double, y double")
    study = scaler_study(df, ["a"], ["b"], "y")
    rows = study.collect()
    assert len(rows) == len(SCALERS) * len(MODELS) * 5 * 2
    ols = {r["scaler"]: r["validation_r2"] for r in rows if r["model_name"] == "ols" and r["fold"] == 0 and r["weight_status"] == "unweighted"}
    # An affine scaler does not change a least-squares fit; the logarithm is the true shape.
    assert len({round(ols[s], 9) for s in ("RobustScaler", "StandardScaler", "MinMaxScaler", "MaxAbsScaler", "IdentityScaler")}) == 1
    assert ols["LogScaler"] > ols["IdentityScaler"]
    assert study_winners(study).count() == len(MODELS) * 5 * 2
    held_out = scaler_study(df, ["a"], ["b"], "y", models=["ols"], scalers=["LogScaler"], statuses=["unweighted"], split="val")
    assert held_out.count() == 5


def test_failing_scaler_leaves_nan_rows(spark):
    df = spark.createDataFrame([(i % 5, -5.0 - i, i / 50) for i in range(50)], "bucket int, a double, y double")
    rows = scaler_study(df, ["a"], [], "y", models=["ols"], scalers=["LogScaler", "StandardScaler"], statuses=["unweighted"]).collect()
    bad = [r for r in rows if r["scaler"] == "LogScaler"]
    assert len(bad) == 5 and all(math.isnan(r["validation_mse"]) for r in bad)
    assert all(r["validation_mse"] < 1e-6 for r in rows if r["scaler"] == "StandardScaler")


def test_power_lambda_beyond_the_first_bracket(spark):
    """Strongly left-skewed values: the best lambda lies far outside the starting bracket and beats its neighbours."""
    x = np.linspace(0.9, 1.0, 400) ** 0.05
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    lam = fit_power(df, [], ["x"]).first()["params"]["x"][0]

    def likelihood(k):
        z = ((x + 1) ** k - 1) / k
        return -len(x) / 2 * np.log(z.var()) + (k - 1) * np.log1p(x).sum()

    assert lam > 6.3 and likelihood(lam) >= max(likelihood(lam - 0.5), likelihood(lam + 0.5))


def test_power_is_fitted_on_distinct_values_and_its_numbers_leave_the_map_once(spark, monkeypatch):
    from foldwise.operators import scalers

    rows = [(i % 2, float(1 + i % 7) ** 2, 3.0, None if i % 5 else float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, a double, same double, thin double")
    seen = []
    whole = scalers._power_of_counts
    monkeypatch.setattr(scalers, "_power_of_counts", lambda counts, *rest: seen.append(counts.count()) or whole(counts, *rest))
    params = scalers.fit_power(df, ["g"], ["a", "same", "thin"], 2)
    # Seven values, one, and forty with the missing one, in either group; not four hundred rows a column.
    assert seen == [2 * (7 + 1 + 41)]
    for r in params.collect():
        assert r.params["same"][2] == 1.0
        lam, mean, sd = r.params["a"]
        z = [((x + 1) ** lam - 1) / lam for g, x, _, _ in rows if g == r.g]
        centre = sum(z) / len(z)
        assert mean == pytest.approx(centre) and sd == pytest.approx(math.sqrt(sum((v - centre) ** 2 for v in z) / len(z)))
    plan = scalers.apply_scaler(df, params, ["g"], ["a", "same"], "PowerTransformer", 2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.split("Join")[0].count("params") == 0


def test_few_groups_are_placed_by_search_as_by_join(spark):
    from foldwise.operators import scalers

    random = __import__("random").Random(4)
    rows = [(None if i % 37 == 0 else i % 3, i, random.choice([None, math.nan, 0.0, -0.0, 1.5, random.gauss(0, 1), 1e300, -math.inf])) for i in range(900)]
    df = spark.createDataFrame(rows, "g int, i int, x double")
    params = scalers.fit_quantile(df.filter("g < 2 AND abs(x) < 2"), ["g"], ["x"], 2)
    kept = [{r.i: (r.g, r.x if r.x is None or math.isnan(r.x) else round(r.x, 9)) for r in scalers.apply_scaler(df, params, ["g"], ["x"], "QuantileTransformer", n).collect()}
            for n in (2, None)]
    assert repr(sorted(kept[0].items())) == repr(sorted(kept[1].items())) and len(kept[0]) > 500
    assert "MapInArrow" in scalers.apply_scaler(df, params, ["g"], ["x"], "QuantileTransformer", 2)._jdf.queryExecution().optimizedPlan().toString()
