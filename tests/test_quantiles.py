"""Order-preserving keys, radix selection and as-of joins."""

import math
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foldwise.functions.bits import with_order_key
from foldwise.operators.quantiles import exact_quantiles, fold_quantiles
from foldwise.operators.ranges import asof_join, leaves
from foldwise.operators.scalers import apply_scaler, fit_fold_scaler, fit_scaler


def test_keys_sort_as_values_do(spark):
    random = np.random.default_rng(0)
    values = [0.0, -0.0, math.inf, -math.inf, math.nan, None, 5e-324, -5e-324, 1.7976931348623157e308, 2.2250738585072014e-308]
    for e in range(-1074, 1024):
        values += [2.0**e, -float(np.nextafter(2.0**e, 0)), float(np.nextafter(2.0**e, math.inf))]
    values += [float(v) for v in np.frombuffer(random.bytes(8 * 5000), "<f8")]
    for r in spark.createDataFrame([(v,) for v in values], "x double").transform(lambda df: with_order_key(df, F.col("x"), "k")).collect():
        if r.x is None or math.isnan(r.x):
            assert r.k is None
        else:
            size = struct.unpack("<q", struct.pack("<d", abs(r.x)))[0]
            assert r.k == (-size if r.x < 0 else size)


def test_quantiles_over_sixty_decades_and_infinities(spark):
    values = [10.0**-i for i in range(60)] + [math.inf, -math.inf, math.inf, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = {r.prob: r.value for r in exact_quantiles(df, [], ["x"], [0.0, 0.25, 0.5, 62 / 63, 1.0]).collect()}
    ordered = sorted(values)
    assert got[0.0] == -math.inf and got[62 / 63] == got[1.0] == math.inf
    assert got[0.5] == ordered[31] + (ordered[32] - ordered[31]) / 2 and got[0.25] == ordered[15] + (ordered[16] - ordered[15]) * 0.75


def test_quantiles_of_no_rows_and_of_many_columns(spark):
    empty = spark.createDataFrame([], "g int, x double")
    assert exact_quantiles(empty, ["g"], ["x"], [0.5], 3).collect() == []
    random = np.random.default_rng(2)
    data = random.normal(0, [1, 1e-9, 1e9], (500, 3))
    df = spark.createDataFrame([(i % 5, *map(float, r)) for i, r in enumerate(data)], "bucket int, a double, b double, c double")
    probs = [i / 99 for i in range(100)]
    for r in fold_quantiles(df, ["a", "b", "c"], probs).collect():
        mine = [x for i, x in enumerate(data) if i % 5 not in (r.fold, (r.fold + 1) % 5)]
        assert r.value == pytest.approx(np.quantile([x["abc".index(r.column)] for x in mine], r.prob), rel=1e-12)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(2**62), 2**62) | st.integers(-50, 50), max_size=60, unique=True), st.lists(st.integers(-(2**63), 2**63 - 1) | st.integers(-60, 60), max_size=20), st.integers(1, 5))
def test_leaves_cover_every_key_once(keys, probes, leaf):
    keys = np.sort(np.array(keys, np.int64))
    found = leaves(keys, leaf)
    for x in [*probes, *keys.tolist()]:
        mine = [(a, z) for depth, prefix, a, z in found if x >> (64 - 4 * depth) == prefix]
        assert len(mine) == 1
        a, z = mine[0]
        assert z - a <= leaf + 1
        before = int(np.searchsorted(keys, x, "right")) - 1
        assert before < a and not (keys[a:z] <= x).any() if before < 0 else a <= before < z


def test_asof_join(spark):
    random = np.random.default_rng(1)
    keys = {g: sorted({*random.lognormal(0, 8, n).tolist(), -1.0, 0.0, math.inf, 1000.0, 1000.0000000001}) for g, n in (("a", 300), ("b", 0))}
    table = spark.createDataFrame([(g, k, i) for g, ks in keys.items() for i, k in enumerate(ks)], "g string, k double, i int")
    values = [None, math.nan, -math.inf, math.inf, -0.0, *random.lognormal(0, 8, 300).tolist(), *keys["a"][:40]]
    rows = spark.createDataFrame([(g, v, j) for g in "ab" for j, v in enumerate(values)], "g string, v double, j int")
    for bound in (None, 1000):
        out = asof_join(rows, table, ["g"], "v", "k", "e", bound).collect()
        assert len(out) == 2 * len(values)
        for r in out:
            if r.v is None or math.isnan(r.v):
                assert r.e is None
            else:
                at = int(np.searchsorted(keys[r.g], r.v, "right")) - 1
                assert (r.e.i if r.e else -1) == at


def test_quantile_transform_places_values_among_exact_quantiles(spark):
    random = np.random.default_rng(3)
    data = [(int(b), float(v), float(w)) for b, v, w in zip(random.integers(0, 5, 3000), random.exponential(1, 3000), random.integers(0, 6, 3000))]
    df = spark.createDataFrame(data, "bucket int, x double, tied double")
    params = fit_fold_scaler(df, ["x", "tied"], "QuantileTransformer")
    grid = np.linspace(0, 1, 1000)
    quantiles = {f: {c: np.quantile([r[i] for r in data if r[0] not in (f, (f + 1) % 5)], grid) for i, c in ((1, "x"), (2, "tied"))} for f in range(5)}
    for r in params.collect():
        for c in ("x", "tied"):
            assert r.params[c] == pytest.approx(quantiles[r.fold][c], rel=1e-12)
    probe = [(f, v, w) for f in range(5) for v, w in ((-1.0, 0.0), (0.5, 2.0), (1e9, 7.0), (math.nan, None), (0.001, 2.5))]
    from statistics import NormalDist

    out = apply_scaler(spark.createDataFrame(probe, "fold int, x double, tied double").withColumns({"_x": F.col("x"), "_t": F.col("tied")}), params, ["fold"], ["x", "tied"], "QuantileTransformer", 5)
    for r in out.collect():
        for c, v, z in (("x", r._x, r.x), ("tied", r._t, r.tied)):
            if v is None:
                assert z is None
            elif math.isnan(v):
                assert math.isnan(z)
            else:
                q = quantiles[r.fold][c]
                p = 0.5 * (np.interp(v, q, grid) - np.interp(-v, -q[::-1], -grid[::-1]))
                assert z == pytest.approx(NormalDist().inv_cdf(min(max(p, 1e-7), 1 - 1e-7)), abs=1e-6)


def test_ungrouped_quantile_transform(spark):
    df = spark.createDataFrame([(float(i),) for i in range(50)], "x double")
    out = apply_scaler(df, fit_scaler(df, [], ["x"], "QuantileTransformer"), [], ["x"], "QuantileTransformer")
    z = sorted(r.x for r in out.collect())
    assert out.columns == ["x"] and z[0] == -z[-1] and z[0] == pytest.approx(-5.199337582605575) and all(a < b for a, b in zip(z, z[1:]))
