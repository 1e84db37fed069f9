"""Missing values: one rule whatever the number of columns."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.operators import moments
from foldwise.operators.weights import bin_counts, bin_weights, row_weights

ROWS = [(i % 3, float(i), None if i % 4 == 0 else 0.9 if i % 7 else math.nan, 0.01 * i) for i in range(60)]


@pytest.mark.parametrize("missing", [None, math.nan])
def test_rows_with_gaps_are_left_out_on_both_widths(spark, monkeypatch, missing):
    rows = [(b, a, missing if c is None else c, y) for b, a, c, y in ROWS]
    df = spark.createDataFrame(rows, "bucket int, a double, c double, y double")
    z = [F.lit(1.0), F.col("a"), F.col("c"), F.col("y")]
    narrow = {(r.bucket, r.pos): r.v for r in moments.cross_sums(df, ["bucket"], z).collect()}
    monkeypatch.setattr(moments, "MAX_SQL_WIDTH", 1)
    wide = {(r.bucket, r.pos): r.v for r in moments.cross_sums(df, ["bucket"], z).collect()}
    whole = [(b, np.array([1, a, c, y])) for b, a, c, y in rows if c is not None and not math.isnan(c)]
    upper = np.triu_indices(4)
    for b in range(3):
        want = sum(np.outer(v, v) for k, v in whole if k == b)[upper]
        for got in (narrow, wide):
            assert np.allclose([got[b, p] for p in range(10)], want)


def test_labels_missing_weigh_nothing(spark):
    df = spark.createDataFrame([(0.05,), (0.05,), (0.95,), (None,)], "y double")
    weights = {r.bin: r.weight for r in bin_weights(bin_counts(df, "y", []), []).collect()}
    rows = {r.bin: r.weight for r in row_weights(df, "y", []).collect()}
    assert weights == pytest.approx(rows) and sum(weights.values()) == pytest.approx(1)
