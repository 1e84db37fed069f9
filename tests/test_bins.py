import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foldwise.functions.bins import bin_text, histogram_bin, label_bin, report_bin
from foldwise.operators.weights import bin_counts, bin_weights, training_weights

EDGE_VALUES = sorted({v for i in range(101) for e in (i * 0.01, i / 100) for v in (e, np.nextafter(e, 0), np.nextafter(e, 1)) if 0 <= v <= 1})


def column(spark, values, expr):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, y double")
    return [r[1] for r in df.select("i", expr(F.col("y"))).orderBy("i").collect()]


def numpy_bins(values, n=101):
    edges = np.linspace(0, 1, n)
    edges[-1] += 1e-6
    return np.minimum(np.digitize(values, edges) - 1, n - 2).tolist()


def test_left_closed_bins_equal_digitize_on_every_edge(spark):
    assert column(spark, EDGE_VALUES, label_bin) == numpy_bins(EDGE_VALUES)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=1, max_size=300), st.sampled_from([11, 51, 101, 257]))
def test_left_closed_bins_property(spark, values, n):
    assert column(spark, values, lambda y: label_bin(y, n)) == numpy_bins(values, n)


def test_missing_and_out_of_range_labels(spark):
    assert column(spark, [float("nan"), 1.5], label_bin) == [None, 99]
    with pytest.raises(Exception, match="label below 0"):
        column(spark, [-0.1], label_bin)


def test_report_bins(spark):
    values = [0, 0.01, 0.010001, 0.99, 0.995, 1.0, -0.1, 1.1]
    assert column(spark, values, report_bin) == [0, 1, 2, 99, 100, 101, None, None]


def test_report_bins_on_every_edge(spark):
    edges = [round(i * 0.01, 2) for i in range(101)]

    def slow(y):
        if y in (0, 1):
            return 0 if y == 0 else 101
        return next(i + 1 for i in range(100) if edges[i] < y <= edges[i + 1])

    assert column(spark, EDGE_VALUES, report_bin) == [slow(v) for v in EDGE_VALUES]


def test_histogram_bin_equals_numpy(spark):
    values = [v for v in EDGE_VALUES] + [-0.5, 1.5]
    got = column(spark, values, lambda y: histogram_bin(y, 50))
    want, _ = np.histogram(values, bins=np.linspace(0, 1, 51))
    assert [got.count(i) for i in range(50)] == want.tolist()
    assert got[-2:] == [None, None]


def test_bin_text(spark):
    df = spark.range(1).select(bin_text(F.lit(10)).alias("a"), bin_text(F.lit(99)).alias("b"))
    assert tuple(df.first()) == ("[0.10, 0.11)", "[0.99, 1.00)")


def test_weights_sum_to_one_over_occupied_bins(spark):
    df = spark.createDataFrame([(0, 0.05)] * 3 + [(0, 0.95)], "fold int, y double")
    rows = bin_weights(bin_counts(df, "y", ["fold"]), ["fold"]).collect()
    assert len(rows) == 2 and sum(r["weight"] for r in rows) == pytest.approx(1)
    inverse = {r["bin"]: r["inverse_count"] for r in rows}
    low, high = numpy_bins([0.05, 0.95])
    assert inverse == {low: pytest.approx(1 / (3 + 1e-6)), high: pytest.approx(1 / (1 + 1e-6))}


def test_training_weights_drop_equal_rows(spark):
    df = spark.createDataFrame([(0, 1, 0.05)] * 3 + [(0, 2, 0.05), (0, 1, 0.5)], "fold int, x int, y double")
    rows = training_weights(df, "y", ["fold"], groups=1).collect()
    assert sorted((r["x"], r["y"], r["count"]) for r in rows) == [(1, 0.05, 2), (1, 0.5, 1), (2, 0.05, 2)]
