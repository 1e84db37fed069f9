import hashlib

import pytest
from pyspark.sql import functions as F

from foldwise.operators import sampling
from foldwise.operators.sampling import _repeat


def rows(spark, data):
    return spark.createDataFrame([(0, f"k{i}", y) for i, y in enumerate(data)], "fold int, key string, y double")


def test_downsample_counts(spark):
    out = sampling.downsample(rows(spark, [0.01] * 5 + [0.95] * 3 + [0.5]), ["fold"], "y", ["key"]).collect()
    assert sum(r["y"] < 0.1 for r in out) == 3
    assert sum(r["y"] >= 0.1 for r in out) == 4


def test_downsample_fails_on_too_few_low_rows(spark):
    with pytest.raises(Exception, match="smaller than the sample"):
        sampling.downsample(rows(spark, [0.01] * 2 + [0.95] * 3), ["fold"], "y", ["key"]).collect()


def test_downsample_fails_without_low_rows(spark):
    with pytest.raises(Exception, match="smaller than the sample"):
        sampling.downsample(rows(spark, [0.95] * 3), ["fold"], "y", ["key"]).collect()


def test_group_without_high_rows_keeps_no_low_row(spark):
    out = sampling.downsample(rows(spark, [0.01, 0.02, 0.5]), ["fold"], "y", ["key"]).collect()
    assert [r["y"] for r in out] == [0.5]


def test_take_first_equals_brute_force_with_copies(spark):
    # A third of the rows are copies of one row.
    data = [(i % 3, f"k{i}") for i in range(400)] + [(0, "hot")] * 200
    df = spark.createDataFrame(data, "g int, key string").repartition(7)
    for n in (1, 50, 133, 250):
        sizes = spark.createDataFrame([(0, n), (1, min(n, 100))], "g int, take long")
        got = sorted(tuple(r) for r in sampling.take_first(df, sizes, ["g"], ["key"], 1).collect())

        def order(row):
            return hashlib.md5(f"1|{row[1]}".encode()).hexdigest()

        want = []
        for g, k in ((0, n), (1, min(n, 100))):
            want += sorted([r for r in data if r[0] == g], key=order)[:k]
        assert got == sorted(want)


def test_repeat_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(sampling, "_CHUNK", 4)
    df = spark.createDataFrame([("a", 10), ("b", 4), ("c", 1)], "k string, t long")
    counts = {r["k"]: r["count"] for r in _repeat(df, "t").groupBy("k").count().collect()}
    assert counts == {"a": 10, "b": 4, "c": 1}


def test_sample_does_not_depend_on_partitions(spark):
    df = rows(spark, [i / 1000 for i in range(500)] + [0.95] * 20)
    a = sampling.downsample(df.repartition(1), ["fold"], "y", ["key"]).orderBy("key").collect()
    b = sampling.downsample(df.repartition(9), ["fold"], "y", ["key"]).orderBy("key").collect()
    assert a == b


def test_sample_n_and_aligned(spark):
    df = rows(spark, [0.5] * 100)
    assert sampling.sample_n(df, 1024, ["key"], 1).count() == 100
    assert sampling.sample_n(df, 10, ["key"], 1).count() == 10
    x, y = sampling.sample_aligned(df.select("key"), df.select("key", "y"), ["key"], 0.5, 3)
    assert {r["key"] for r in x.collect()} == {r["key"] for r in y.collect()}
    assert 20 < x.count() < 80


def test_filter_label(spark):
    df = rows(spark, [0.05, 0.1, 0.5, 0.9])
    assert df.filter(F.col("y") < 0.1).count() == sampling.filter_label(df, "y", high=0.1).count() == 1
    assert sampling.filter_label(df, "y", low=0.1).count() == 3
    assert sampling.filter_label(df, "y").count() == 4
