"""Exact tiles, mergeable heaps, and mined negatives against a plain search."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foldwise.llm import hard_negatives as H
from foldwise.llm.catalog import ORACLES, QUERIES
from tests.compare import check

SCHEMA = "vec_id long, embedding array<float>, label int, id string, row string, score double"


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 19), st.integers(1, 23), st.integers(1, 17), st.integers(1, 4), st.integers(0, 2**32 - 1))
def test_strassen_is_exact(m, k, n, leaf, seed):
    random = np.random.default_rng(seed)
    a, b = (random.integers(-(2**27), 2**27, size) for size in ((m, k), (k, n)))
    assert (H.strassen(a, b, leaf).astype(object) == a.astype(object) @ b.astype(object)).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(-3, 3), st.integers(0, 30)), max_size=40), st.integers(1, 6), st.integers(1, 7))
def test_heaps_merge(entries, size, run):
    heaps = H.Heaps(size)
    for at in range(0, len(entries), run):
        part = np.array(entries[at : at + run])
        heaps.add((1,), part[:, 0], part[:, 1])
    got = heaps.table(["key"])
    assert list(zip(got["score"].to_pylist(), got["id"].to_pylist())) == sorted(entries, key=lambda e: (-e[0], e[1]))[:size]


def plain(rows):
    """The contract, row by row in whole numbers."""
    taken = []
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        ints = [math.floor(256 * float(np.float32(x))) for x in vector]
        taken.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, ints))
    out = []
    for i, (a_id, a_label, a) in enumerate(taken):
        if a_id % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(a, v)), b_id, b_label == a_label) for j, (b_id, b_label, v) in enumerate(taken) if j != i and len(v) == len(a)]
        for p, p_id, _ in sorted(s for s in scored if s[2])[:5]:
            hard = sorted(s for s in scored if not s[2] and 30 * -p <= 100 * -s[0] <= 90 * -p)[:10]
            out += [(a_id, p_id, rank, n_id, -p, -n) for rank, (n, n_id, _) in enumerate(hard, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    random = np.random.default_rng(5)
    made = [(i, random.uniform(-0.2, 1, 9).tolist(), int(random.integers(0, 3))) for i in range(1, 301)]
    made += [(100, made[99][1], made[99][2]), (500, [0.5] * 9, 1), (501, [0.5] * 9, 1), (501, [0.5] * 9, 1), (502, [0.3] * 9, 2), (503, [0.3] * 9, 2)]
    odd = [(None, [1.0] * 9, 1), (600, None, 1), (700, [1.0] * 9, None), (800, [math.nan] * 9, 1), (900, [math.inf] * 9, 1), (1000, [None] + [1.0] * 8, 1)]
    return made + odd + [(1100, [], 1), (1101, [], 2), (1200, [1.0], 1), (1201, [1.0], 1), (1202, [0.7], 2), (1300, [0.0] * 9, 0), (700, [-1.0] * 9, 2)]


@pytest.mark.parametrize("sizes", [{}, {"slot_rows": 2, "part_rows": 40}, {"slot_rows": 1, "part_rows": 7}])
def test_negatives_equal_a_plain_search(spark, rows, sizes):
    df = spark.createDataFrame([(*r, "x", "y", 1.0) for r in rows], SCHEMA).repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = H.mine(df, label, F.col("id") % 100 == 0, **sizes)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    found = sorted(tuple(r) for r in got.collect())
    assert found == plain(rows) and len(found) > 60


def test_empty_and_too_large(spark):
    df = spark.createDataFrame([(100, [1e9] * 4, 1, "", "", 0.0), (101, [1e9] * 4, 1, "", "", 0.0)], SCHEMA)
    for some in (df, df.limit(0)):
        assert H.mine(some, F.col("label"), F.col("id") % 100 == 0).collect() == []


def test_sql(spark, sf_dir):
    assert check(spark, sf_dir, QUERIES["op12_hard_negatives"], ORACLES["op12_hard_negatives"])[0] == "ok"
