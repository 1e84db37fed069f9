"""Every registered query against its SQL on the smallest tables."""

import pytest

from foldwise.plans.catalog import ORACLES, QUERIES
from tests.compare import check


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, name):
    result, _, _ = check(spark, sf_dir, QUERIES[name], ORACLES.get(name))
    assert result == "ok"


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())
