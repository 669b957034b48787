"""Every registered query against its SQL, on the smallest tables."""

import pytest

from tests.oracle import assert_same, connect
from ticklake.plans.registry import load

SF = "/root/testdata/sf0.001"
QUERIES = load()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.sql))
def test_matches_sql(spark, con, name):
    assert_same(QUERIES[name].run(spark, SF), con, QUERIES[name].sql)


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if not q.sql))
def test_runs(spark, name):
    df = QUERIES[name].run(spark, SF)
    assert len(df.take(1)) == 1


def test_entry_and_keys(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 15
    assert set(e.oracle_sql()) <= set(e.queries())
