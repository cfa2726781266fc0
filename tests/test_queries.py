"""Every registered query runs on the smallest tables and agrees with its SQL."""

import pytest

from sigframe.workload import load
from tests.check import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, SQL = load()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    _, rows, error = compare(spark, con, name, QUERIES[name], SQL.get(name), SF)
    assert error is None, error


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
