"""Every catalogue query against its SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
from checks.compare import connect, difference

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, con, key):
    df = QUERIES[key](spark, SF)
    if key in SQL:
        assert difference(df, con, SQL[key]) is None
    else:
        assert df.count() > 0
