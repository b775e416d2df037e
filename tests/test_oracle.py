"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, con, name):
    rows, message = compare(spark, con, QUERIES[name], ORACLE[name], SF)
    assert message == "ok"
    assert rows > 0


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
