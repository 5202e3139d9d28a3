"""Every registered query with SQL against that SQL on the given tables."""

import pytest
from compare import connect, differences

import __spark_entry__ as entry_points
from chatlens.catalog import QUERIES as OWN

QUERIES, ORACLE = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck(tiny):
    return connect(tiny)


def test_every_own_query_has_sql():
    assert set(OWN) <= set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, tiny, duck, name):
    assert differences(QUERIES[name](spark, tiny), duck, ORACLE[name]) is None


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
