"""Every query with SQL against DuckDB, on the smallest tables."""

import pytest

from quadrille.plans import registry
from tests.compare import check, connected

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connected(SF)


def test_every_query_has_sql():
    assert set(registry.queries()) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    check(registry.queries()[name](spark, SF), con, SQL[name])
