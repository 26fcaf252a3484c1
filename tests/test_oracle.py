"""Every query of the engine against its SQL."""

import pytest

from verisift import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, same, name):
    same(QUERIES[name](spark, sf), SQL[name])


def test_all_have_sql():
    assert set(QUERIES) == set(SQL)
