"""Every core query that has SQL gives the same rows as DuckDB on the smallest tables."""

import pytest

from kestrelite.queries import collect

from tests.compare import connect, same

QUERIES, ORACLE = collect()


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, con, name):
    same(spark, con, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    from tests.compare import DATA

    assert QUERIES[name](spark, DATA).count() > 0
