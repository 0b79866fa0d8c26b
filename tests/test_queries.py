"""Every core query with SQL gives the SQL's rows; every other one runs."""

import pytest
from conftest import DATA, needs_data
from factloom.plans import registry
from oracle import connection, rows


@needs_data
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    got = registry.queries()[name](spark, str(DATA)).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql:
        want = connection(str(DATA)).execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


@needs_data
def test_flagship(spark):
    assert registry.flagship(spark, str(DATA)).count() > 0


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
