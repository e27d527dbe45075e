"""Every query with SQL agrees with it on the smallest tables; the others run."""

import __spark_entry__ as entry
import pytest
from caseloom import registry
from compare import connect, differences

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, con, data, name):
    assert differences(spark, con, data, registry.queries()[name], SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, data, name):
    assert registry.queries()[name](spark, data).count() > 0


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
