"""Every query with SQL gives the rows that DuckDB gives."""

import pytest
from conftest import same

from cadenza import queries as core


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_query(spark, small, duck, name):
    df = core.QUERIES[name](spark, small)
    got, expected = same(df, duck, core.ORACLE_SQL[name])
    assert got == expected


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLE_SQL)))
def test_without_sql(spark, small, name):
    df = core.QUERIES[name](spark, small)
    assert df.count() > 0


def test_entry_imports_and_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(core.QUERIES) <= set(e.queries())
