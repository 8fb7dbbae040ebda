"""Every registered query of the core with SQL gives what the SQL gives."""

import pytest
from helpers import SMALL, database, rows

from sparkseek import queries as core

SQL = core.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return database()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    ours, theirs = core.queries()[name](spark, SMALL).toPandas(), con.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(core.queries())


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
