import os

import pytest

from paperloom.plans import queries
from tests import sqlcheck

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equal_to_sql(spark, name):
    sqlcheck.same(spark, queries.queries()[name], SQL[name])


@pytest.mark.skipif(not os.path.isdir(sqlcheck.SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(SQL)))
def test_runs(spark, name):
    assert queries.queries()[name](spark, sqlcheck.SF).count() > 0


def test_entry_has_all_queries():
    import __spark_entry__ as e

    assert set(SQL) <= set(e.oracle_sql()) <= set(e.queries())
