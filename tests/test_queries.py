from __future__ import annotations

import pytest
from oracle import SF, connect, rows

from framelake import oracle, queries

SQL = oracle.oracle_sql()


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_equals_its_sql(spark, name):
    got = rows(queries.queries()[name](spark, SF).toPandas())
    want = rows(connect(SF).sql(SQL[name]).df())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_every_query_has_sql_and_the_entry_module_lists_them():
    import __spark_entry__ as e

    assert set(SQL) == set(queries.queries())
    assert set(SQL) <= set(e.queries()) and set(SQL) <= set(e.oracle_sql())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
