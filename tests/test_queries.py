"""Every core query against its SQL, on the smallest data."""

import pytest
from compare import compare, views

from querypond import queries as core

@pytest.fixture(scope="module")
def db(sf):
    return views(sf)


@pytest.mark.parametrize("name", list(core.queries()))
def test_query(spark, db, sf, name):
    text, _, ok = compare(spark, db, sf, name, core.queries()[name], core.oracle_sql().get(name))
    assert ok, text


def test_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns
    assert set(core.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
