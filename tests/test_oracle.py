"""Registered queries against DuckDB on the smallest tables.

``tools/check_oracle.py`` does the same on any scale.
"""

import pytest
from check_oracle import compare, connect

from murmur.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    good, note = compare(spark, duck, name, QUERIES[name].run, QUERIES[name].sql, SF)
    assert good, note


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
