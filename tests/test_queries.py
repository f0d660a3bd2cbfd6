"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle import rows_of_spark, rows_of_sql

from finlattice.plans.catalogue import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    names, rows = rows_of_spark(QUERIES[name](spark, sf))
    assert sum(rows.values()) > 0 or name in ("inserted_new",)
    if name in ORACLES:
        expected_names, expected = rows_of_sql(ORACLES[name], sf)
        assert names == expected_names
        assert rows == expected


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
