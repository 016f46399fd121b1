"""Every registered query against its SQL, on the smallest supplied data."""

import pytest

from catalog import ORACLES, QUERIES
from catalog.check import compare, oracle_connection


@pytest.fixture(scope="module")
def con(sf_dir):
    pytest.importorskip("duckdb")
    return oracle_connection(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    ok, note = compare(spark, con, name, QUERIES[name], ORACLES.get(name), sf_dir)
    assert ok, note


def test_entry(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
