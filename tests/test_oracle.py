"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
import compare
from catalog.fixtures import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF, TABLES)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    ok, message = compare.compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, message


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
