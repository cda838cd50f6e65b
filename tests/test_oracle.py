"""Every registered query with an SQL twin against DuckDB on the smallest data."""

import os

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
SQL = {n: s for n, s in entry.oracle_sql().items() if n in entry.core.ORACLE_SQL}


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    same, said = compare(spark, connect(FOLDER), FOLDER, name, entry.queries()[name], SQL[name])
    assert same, said


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
