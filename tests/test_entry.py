import os

import pytest

import __spark_entry__ as entry_module
from riskframe.catalog import all_queries
from tools.check_queries import compare

SMALL = entry_module.SMALL
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")


def test_every_oracle_has_a_query():
    assert set(all_queries()) <= set(entry_module.queries())
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@needs_tables
def test_entry(spark):
    got = entry_module.entry(spark)
    assert got.columns == ["model", "metric", "text"] and got.count() == 12


@needs_tables
@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, name):
    assert compare(spark, SMALL, name) == []
