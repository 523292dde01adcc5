"""Every registered query against its SQL on the same tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_module
from compare import compare, connect
from slowlens.plans import catalog

# limits that no row of the smallest tables reaches
EMPTY_WHEN_SMALL = {"exec_rule_high_cost_nl_join", "report_window_daily"}
entry_module.queries()
QUERIES = catalog.QUERIES
ORACLES = catalog.ORACLES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_each_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_module.queries())
    assert set(ORACLES) <= set(entry_module.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    left, right, differences = compare(spark, con, QUERIES[name], ORACLES[name], sf_dir)
    assert not differences
    assert left or name in EMPTY_WHEN_SMALL


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns[0] == "sql_id"
    assert df.count() == 20
