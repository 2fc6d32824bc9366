"""Registered queries against their DuckDB SQL at the smallest scale, and the entry point's contract.

Those that fit models or run the whole chain, and so take longest, are compared when GRIDLOOM_ALL is set.
"""

import os

import pytest

import __spark_entry__ as entry_point
from gridloom.plans import queries as core

from .compare import connection, difference

SF = "/root/testdata/sf0.001"
SLOW = {"a27_quality_scoreboard", "chain_cleaned", "chain_dataset", "m5_newton_logistic", "m6_histogram_tree", "m15_tree_importance", "m14_quantile_lines", "m14_quantile_coverage"}
ALL = sorted(core.oracle_sql() if os.environ.get("GRIDLOOM_ALL") else core.oracle_sql().keys() - SLOW)


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", ALL)
def test_query_matches_its_sql(spark, con, name):
    assert difference(spark, con, core.queries()[name], core.oracle_sql()[name], SF) is None


def test_entry_point(spark):
    assert entry_point.entry(spark).count() > 0
    queries, sql = entry_point.queries(), entry_point.oracle_sql()
    assert set(sql) <= set(queries) and len(core.queries()) > 150
