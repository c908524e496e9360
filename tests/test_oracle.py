"""Every registered query against its SQL in DuckDB, on whole tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import check, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
MAY_BE_EMPTY = {"mutualisation", "anti_splitting", "orphan_references", "repeat_runs", "stream_security",
                "stream_outbox", "common_needs", "price_search", "regulatory_filter",
                "validity_gaps", "sod_violations"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    _, message = check(spark, name, QUERIES[name], ORACLE.get(name), con, SF)
    if message == "both empty" and name in MAY_BE_EMPTY:
        return
    assert message == ""


def test_entry(spark):
    assert entry.entry(spark).columns == ["program", "fiscal_year", "month", "month_need", "need",
                                          "available", "shortfall"]
