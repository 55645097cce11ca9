"""Every registered query against its SQL on the given tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry_points
from gridclime.registry import all_queries
from oracle import connect, differences

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert all_queries().keys() <= entry_points.oracle_sql().keys() <= entry_points.queries().keys()


@pytest.mark.parametrize("name", list(entry_points.oracle_sql()))
def test_query_matches_its_sql(spark, tables, name):
    df = entry_points.queries()[name](spark, SF_DIR)
    assert differences(df, tables, entry_points.oracle_sql()[name]) == []
