"""Every registered query against its SQL check, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_point
from check import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", entry_point.SMOKE_DIR)


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(entry_point.queries()))
def test_query(spark, con, name):
    ok, info = compare(spark, con, name, SF_DIR)
    assert ok, info


def test_checks_belong_to_queries():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_entry_returns_rows(spark):
    assert entry_point.entry(spark).count() > 0
