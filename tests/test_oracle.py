"""Every registered query against its SQL twin, whole results."""

from __future__ import annotations

import pytest
from compare import connect, differences

import __spark_entry__ as driver
from skyledger.lens.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert differences(driver.queries()[name](spark, SF), con, driver.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", ["stream_snapshot", "ingest_state_ultrashort", "ingest_state_short", "raw_redelivery"])
def test_crowded_keys_equal_sql(spark, name):
    """The tables ten times as large hold keys with several rows in the newest issue."""
    sf = "/root/testdata/sf0.01"
    assert differences(driver.queries()[name](spark, sf), connect(sf), driver.oracle_sql()[name]) == []


def test_every_query_has_its_twin():
    assert set(QUERIES) <= set(driver.oracle_sql()) and set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark):
    assert driver.entry(spark).count() > 0
