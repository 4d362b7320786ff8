"""Rows of the latest-state tables from raw rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.constants import SHORT, SNAPSHOT_DROPS
from skyledger.functions.clock import days_after

LAST_DAY = 3


def latest_rows(raw: DataFrame, feed: str) -> DataFrame:
    """Columns the latest-state table keeps; short forecasts up to three days ahead."""
    rows = raw.drop(*SNAPSHOT_DROPS)
    if feed == SHORT:
        # both are yyyyMMdd text, whose order is that of the dates
        rows = rows.where(F.col("fcstdate") <= days_after(F.col("basetime"), LAST_DAY))
    return rows
