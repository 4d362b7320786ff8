"""Raw to daily, daily to monthly, monthly to yearly."""

from __future__ import annotations

from datetime import date

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from skyledger.constants import NOW
from skyledger.operators.ranking import keep_last
from skyledger.schemas import RAW_KEY
from skyledger.sources import zones


def daily_rollup(
    spark: SparkSession,
    feed: str,
    raw_root: str,
    daily_root: str,
    start: date,
    end: date | None = None,
    *,
    flat_files: bool = False,
    mode: str = "overwrite",
    compacted: bool | None = None,
    missing_ok: bool = False,
) -> None:
    """Move the issues of one or more days into ``year/month/day`` partitions.

    Rows that came in more than one batch are reduced to the latest one first,
    so an issue that is delivered again replaces the earlier delivery.
    """
    read = zones.read_raw_files if flat_files else zones.read_raw
    rows = read(spark, raw_root, feed, start, end, missing_ok)
    rows = keep_last(rows, RAW_KEY[feed], [F.col("batch"), F.struct(*rows.columns)])
    dated = zones.with_issue_date(rows).drop("issue", "batch")
    if compacted is None:
        # hourly nowcast files are tiny, and many days at once would leave
        # every task with a piece of each day
        compacted = feed == NOW or end not in (None, start)
    zones.write_zone(dated, daily_root, ["year", "month", "day"], mode, compacted)


def monthly_rollup(
    spark: SparkSession, feed: str, daily_root: str, monthly_root: str, year: int, month: int,
    *, mode: str = "overwrite", missing_ok: bool = False,
) -> None:
    """Rewrite one month by ``year/month``; ``day`` becomes a data column.

    A copy of pruned folders: no shuffle, and the scan packs small files into
    full splits, each written as one file.
    """
    rows = zones.checked(zones.read_zone(spark, daily_root, feed, year, month), f"{daily_root} for {year}-{month:02}", missing_ok)
    zones.write_zone(rows, monthly_root, ["year", "month"], mode)


def yearly_rollup(
    spark: SparkSession, feed: str, monthly_root: str, yearly_root: str, year: int,
    *, mode: str = "overwrite", missing_ok: bool = False,
) -> None:
    """Rewrite one year by ``year``; ``month`` and ``day`` become data columns."""
    rows = zones.checked(zones.read_zone(spark, monthly_root, feed, year), f"{monthly_root} for {year}", missing_ok)
    zones.write_zone(rows, yearly_root, ["year"], mode)

