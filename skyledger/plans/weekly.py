"""Highest and lowest temperature per city and day over the last seven days."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.constants import MISSING_TEMP, NOW
from skyledger.functions.clock import is_stamp12, parse_stamp8
from skyledger.sources import zones

SPAN = timedelta(days=7)


def weekly_city_temp(daily: DataFrame, as_of: datetime) -> DataFrame:
    """(city, date, daily_max_temp, daily_min_temp), ordered by city and date.

    The span is 168 hours back from ``as_of``, so the first day may be partial.
    Later issues are left out, so a rerun over a longer archive repeats the run.
    """
    since = as_of - SPAN
    rows = daily
    # Issue times are fixed-width text, so text order is time order and this
    # comparison reaches the Parquet statistics; a parsed time would not.
    first = since if since == since.replace(second=0, microsecond=0) else since + timedelta(minutes=1)
    issued = F.col("basetime")
    within = issued.between(f"{first:%Y%m%d%H%M}", f"{as_of:%Y%m%d%H%M}")
    rows = rows.where(within & is_stamp12(issued) & (F.col("T1H") != MISSING_TEMP) & ~F.isnan("T1H"))
    return (
        rows.groupBy("city", F.substring(issued, 1, 8).alias("day"))
        .agg(F.max("T1H").alias("daily_max_temp"), F.min("T1H").alias("daily_min_temp"))
        .select("city", parse_stamp8(F.col("day")).alias("date"), "daily_max_temp", "daily_min_temp")
        .orderBy("city", "date")
    )


def read_week(spark: SparkSession, root: str, as_of: datetime) -> DataFrame:
    """The eight day folders of the daily zone that the span touches; only they are listed."""
    return zones.read_days(spark, root, NOW, (as_of - SPAN).date(), as_of.date())


def write_weekly(table: DataFrame, target: str, fmt: str = "parquet", **options: str) -> None:
    """Overwrite the summary at a path, in any format Spark can write."""
    table.write.format(fmt).mode("overwrite").options(**options).save(target)
