"""From landed payloads to typed raw rows, one function per feed.

All three are narrow: a payload document holds everything of its city and
issue, so its items are pivoted inside the row. The only joins are those with
the small dimensions.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.constants import CATEGORIES, NOW, SHORT, ULTRA
from skyledger.functions import clock, icons, precipitation
from skyledger.functions.util import apart
from skyledger.operators.dims import attach_icon, attach_region
from skyledger.operators.horizon import SLOTS
from skyledger.operators.pivot import items_by_time, last_value, spans_of_times, time_key, time_keys, value_at
from skyledger.operators.typing import REJECTED, accepted, cast_numbers, rejected
from skyledger.schemas import RAW
from skyledger.sources.landing import with_items


def _wide(df: DataFrame, feed: str, items: Column, field: str) -> DataFrame:
    return df.withColumns({c: last_value(items, c, field) for c in CATEGORIES[feed]})


def _finish(df: DataFrame, feed: str, strict: bool) -> DataFrame:
    checks = {"city": apart(F.col("known_region")), "basetime": clock.is_stamp12(F.col("basetime"))}
    if feed == SHORT:
        checks["fcstdate"] = clock.is_stamp8(F.col("fcstdate"))
    if feed == ULTRA:
        checks["crawled_at"] = F.col("called").isNotNull()
    if feed != NOW:  # codes are numbers in the latest state; none at all is allowed
        checks |= {c: F.col(c).isNull() | F.trim(c).try_cast("int").isNotNull() for c in ("PTY", "SKY")}
    return cast_numbers(df, CATEGORIES[feed], checks, strict).select(*RAW[feed].names, REJECTED)


def parse_now(docs: DataFrame, regions: DataFrame, strict: bool = False) -> DataFrame:
    """One row per document, with the list of fields that were not usable."""
    items = F.col("items")
    reported = F.exists(items, lambda item: item["category"] == "RN1")
    # a payload without the category is not the same as one that says "none"
    rn1 = F.when(reported, precipitation.norm_rain_now(F.col("RN1"))).otherwise(F.lit("0"))
    wide = _wide(with_items(docs), NOW, items, "obsrValue").withColumn("RN1", rn1)
    return _finish(attach_region(wide, regions), NOW, strict)


def _slots(docs: DataFrame, groups: Column, *names: str) -> DataFrame:
    """One row per forecast time and its items; an empty document gives one empty row."""
    return docs.withColumn("slot", F.explode_outer(groups)).select(
        apart(F.col("city")).alias("city"), "basetime", "crawled_at", *[f"slot.{n}" for n in names], "slot.items"
    )


def parse_ultrashort(
    docs: DataFrame, regions: DataFrame, icon_dim: DataFrame, as_of: datetime | None = None, strict: bool = False
) -> DataFrame:
    """Up to seven rows per document: the full hours after the issue.

    Items are matched by hour alone. The icon folder follows the time of the
    call (``crawled_at``, else ``as_of``), not the forecast time. A row without
    either is set aside.
    """
    hour = apart(clock.base_hour(F.col("basetime")).try_cast("int"))
    # last item first, so that the first one found is the one that counts
    docs = with_items(docs).withColumns(
        {
            "hours": clock.horizon_slots(hour, SLOTS),
            "times": F.reverse(F.col("items.fcstTime")),
            "keys": F.reverse(time_keys(F.col("items"))),
            "values": F.reverse(F.col("items.fcstValue")),
        }
    )
    docs = spans_of_times(docs, "hours", SLOTS, "fcsttime", "times", "keys", "values")
    rows = docs.withColumn("slot", F.explode_outer(F.array_compact("spans"))).select(
        apart(F.col("city")).alias("city"), "basetime", "crawled_at", "slot.slot.*", "slot.keys", "slot.values"
    )
    wide = rows.withColumns(
        {c: value_at(F.col("keys"), F.col("values"), time_key(F.col("fcsttime"), F.lit(c))) for c in CATEGORIES[ULTRA]}
    ).drop("keys", "values")
    wide = wide.withColumn("RN1", precipitation.norm_rain(F.col("RN1")))
    key = icons.weather_key_ultra(F.col("PTY"), F.col("SKY"), F.col("LGT"), F.col("RN1"))
    wide = wide.withColumn("called", F.coalesce("crawled_at", clock.wall_clock(as_of)))
    folder = F.when(clock.is_daytime(F.col("called")), F.lit("day")).otherwise(F.lit("night"))
    with_icon = attach_icon(attach_region(wide, regions), icon_dim, key, folder)
    return _finish(with_icon, ULTRA, strict)


def parse_short(docs: DataFrame, regions: DataFrame, icon_dim: DataFrame, strict: bool = False) -> DataFrame:
    """One row per forecast date and hour of a document; icons are the day set."""
    rows = _slots(items_by_time(with_items(docs)), F.col("groups"), "fcstdate", "fcsthour")
    wide = _wide(rows, SHORT, F.col("items"), "fcstValue").withColumns(
        {
            "PCP": precipitation.norm_rain(F.col("PCP")),
            "SNO": precipitation.norm_snow(F.col("SNO")),
        }
    )
    key = icons.weather_key_short(F.col("PTY"), F.col("SKY"), F.col("PCP"), F.col("SNO"))
    with_icon = attach_icon(attach_region(wide, regions), icon_dim, key, F.lit("day"))
    return _finish(with_icon, SHORT, strict)


def parse(feed: str, docs: DataFrame, regions: DataFrame, icon_dim: DataFrame, **options: object) -> DataFrame:
    """Parse the documents of any feed."""
    if feed == NOW:
        options.pop("as_of", None)
        return parse_now(docs, regions, **options)
    if feed == ULTRA:
        return parse_ultrashort(docs, regions, icon_dim, **options)
    if feed == SHORT:
        options.pop("as_of", None)
        return parse_short(docs, regions, icon_dim, **options)
    raise ValueError(f"unknown feed: {feed}")


__all__ = ["accepted", "parse", "parse_now", "parse_short", "parse_ultrashort", "rejected"]
