"""GeoJSON documents, one per key, from the views."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.constants import DATE_GROUPS, LAYOUTS, TTL_SHORT, TTL_ULTRA
from skyledger.functions.clock import wall_clock
from skyledger.functions.geo import feature_json
from skyledger.plans.views import SHORT_VIEWS, ULTRA_VIEWS
from skyledger.schemas import DOCUMENT
from skyledger.sources.dimensions import inline_table
from skyledger.sources.documents import CLOSING, EMPTY, FIRST, OPENING, OTHER, cache_key, write_documents

Views = Mapping[str, Callable[[DataFrame], DataFrame]]


def ultrashort_keys(spark: SparkSession) -> DataFrame:
    rows = [(cache_key(layout), layout, TTL_ULTRA) for layout in LAYOUTS]
    return inline_table(spark, rows, ["cache_key", "layout", "ttl_seconds"])


def short_keys(spark: SparkSession, today: date) -> DataFrame:
    rows = [
        (cache_key(layout, group), layout, TTL_SHORT, f"{today + timedelta(days=offset):%Y%m%d}")
        for group, offset in DATE_GROUPS.items()
        for layout in LAYOUTS
    ]
    return inline_table(spark, rows, ["cache_key", "layout", "ttl_seconds", "fcstdate"])


def _features(view: DataFrame) -> DataFrame:
    properties = [c for c in view.columns if c != "geom"]
    kept = [c for c in ("fcstdate",) if c in view.columns]
    return view.select(*kept, feature_json(F.col("geom"), properties).alias("feature"))


def _all_features(rows: DataFrame, views: Views) -> DataFrame:
    parts = [_features(view(rows)).withColumn("layout", F.lit(layout)) for layout, view in views.items()]
    return reduce(DataFrame.unionByName, parts)


def ultrashort_features(rows: DataFrame) -> DataFrame:
    """(cache_key, feature): every feature of the four very-short documents."""
    keys = ultrashort_keys(rows.sparkSession)
    return _all_features(rows, ULTRA_VIEWS).join(keys, "layout").select("cache_key", "feature")


def short_features(rows: DataFrame, today: date) -> DataFrame:
    """(cache_key, feature): every feature of the sixteen short documents.

    Only the four dates that are published are read.
    """
    keys = short_keys(rows.sparkSession, today)
    dates = [f"{today + timedelta(days=offset):%Y%m%d}" for offset in DATE_GROUPS.values()]
    wanted = rows.where(F.col("fcstdate").isin(dates))
    return _all_features(wanted, SHORT_VIEWS).join(keys, ["layout", "fcstdate"]).select("cache_key", "feature")


def feature_counts(features: DataFrame, keys: DataFrame) -> DataFrame:
    """(cache_key, ttl_seconds, features) for every key, also for one without features."""
    counts = features.groupBy("cache_key").agg(F.count("feature").alias("features"))
    return keys.join(counts, "cache_key", "left").select(
        "cache_key", "ttl_seconds", F.coalesce("features", F.lit(0).cast("bigint")).alias("features")
    )


def documents(features: DataFrame, keys: DataFrame, as_of: datetime) -> DataFrame:
    """One feature collection per key, as lines ``(cache_key, section, text)``.

    The lines of a key in the order of section and text are its document: the
    opening, the least feature, every other feature after a comma, the closing.
    No task holds a whole document, whatever its size. Equal features share a
    line. A key without features gets the opening and the closing line.
    """
    counted = features.groupBy("cache_key", "feature").agg(F.count("*").cast("int").alias("n"))
    least = counted.groupBy("cache_key").agg(F.min("feature").alias("least"))
    first, more = F.col("feature") == F.col("least"), F.concat(F.lit(","), "feature")
    body = counted.join(least, "cache_key").select(
        "cache_key",
        F.when(first, FIRST).otherwise(OTHER).alias("section"),
        F.when(first, F.concat("feature", F.repeat(more, F.col("n") - 1))).otherwise(F.repeat(more, F.col("n"))).alias("text"),
    )
    frame = F.array(
        F.struct(F.lit(OPENING).alias("section"), F.lit(EMPTY[:-2]).alias("text")),
        F.struct(F.lit(CLOSING).alias("section"), F.lit(EMPTY[-2:]).alias("text")),
    )
    lines = body.unionByName(keys.select("cache_key", F.inline(frame)))
    start = wall_clock(as_of)
    ends = (start + F.make_dt_interval(secs=F.col("ttl_seconds").cast("decimal(18,6)"))).alias("expires_at")
    return lines.join(keys.select("cache_key", "ttl_seconds", ends), "cache_key").select(*DOCUMENT.names)


def publish_ultrashort(rows: DataFrame, root: str, as_of: datetime) -> None:
    """Replace the four ``ultrashort:<layout>`` documents."""
    write_documents(documents(ultrashort_features(rows), ultrashort_keys(rows.sparkSession), as_of), root)


def publish_short(rows: DataFrame, root: str, as_of: datetime) -> None:
    """Replace the sixteen ``short:<group>:<layout>`` documents."""
    keys = short_keys(rows.sparkSession, as_of.date())
    write_documents(documents(short_features(rows, as_of.date()), keys, as_of), root)
