"""Joins with the small dimensions.

No broadcast hints: the inline dimensions have exact sizes and files have
statistics, so the optimizer broadcasts a side it knows to be below
``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles, where AQE
splits a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.constants import OTHER_TIER, TIER_MAX_ZOOM, TIER_MIN_ZOOM
from skyledger.functions.grid import grid_cell
from skyledger.functions.util import apart, lookup


def with_grid(regions: DataFrame) -> DataFrame:
    """Regions with the grid cell a fetcher asks the API for."""
    return regions.select("*", grid_cell(F.col("lat"), F.col("lng")).alias("cell")).select(
        *regions.columns, "cell.nx", "cell.ny"
    )


def attach_region(df: DataFrame, regions: DataFrame, by: str = "city") -> DataFrame:
    """Province and coordinates of each row's city (or of its grid cell).

    ``known_region`` tells whether there is one; no row is dropped.
    """
    known = regions.select("city", "province", "lat", "lng", F.lit(True).alias("known_region"))
    if by == "city":
        joined = df.join(known, "city", "left")
    elif by == "grid":
        joined = df.drop("city").join(with_grid(known), ["nx", "ny"], "left")
    else:
        raise ValueError(f"unknown region key: {by}")
    return joined.withColumn("known_region", apart(F.coalesce("known_region", F.lit(False))))


def attach_icon(df: DataFrame, icons: DataFrame, key: Column, folder: Column) -> DataFrame:
    """Icon file of a weather key as ``icon_map``; NULL for an unknown key."""
    keyed = df.withColumn("weather_key", key).withColumn("folder", folder)
    return (
        keyed.join(icons, ["folder", "weather_key"], "left")
        .withColumnRenamed("icon_file", "icon_map")
        .drop("folder", "weather_key")
    )


def attach_tier(df: DataFrame, tiers: DataFrame, city: str) -> DataFrame:
    """Display tier and zoom range; a city in no list is in the last tier."""
    joined = df.join(tiers.withColumnRenamed("city", city), city, "left")
    tier = F.coalesce(F.col("tier"), F.lit(OTHER_TIER))
    zooms = {str(k): v for k, v in TIER_MIN_ZOOM.items()}
    return (
        joined.withColumn("tier", tier)
        .withColumn("min_zoom", lookup(F.col("tier").cast("string"), zooms))
        .withColumn("max_zoom", F.lit(TIER_MAX_ZOOM))
    )
