"""Which features a map shows at a zoom level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.operators.dims import attach_tier
from skyledger.schemas import NAMES


def map_features(view: DataFrame, tiers: DataFrame, zoom: int) -> DataFrame:
    """Rows of a view whose city's tier is visible at ``zoom``."""
    tiered = attach_tier(view, tiers, NAMES["city"])
    return tiered.where(F.lit(zoom).between(F.col("min_zoom"), F.col("max_zoom")))


def cities_without_tier(view: DataFrame, tiers: DataFrame) -> DataFrame:
    """Cities that are in no tier list."""
    city = NAMES["city"]
    return view.select(city).distinct().join(tiers.withColumnRenamed("city", city), city, "left_anti")
