"""Region, icon and tier dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.constants import ICON_SUFFIX, TIER_CITIES, WEATHER_KEYS

_REGION_JSON = "map<string, struct<province: string, lat: double, lng: double>>"
_ICON_JSON = "struct<icons: map<string, map<string, string>>>"


def inline_table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A table of fixed rows inside the plan, whose exact size the optimizer knows."""
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def load_regions(spark: SparkSession, path: str) -> DataFrame:
    """``{city: {province, lat, lng}}`` JSON as one row per city."""
    doc = spark.read.text(path, wholetext=True)
    return doc.select(F.explode(F.from_json("value", _REGION_JSON)).alias("city", "info")).select("city", "info.*")


def load_icons(spark: SparkSession, path: str) -> DataFrame:
    """``{"icons": {folder: {weather key: file}}}`` JSON as one row per icon."""
    doc = spark.read.text(path, wholetext=True)
    return (
        doc.select(F.from_json("value", _ICON_JSON)["icons"].alias("icons"))
        .select(F.explode("icons").alias("folder", "files"))
        .select("folder", F.explode("files").alias("weather_key", "icon_file"))
    )


def default_icons(spark: SparkSession) -> DataFrame:
    """The standard icon set: weather key plus the folder's suffix."""
    rows = [(folder, key, key + suffix) for folder, suffix in ICON_SUFFIX.items() for key in WEATHER_KEYS]
    return inline_table(spark, rows, ["folder", "weather_key", "icon_file"])


def default_tiers(spark: SparkSession) -> DataFrame:
    """Cities with a display tier of their own."""
    rows = [(city, tier) for tier, cities in TIER_CITIES.items() for city in cities]
    return inline_table(spark, rows, ["city", "tier"])
