"""Store of the published documents."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.constants import DATE_GROUPS, LAYOUTS
from skyledger.functions.clock import wall_clock
from skyledger.schemas import DOCUMENT

# Lines of a document by section, then text.
OPENING, FIRST, OTHER, CLOSING = range(4)
EMPTY = '{"type":"FeatureCollection","features":[]}'


def cache_key(layout: str, group: str | None = None) -> str:
    """``ultrashort:<layout>``, or ``short:<group>:<layout>`` with a date group."""
    if layout not in LAYOUTS:
        raise ValueError(f"unknown layout: {layout}")
    if group is None:
        return f"ultrashort:{layout}"
    if group not in DATE_GROUPS:
        raise ValueError(f"unknown date group: {group}")
    return f"short:{group}:{layout}"


def write_documents(docs: DataFrame, root: str) -> None:
    """Replace the documents of the keys in ``docs``; other keys stay."""
    (
        docs.select(*DOCUMENT.names)
        .repartitionByRange("cache_key", "section", "text")
        .sortWithinPartitions("cache_key", "section", "text")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("cache_key")
        .parquet(root)
    )


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(DOCUMENT).parquet(root)


def read_geojson(docs: DataFrame, layout: str, group: str | None, as_of: datetime) -> DataFrame:
    """Document of one key as lines (cache_key, section, text), in order.

    A key that is missing or has run out gives an empty collection. The key
    prunes the store to one folder.
    """
    key = cache_key(layout, group)
    lines = serve(docs, docs.sparkSession.range(1).select(F.lit(key).alias("cache_key")), as_of)
    return lines.orderBy("section", "text")


def serve(docs: DataFrame, keys: DataFrame, as_of: datetime) -> DataFrame:
    """The same for a table of keys."""
    valid = docs.where(F.col("expires_at") > wall_clock(as_of))
    found = keys.join(valid, "cache_key", "left")
    return found.select(
        "cache_key",
        F.coalesce("section", F.lit(OPENING)).alias("section"),
        F.coalesce("text", F.lit(EMPTY)).alias("text"),
    )
