"""Landed payloads: one JSON document per city and issue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.schemas import LANDING


def read_landing(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LANDING).json(path)


def stream_landing(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(LANDING)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def parse_landing(texts: DataFrame, column: str = "value") -> DataFrame:
    """The same from a text column (a queue, a table).

    The generator keeps the optimizer from parsing the text once per field.
    """
    return texts.select(F.inline(F.array(F.from_json(column, LANDING.simpleString()))))


def with_items(docs: DataFrame) -> DataFrame:
    """Documents with their item array on top level as ``items``."""
    return docs.withColumn("items", F.col("response.body.items.item")).drop("response")


def explode_items(docs: DataFrame) -> DataFrame:
    """One row per item, with its place in the payload as ``pos``."""
    rows = with_items(docs).select("city", "basetime", F.posexplode("items").alias("pos", "item"))
    return rows.select(
        "city",
        "basetime",
        "pos",
        "item.category",
        "item.fcstDate",
        "item.fcstTime",
        F.coalesce("item.fcstValue", "item.obsrValue").alias("value"),
    )
