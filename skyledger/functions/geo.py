"""Points and GeoJSON pieces."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# JSON writers skip NULL fields unless told otherwise; readers of the documents
# expect every property to be there.
KEEP_NULLS = {"ignoreNullFields": "false"}


def make_point(lng: Column, lat: Column) -> Column:
    """``struct<lng, lat>``; NULL unless both are known."""
    point = F.struct(lng.cast("double").alias("lng"), lat.cast("double").alias("lat"))
    return F.when(lng.isNotNull() & lat.isNotNull(), point)


def geometry(point: Column) -> Column:
    """GeoJSON geometry of a point."""
    body = F.struct(
        F.lit("Point").alias("type"),
        F.array(point["lng"], point["lat"]).alias("coordinates"),
    )
    return F.when(point.isNotNull(), body)


def feature_json(point: Column, properties: Iterable[str]) -> Column:
    """One GeoJSON feature as text."""
    body = F.struct(
        F.lit("Feature").alias("type"),
        geometry(point).alias("geometry"),
        F.struct(*properties).alias("properties"),
    )
    return F.to_json(body, KEEP_NULLS)

