"""Wind names and temperature labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyledger.constants import COMPASS


def compass16(degrees: Column) -> Column:
    """Name of the 22.5 degree sector around a wind direction, 0 to 360; else NULL."""
    names = F.array(*[F.lit(name) for name in COMPASS])
    sector = F.floor((degrees + F.lit(11.25)) / F.lit(22.5)).cast("int") % len(COMPASS)
    return F.when(degrees.between(0, 360), F.get(names, sector))


def temp_label(high: Column, low: Column) -> Column:
    """``"high ~ low"`` of two decimals."""
    return F.concat(high.cast("string"), F.lit(" ~ "), low.cast("string"))
