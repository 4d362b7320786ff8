"""The forecast slots that follow an issue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.clock import horizon_slots

SLOTS = 7


def explode_slots(df: DataFrame, hour: Column, slots: int = SLOTS) -> DataFrame:
    """One row per slot: lead index ``fcsthour`` and ``HH00`` text ``fcsttime``."""
    return df.select("*", F.inline(horizon_slots(hour, slots)))


def within_horizon(df: DataFrame, hour: Column, fcsttime: Column, slots: int = SLOTS) -> DataFrame:
    """Rows whose forecast time is one of the slots, with their lead index.

    The slots are consecutive full hours, so the lead index is arithmetic: the
    join of slots and forecasts needs no second side and no shuffle.
    """
    lead = F.pmod(F.substring(fcsttime, 1, 2).try_cast("int") - hour, F.lit(24))
    return (
        df.where(fcsttime.rlike(r"^\d{2}00$"))
        .withColumn("fcsthour", lead.cast("long"))
        .where(F.col("fcsthour").between(1, slots))
    )
