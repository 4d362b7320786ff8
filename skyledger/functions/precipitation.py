"""Precipitation texts: normalising, reading a number, sort values, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyledger import constants as C
from skyledger.functions import clock
from skyledger.functions.util import lookup, none_text

NUMBER = r"\d+(\.\d+)?"
WHOLE_NUMBER = r"^[0-9]+(\.[0-9]+)?$"


def norm_rain_now(rn1: Column) -> Column:
    """Nowcast rain. A payload without the category reads as ``"0"`` and stays so."""
    return none_text(rn1, C.NO_RAIN_NOW, C.ZERO_RAIN)


def norm_rain(text: Column) -> Column:
    """Forecast rain (both forecast feeds)."""
    return none_text(text, C.NO_RAIN, C.ZERO_RAIN)


def norm_snow(text: Column) -> Column:
    return none_text(text, C.NO_SNOW, C.ZERO_SNOW)


def first_number(text: Column) -> Column:
    """First number in a text as DOUBLE; NULL when there is none."""
    return F.regexp_extract(text, NUMBER, 0).try_cast("double")


def _sort_value(text: Column, fixed: dict[str, float], number_type: str) -> Column:
    digits = F.regexp_replace(text, r"[^0-9.]", "").try_cast(number_type)
    # a text whose digits make no number ("30.0~50.0mm") sorts by its first one
    fallback = F.coalesce(digits.cast("double"), first_number(text), F.lit(0.0))
    return F.when(text.isNull(), F.lit(0.0)).otherwise(lookup(text, fixed, fallback))


def rain_order_ultra(rn1: Column) -> Column:
    return _sort_value(rn1, C.RAIN_ORDER, "decimal(4,1)")


def rain_order_short(pcp: Column) -> Column:
    return _sort_value(pcp, {**C.RAIN_ORDER, **C.RAIN_CODE_ORDER}, "decimal(20,6)")


def snow_order(sno: Column) -> Column:
    return _sort_value(sno, {**C.SNOW_ORDER, **C.SNOW_CODE_ORDER}, "decimal(20,6)")


def rain_label_ultra(rn1: Column, strict: bool = False) -> Column:
    """Rain text with its unit.

    The historical rule (``strict``) adds ``mm`` to every text but the four
    fixed ones, even when the unit is there already ("3.5mm" -> "3.5mmmm"). By
    default only bare numbers get it.
    """
    if strict:
        bare = ~rn1.isin(*C.RAIN_ORDER)
    else:
        bare = rn1.rlike(WHOLE_NUMBER)
    return F.when(bare, F.concat(rn1, F.lit("mm"))).otherwise(rn1)


def _label_short(text: Column, fcstdate: Column, basetime: Column, codes: dict[str, str], unit: str) -> Column:
    last_day = fcstdate == clock.days_after(basetime, 3)
    hour = clock.base_hour(basetime)
    return (
        F.when(last_day & hour.isin(*C.CODE_BASE_HOURS) & text.isin(*codes), lookup(text, codes))
        .when(last_day & hour.isin(*C.NUMBER_BASE_HOURS) & text.rlike(WHOLE_NUMBER), F.concat(text, F.lit(unit)))
        .otherwise(text)
    )


def rain_label_short(pcp: Column, fcstdate: Column, basetime: Column) -> Column:
    """Rain text; three days ahead, codes become words and numbers get a unit."""
    return _label_short(pcp, fcstdate, basetime, C.RAIN_CODE_TEXT, "mm")


def snow_label_short(sno: Column, fcstdate: Column, basetime: Column) -> Column:
    return _label_short(sno, fcstdate, basetime, C.SNOW_CODE_TEXT, "cm")
