"""From payload codes to a weather key, and from a weather key to its severity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyledger import constants as C
from skyledger.functions.precipitation import first_number
from skyledger.functions.util import lookup


def _graded(amount: Column, light: tuple[float, str], medium: tuple[float, str], heavy: str) -> Column:
    return (
        F.when(amount < light[0], F.lit(light[1]))
        .when(amount < medium[0], F.lit(medium[1]))
        .when(amount.isNotNull(), F.lit(heavy))
    )


def rain_class(text: Column) -> Column:
    """Rain strength by millimetres; NULL for a text without a number."""
    return _graded(first_number(text), (3.0, "약한비"), (15.0, "비"), "강한비")


def snow_class(text: Column) -> Column:
    """Snow strength by centimetres; NULL for a text without a number."""
    return _graded(first_number(text), (1.0, "약한눈"), (5.0, "눈"), "강한눈")


def pty_class_short(pty: Column, pcp: Column, sno: Column) -> Column:
    return (
        F.when(pty == "1", rain_class(pcp))
        .when(pty == "2", F.lit("눈비"))
        .when(pty == "3", snow_class(sno))
        .when(pty == "4", F.lit("소나기"))
    )


def pty_class_ultra(pty: Column, rn1: Column) -> Column:
    return (
        F.when(pty.isin("1", "5"), rain_class(rn1))
        .when(pty.isin("2", "6"), F.lit("눈비"))
        .when(pty.isin("3", "7"), F.lit("눈"))
        .when(pty == "4", F.lit("소나기"))
    )


def sky_class(sky: Column) -> Column:
    """Cloud cover; anything unknown counts as clear."""
    return lookup(sky, {"3": "구름많음", "4": "흐림"}, F.lit("맑음"))


def lightning_class(lgt: Column) -> Column:
    return F.when(first_number(lgt) != 0.0, F.lit("번개,뇌우"))


def weather_key_short(pty: Column, sky: Column, pcp: Column, sno: Column) -> Column:
    return F.coalesce(pty_class_short(pty, pcp, sno), sky_class(sky))


def weather_key_ultra(pty: Column, sky: Column, lgt: Column, rn1: Column) -> Column:
    return F.coalesce(lightning_class(lgt), pty_class_ultra(pty, rn1), sky_class(sky))


def key_of_icon(icon_file: Column) -> Column:
    """Weather key of an icon file name: the text before the first ``_``."""
    return F.split_part(icon_file, F.lit("_"), F.lit(1))


def severity_ultra(key: Column) -> Column:
    return lookup(key, C.SEVERITY_ULTRA, F.lit(C.SEVERITY_OTHER))


def severity_short(key: Column) -> Column:
    return lookup(key, C.SEVERITY_SHORT, F.lit(C.SEVERITY_OTHER))
