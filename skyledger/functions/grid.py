"""Forecast grid cell of a coordinate (Lambert conformal conic)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyledger import constants as C

# The projection's own constants do not depend on the data, so they are worked
# out once here and enter the plan as literals.
_P1, _P2 = (math.radians(p) for p in C.GRID_PARALLELS)


def _half_angle_tan(lat_rad: float) -> float:
    return math.tan(math.pi / 4 + lat_rad / 2)


CONE = math.log(math.cos(_P1) / math.cos(_P2)) / math.log(_half_angle_tan(_P2) / _half_angle_tan(_P1))
SCALE = _half_angle_tan(_P1) ** CONE * math.cos(_P1) / CONE
RADIUS = C.GRID_EARTH_RADIUS_KM / C.GRID_CELL_KM * SCALE
ORIGIN_RHO = RADIUS / _half_angle_tan(math.radians(C.GRID_ORIGIN_LAT)) ** CONE


def grid_cell(lat: Column, lng: Column) -> Column:
    """``struct<nx int, ny int>`` of a WGS84 coordinate in degrees."""
    rho = F.lit(RADIUS) / F.pow(F.tan(F.radians(lat) / 2 + F.lit(math.pi / 4)), F.lit(CONE))
    turn = F.radians(lng) - F.lit(math.radians(C.GRID_ORIGIN_LNG))
    # atan2 folds the angle into (-pi, pi], so any longitude notation works
    theta = F.atan2(F.sin(turn), F.cos(turn)) * F.lit(CONE)
    x0, y0 = C.GRID_ORIGIN_CELL
    return F.struct(
        (rho * F.sin(theta) + F.lit(x0 + 0.5)).cast("int").alias("nx"),
        (F.lit(ORIGIN_RHO) - rho * F.cos(theta) + F.lit(y0 + 0.5)).cast("int").alias("ny"),
    )
