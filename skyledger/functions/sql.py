"""The scalar rules as temporary SQL functions, for users who write SQL.

SQL functions are inlined by the optimizer, so a query that uses them plans
like one written with the Column functions.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import SparkSession

from skyledger import constants as C
from skyledger.functions import grid


def _case(key: str, table: Mapping[str, object], default: str = "NULL") -> str:
    def literal(value: object) -> str:
        return f"'{value}'" if isinstance(value, str) else str(value)

    whens = " ".join(f"WHEN '{name}' THEN {literal(value)}" for name, value in table.items())
    return f"CASE {key} {whens} ELSE {default} END"


def _grid_body() -> str:
    rho = f"({grid.RADIUS!r}D / pow(tan(radians(lat) / 2 + {math.pi / 4!r}D), {grid.CONE!r}D))"
    turn = f"(radians(lng) - {math.radians(C.GRID_ORIGIN_LNG)!r}D)"
    theta = f"(atan2(sin({turn}), cos({turn})) * {grid.CONE!r}D)"
    x0, y0 = C.GRID_ORIGIN_CELL
    return (
        f"named_struct('nx', CAST({rho} * sin({theta}) + {x0 + 0.5!r}D AS INT),"
        f" 'ny', CAST({grid.ORIGIN_RHO!r}D - {rho} * cos({theta}) + {y0 + 0.5!r}D AS INT))"
    )


def _at(day: str, hour: str, minute: int) -> str:
    return f"make_timestamp_ntz(year({day}), month({day}), day({day}), {hour}, {minute}, 0)"


_ULTRA_SHIFT = "(t - make_dt_interval(0, IF(minute(t) < 45, 1, 0)))"
_SHORT_SHIFT = "(t - make_dt_interval(0, 2))"
_SHORT_SLOT = f"hour({_SHORT_SHIFT}) - hour({_SHORT_SHIFT}) % 3"
_NAMES = ", ".join(f"'{name}'" for name in C.COMPASS)

# name -> (parameters, return type, body)
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "first_number": ("s STRING", "DOUBLE", r"try_cast(regexp_extract(s, r'\d+(\.\d+)?', 0) AS DOUBLE)"),
    "rain_class": (
        "s STRING",
        "STRING",
        "CASE WHEN first_number(s) < 3 THEN '약한비' WHEN first_number(s) < 15 THEN '비'"
        " WHEN first_number(s) >= 15 THEN '강한비' END",
    ),
    "snow_class": (
        "s STRING",
        "STRING",
        "CASE WHEN first_number(s) < 1 THEN '약한눈' WHEN first_number(s) < 5 THEN '눈'"
        " WHEN first_number(s) >= 5 THEN '강한눈' END",
    ),
    "sky_class": ("sky STRING", "STRING", _case("sky", {"3": "구름많음", "4": "흐림"}, "'맑음'")),
    "weather_key_short": (
        "pty STRING, sky STRING, pcp STRING, sno STRING",
        "STRING",
        "coalesce(CASE pty WHEN '1' THEN rain_class(pcp) WHEN '2' THEN '눈비' WHEN '3' THEN snow_class(sno)"
        " WHEN '4' THEN '소나기' END, sky_class(sky))",
    ),
    "weather_key_ultra": (
        "pty STRING, sky STRING, lgt STRING, rn1 STRING",
        "STRING",
        "coalesce(CASE WHEN first_number(lgt) <> 0 THEN '번개,뇌우' WHEN pty IN ('1', '5') THEN rain_class(rn1)"
        " WHEN pty IN ('2', '6') THEN '눈비' WHEN pty IN ('3', '7') THEN '눈' WHEN pty = '4' THEN '소나기' END,"
        " sky_class(sky))",
    ),
    "severity_ultra": ("key STRING", "INT", _case("key", C.SEVERITY_ULTRA, str(C.SEVERITY_OTHER))),
    "severity_short": ("key STRING", "INT", _case("key", C.SEVERITY_SHORT, str(C.SEVERITY_OTHER))),
    "compass16": (
        "degrees INT",
        "STRING",
        f"CASE WHEN degrees BETWEEN 0 AND 360 THEN get(array({_NAMES}),"
        " CAST(floor((degrees + 11.25D) / 22.5D) AS INT) % 16) END",
    ),
    "is_daytime": (
        "t TIMESTAMP_NTZ",
        "BOOLEAN",
        "CASE WHEN month(t) BETWEEN 6 AND 8 THEN hour(t) BETWEEN 5 AND 19"
        " WHEN month(t) BETWEEN 3 AND 5 OR month(t) BETWEEN 9 AND 11 THEN hour(t) BETWEEN 6 AND 18"
        " ELSE hour(t) BETWEEN 8 AND 17 END",
    ),
    "base_time_now": ("t TIMESTAMP_NTZ", "TIMESTAMP_NTZ", _at("t", "hour(t)", 0)),
    "base_time_ultra": ("t TIMESTAMP_NTZ", "TIMESTAMP_NTZ", _at(_ULTRA_SHIFT, f"hour({_ULTRA_SHIFT})", 30)),
    "base_time_short": (
        "t TIMESTAMP_NTZ",
        "TIMESTAMP_NTZ",
        f"{_at(_SHORT_SHIFT, _SHORT_SLOT, 0)} + make_dt_interval(0, 2)",
    ),
    "grid_cell": ("lat DOUBLE, lng DOUBLE", "STRUCT<nx: INT, ny: INT>", _grid_body()),
}


def register_functions(spark: SparkSession) -> None:
    for name, (parameters, returns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")
