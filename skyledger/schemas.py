"""Schemas of the payload, the raw rows, the latest-state tables and the documents."""

from __future__ import annotations

from pyspark.sql import types as T

from skyledger.constants import NOW, SHORT, ULTRA

STRING, DOUBLE, BIGINT, INT = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType()
WALL_CLOCK = T.TimestampNTZType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


POINT = struct(lng=DOUBLE, lat=DOUBLE)
ITEM = struct(category=STRING, obsrValue=STRING, fcstDate=STRING, fcstTime=STRING, fcstValue=STRING)

# One landed payload: what the API returned for one city and one issue, plus
# what only the fetcher knows (city, issue time, time of the call).
LANDING = struct(
    city=STRING,
    basetime=STRING,
    crawled_at=WALL_CLOCK,
    response=struct(body=struct(items=struct(item=T.ArrayType(ITEM)))),
)

_RAW_PLACE = dict(city=STRING, province=STRING, lat=DOUBLE, lng=DOUBLE, basetime=STRING)
_RAW_WIND = dict(VEC=BIGINT, WSD=DOUBLE, UUU=DOUBLE, VVV=DOUBLE)

RAW = {
    NOW: struct(**_RAW_PLACE, PTY=STRING, T1H=DOUBLE, REH=BIGINT, RN1=STRING, **_RAW_WIND),
    ULTRA: struct(
        **_RAW_PLACE,
        fcsthour=BIGINT,
        icon_map=STRING,
        PTY=STRING,
        SKY=STRING,
        T1H=DOUBLE,
        REH=BIGINT,
        RN1=STRING,
        LGT=STRING,
        **_RAW_WIND,
    ),
    SHORT: struct(
        **_RAW_PLACE,
        fcstdate=STRING,
        fcsthour=STRING,
        icon_map=STRING,
        PTY=STRING,
        SKY=STRING,
        TMP=DOUBLE,
        REH=BIGINT,
        PCP=STRING,
        SNO=STRING,
        POP=BIGINT,
        **_RAW_WIND,
    ),
}

_DEGREES, _CELSIUS, _SPEED = T.DecimalType(10, 6), T.DecimalType(4, 1), T.DecimalType(5, 1)
_STATE_PLACE = dict(city=STRING, province=STRING, lat=_DEGREES, lng=_DEGREES, basetime=STRING)

SNAPSHOT = {
    ULTRA: struct(
        **_STATE_PLACE,
        fcsthour=INT,
        icon_map=STRING,
        PTY=INT,
        SKY=INT,
        T1H=_CELSIUS,
        REH=INT,
        RN1=STRING,
        VEC=INT,
        WSD=_SPEED,
        geom=POINT,
    ),
    SHORT: struct(
        **_STATE_PLACE,
        fcstdate=STRING,
        fcsthour=STRING,
        icon_map=STRING,
        PTY=INT,
        SKY=INT,
        TMP=_CELSIUS,
        REH=INT,
        PCP=STRING,
        SNO=STRING,
        POP=INT,
        VEC=INT,
        WSD=_SPEED,
        geom=POINT,
    ),
}

SNAPSHOT_KEY = {
    ULTRA: ("city", "basetime", "fcsthour"),
    SHORT: ("city", "basetime", "fcstdate", "fcsthour"),
}

# What identifies a raw row.
RAW_KEY = {NOW: ("city", "basetime"), **SNAPSHOT_KEY}

DOCUMENT = struct(
    section=INT,
    text=STRING,
    ttl_seconds=INT,
    expires_at=WALL_CLOCK,
    cache_key=STRING,
)

# Output names of the views, as their readers know them.
NAMES = {
    "city": "도시",
    "temp": "기온",
    "icon": "아이콘",
    "weather": "날씨상태",
    "rain": "강수량",
    "snow": "강설량",
    "pop": "강수확률",
    "wind_dir": "풍향",
    "wind_speed": "풍속",
    "humidity": "습도",
}
