"""Spark side of the lens: raw rows, latest-state rows and payload documents."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.constants import NOW, SHORT, ULTRA
from skyledger.lens import formulas as L
from skyledger.schemas import RAW
from skyledger.sources.landing import parse_landing
from skyledger.sources.snapshot import conform

D = L.spark_sql


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def place(events: DataFrame, sf: str) -> DataFrame:
    """Events with the nation and region that play city and province."""
    spark = events.sparkSession
    nation, region = _table(spark, sf, "nation"), _table(spark, sf, "region")
    return events.join(nation, F.col("n_nationkey") == F.col("user_id") % 25).join(
        region, F.col("r_regionkey") == F.col("n_regionkey")
    )


def base(spark: SparkSession, sf: str) -> DataFrame:
    return place(_table(spark, sf, "events"), sf)


def regions(spark: SparkSession, sf: str) -> DataFrame:
    """The region dimension of the lens."""
    joined = _table(spark, sf, "nation").join(
        _table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey")
    )
    return joined.selectExpr(*_as(L.PLACE))


def _as(columns: dict[str, str]) -> list[str]:
    return [f"{text} AS `{name}`" for name, text in columns.items()]


_RAW = {NOW: L.raw_now, ULTRA: L.raw_ultra, SHORT: L.raw_short}


def raw(events: DataFrame, feed: str, *keep: str) -> DataFrame:
    """Raw rows of a feed, one per event."""
    typed = events.selectExpr(*_as(_RAW[feed](D)), *keep)
    return typed.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RAW[feed]], *keep)


def state(spark: SparkSession, sf: str, feed: str) -> DataFrame:
    """Latest-state rows of a feed, one per event."""
    return conform(raw(base(spark, sf), feed), feed)


# -- payloads ---------------------------------------------------------------
#
# The texts are put together as text: each value is worked out once, by compiled
# code. Values are plain (no character that JSON escapes), the city may be anything.


def _item(category: str, value: str, field: str = "fcstValue", at: str = "''") -> str:
    """An item as JSON text; ``at`` is the text of its forecast time."""
    start = f"""'{{"category":"{category}",', {at}, '"{field}":'"""
    return f"""concat({start}, coalesce(concat('"', CAST({value} AS STRING), '"'), 'null'), '}}')"""


def _at(day: str, hour: str) -> str:
    return f"""concat('"fcstDate":"', {day}, '","fcstTime":"', {hour}, '",')"""


def _with(i: int, text: str) -> str:
    """A formula over ``i`` for one value of it."""
    return re.sub(r"\bi\b", str(i), text)


def _document(events: DataFrame, basetime: str, items: list[str]) -> DataFrame:
    head = f"to_json(named_struct('city', n_name, 'basetime', {basetime}, 'crawled_at', ts), map('ignoreNullFields', 'false'))"
    start = f"""concat(substr({head}, 1, length({head}) - 1), ',"response":{{"body":{{"items":{{"item":[')"""
    # With a lambda, the projection is compiled as many short methods. As part of a whole stage it would be
    # one method, too long for the JIT, and run many times slower. What the lambda is over is not compiled.
    start = f"array_join(transform(array({start}), text -> text), '')"
    return events.selectExpr("event_id", f"concat({start}, concat_ws(',', {', '.join(items)}), ']}}}}}}}}') AS value")


def now_texts(events: DataFrame) -> DataFrame:
    """Nowcast payloads: a repeated category, a category left out, bad values."""
    n, c = L.numbers("event_id"), L.codes(D, "event_id")
    field = "obsrValue"
    items = [
        _item("T1H", "'99.9'", field),
        _item("PTY", c["PTY"], field),
        _item("T1H", L.temp("event_id"), field),
        *[_item(name, n[name], field) for name in ("VEC", "UUU", "VVV")],
        _item("WSD", L.wind_text(D, "event_id"), field),
        f"IF(event_id % 71 = 0, NULL, {_item('REH', n['REH'], field)})",
        f"IF(event_id % 10 = 0, NULL, {_item('RN1', L.sent_rain(D, 'event_id'), field)})",
    ]
    return _document(events, L.raw_now(D)["basetime"], items)


def ultra_texts(events: DataFrame) -> DataFrame:
    """Very-short payloads: some slots missing, one item beyond the horizon."""
    items = []
    for i in range(1, 8):
        k, at = _with(i, L.ULTRA_K), f"at{i}"
        n, c = L.numbers(k), L.codes(D, k)
        values = {
            "PTY": c["PTY"],
            "SKY": c["SKY"],
            "LGT": c["LGT"],
            "RN1": L.sent_rain(D, k),
            "T1H": L.temp(k),
            "REH": n["REH"],
            "VEC": n["VEC"],
            "WSD": L.wind_text(D, k),
            "UUU": n["UUU"],
            "VVV": n["VVV"],
        }
        slot = [_item("PTY", "'9'", at=at), *[_item(c, v, at=at) for c, v in values.items()]]
        items.append(f"IF({k} % 11 = 0, NULL, concat_ws(',', {', '.join(slot)}))")
    times = [f"{_at('day', L.slot_time(D, str(i)))} AS at{i}" for i in (*range(1, 8), 9)]
    timed = events.selectExpr("*", f"{D.ymd('ts')} AS day").selectExpr("*", *times)
    return _document(timed, L.raw_ultra(D)["basetime"], [*items, _item("T1H", "'0'", at="at9")])


def short_texts(events: DataFrame) -> DataFrame:
    """Short-forecast payloads: one forecast hour on each of five days."""
    items = []
    for i in range(5):
        k, at = _with(i, L.SHORT_K), f"at{i}"
        n, c = L.numbers(k), L.codes(D, k)
        values = {
            "PTY": D.text(f"{k} % 5"),
            "SKY": c["SKY"],
            "PCP": L.sent_rain(D, k),
            "SNO": L.sent_snow(D, k),
            "TMP": L.temp(k),
            **{name: n[name] for name in ("REH", "POP", "VEC", "UUU", "VVV")},
            "WSD": L.wind_text(D, k),
        }
        items += [_item("TMP", "'99.9'", at=at), *[_item(c, v, at=at) for c, v in values.items()]]
    times = [f"{_at(D.ymd(D.plus('ts', str(i))), _with(i, L.short_hour(D)))} AS at{i}" for i in range(5)]
    return _document(events.selectExpr("*", *times), f"{D.ymd('ts')} || '0500'", items)


def documents(events: DataFrame, feed: str) -> DataFrame:
    """Parsed payload documents of a feed, one per event."""
    texts = {NOW: now_texts, ULTRA: ultra_texts, SHORT: short_texts}[feed](events)
    return parse_landing(texts)
