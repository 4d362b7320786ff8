"""Landed payload files to raw rows."""

from __future__ import annotations

import json
import re
from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from skyledger.constants import NOW, SHORT, ULTRA
from skyledger.operators.dims import attach_region, with_grid
from skyledger.operators.pivot import items_by_time, items_to_wide
from skyledger.plans import ingest
from skyledger.plans.latest import latest_rows
from skyledger.schemas import RAW
from skyledger.sources.dimensions import default_icons, load_icons, load_regions
from skyledger.sources.landing import explode_items, parse_landing, read_landing, with_items


def doc(city, basetime, items, crawled_at=None):
    body = {"response": {"header": {"resultCode": "00"}, "body": {"items": {"item": items}}}}
    return {"city": city, "basetime": basetime, "crawled_at": crawled_at, **body}


def observed(**values):
    return [{"category": c, "obsrValue": v} for c, v in values.items()]


def forecast(date, time, **values):
    return [{"category": c, "fcstDate": date, "fcstTime": time, "fcstValue": v} for c, v in values.items()]


NOW_VALUES = dict(PTY="0", T1H="3.4", REH="55", RN1="0", VEC="200", WSD="1.5", UUU="0.1", VVV="-0.2")
ULTRA_VALUES = dict(PTY="1", SKY="3", LGT="0", RN1="강수없음", T1H="3", REH="55", VEC="200", WSD="1.5", UUU="0", VVV="0")
SHORT_VALUES = dict(PTY="0", SKY="4", PCP="강수없음", SNO="적설없음", TMP="3", REH="55", POP="30", VEC="200", WSD="1.5",
                    UUU="0", VVV="0")


@pytest.fixture
def land(spark, tmp_path):
    def write(*docs, name="issue.json"):
        folder = tmp_path / "landing"
        folder.mkdir(exist_ok=True)
        (folder / name).write_text("\n".join(json.dumps(d, ensure_ascii=False) for d in docs), encoding="utf-8")
        return read_landing(spark, f"file://{folder}")

    return write


@pytest.fixture
def regions(spark, tmp_path):
    path = tmp_path / "region.json"
    path.write_text(json.dumps({
        "서울": {"province": "서울특별시", "lat": 37.5665, "lng": 126.9780},
        "부산": {"province": "부산광역시", "lat": 35.1796, "lng": 129.0756},
    }, ensure_ascii=False, indent=1), encoding="utf-8")
    return load_regions(spark, f"file://{path}")


def test_regions_and_icons_from_json(spark, tmp_path, regions):
    assert {tuple(r) for r in regions.collect()} == {
        ("서울", "서울특별시", 37.5665, 126.978), ("부산", "부산광역시", 35.1796, 129.0756)}
    path = tmp_path / "icons.json"
    path.write_text(json.dumps({"icons": {"day": {"비": "비_d.png"}, "night": {"비": "비_n.png"}}}), encoding="utf-8")
    assert {tuple(r) for r in load_icons(spark, f"file://{path}").collect()} == {
        ("day", "비", "비_d.png"), ("night", "비", "비_n.png")}
    standard = default_icons(spark)
    assert standard.count() == 28
    assert standard.where("folder = 'night' AND weather_key = '번개,뇌우'").first()["icon_file"] == "번개,뇌우_n.png"


def test_now(land, regions):
    rows = ingest.parse_now(land(
        doc("서울", "202401010500", observed(T1H="99", **{k: v for k, v in NOW_VALUES.items() if k != "T1H"}) + observed(T1H="3.4")),
        doc("부산", "202401010500", observed(**{**NOW_VALUES, "RN1": None})),
        doc("어디", "202401010500", observed(**NOW_VALUES)),
    ), regions)
    got = {r["city"]: r for r in ingest.accepted(rows).collect()}
    assert set(got) == {"서울", "부산"}
    assert got["서울"].asDict() == {
        "city": "서울", "province": "서울특별시", "lat": 37.5665, "lng": 126.978, "basetime": "202401010500",
        "PTY": "0", "T1H": 3.4, "REH": 55, "RN1": "0", "VEC": 200, "WSD": 1.5, "UUU": 0.1, "VVV": -0.2}
    assert got["부산"]["RN1"] == "0mm"
    assert [(r["city"], r["rejected_fields"]) for r in ingest.rejected(rows).collect()] == [("어디", ["city"])]
    assert ingest.accepted(rows).schema.names == RAW[NOW].names


def test_now_without_the_rain_category(land, regions):
    values = {k: v for k, v in NOW_VALUES.items() if k != "RN1"}
    assert ingest.parse_now(land(doc("서울", "202401010500", observed(**values))), regions).first()["RN1"] == "0"


def test_bad_values_are_set_aside_or_fail(land, regions):
    docs = land(
        doc("서울", "202401010500", observed(**{**NOW_VALUES, "WSD": "x", "REH": "5.0"})),
        doc("부산", "202401010500", []),
    )
    rows = ingest.parse_now(docs, regions)
    assert ingest.accepted(rows).count() == 0
    bad = {r["city"]: r["rejected_fields"] for r in ingest.rejected(rows).collect()}
    assert bad["서울"] == ["REH", "WSD"]
    assert set(bad["부산"]) == {"T1H", "REH", "VEC", "WSD", "UUU", "VVV"}
    with pytest.raises(PySparkException, match="unusable"):
        ingest.parse_now(docs, regions, strict=True).collect()


def test_ultrashort_slots(spark, land, regions):
    items = (
        forecast("20240101", "0000", **ULTRA_VALUES)
        + forecast("20240102", "0000", T1H="8")  # same hour, later date: the last wins
        + forecast("20240101", "2300", **{**ULTRA_VALUES, "LGT": "1.2"})
        + forecast("20240102", "0600", **ULTRA_VALUES)  # beyond the horizon
    )
    docs = land(doc("서울", "202401012230", items, "2024-01-01T22:50:00"), doc("부산", "202401012230", []))
    rows = ingest.parse_ultrashort(docs, regions, default_icons(spark))
    got = {r["fcsthour"]: r for r in ingest.accepted(rows).collect()}
    assert set(got) == {1, 2}
    assert got[1]["icon_map"] == "번개,뇌우_n.png"
    assert (got[2]["T1H"], got[2]["RN1"], got[2]["icon_map"]) == (8.0, "0mm", "약한비_n.png")
    assert [r["city"] for r in ingest.rejected(rows).collect()] == ["부산"]
    noon = land(doc("서울", "202401012230", items))
    by_clock = ingest.parse_ultrashort(noon, regions, default_icons(spark), as_of=datetime(2024, 1, 1, 12, 0))
    assert {r["icon_map"] for r in by_clock.collect()} == {"번개,뇌우_d.png", "약한비_d.png"}


def test_short_dates_and_latest_state(spark, land, regions):
    items = [i for day in range(1, 6) for i in forecast(f"202401{day:02d}", "0600", **SHORT_VALUES)]
    items += forecast("20240102", "0700", **{**SHORT_VALUES, "PTY": "3", "SNO": "5cm"})
    rows = ingest.accepted(ingest.parse_short(land(doc("서울", "202401010500", items)), regions, default_icons(spark)))
    assert rows.count() == 6
    snow = rows.where("fcsthour = '0700'").first()
    assert (snow["icon_map"], snow["SNO"], snow["PCP"]) == ("강한눈_d.png", "5cm", "0mm")
    kept = latest_rows(rows, SHORT)
    assert {r["fcstdate"] for r in kept.collect()} == {"20240101", "20240102", "20240103", "20240104"}
    assert not {"LGT", "UUU", "VVV"} & set(kept.columns)


def test_bad_dates_are_set_aside(spark, land, regions):
    items = forecast("20240230", "0600", **SHORT_VALUES) + forecast("20240229", "0600", **SHORT_VALUES)
    rows = ingest.parse_short(land(doc("서울", "202402280500", items)), regions, default_icons(spark))
    assert [r["fcstdate"] for r in ingest.accepted(rows).collect()] == ["20240229"]
    assert [r["rejected_fields"] for r in ingest.rejected(rows).collect()] == [["fcstdate"]]
    now = ingest.parse_now(land(doc("서울", "2024022805", observed(**NOW_VALUES))), regions)
    assert [r["rejected_fields"] for r in now.collect()] == [["basetime"]]


def test_text_source_equals_files(spark, land, regions):
    document = doc("서울", "202401010500", observed(**NOW_VALUES))
    texts = spark.createDataFrame([(json.dumps(document, ensure_ascii=False),), ("no json",)], "value string")
    from_text = ingest.parse_now(parse_landing(texts), regions)
    assert ingest.accepted(from_text).collect() == ingest.accepted(ingest.parse_now(land(document), regions)).collect()
    assert ingest.rejected(from_text).count() == 1  # what could not be read is kept aside


def test_long_items_pivot_like_documents(land):
    docs = land(doc("서울", "202401010500", observed(T1H="1", REH="5") + observed(T1H="2")))
    wide = items_to_wide(explode_items(docs), ["city", "basetime"], ["T1H", "REH", "WSD"]).first()
    assert (wide["T1H"], wide["REH"], wide["WSD"]) == ("2", "5", None)


def test_long_items_of_equal_places(spark):
    """The pivot does not depend on the order of the rows; a last item without a value counts."""
    rows = [("a", 1, "T1H", "5"), ("a", 1, "T1H", "7"), ("a", 0, "T1H", "9"), ("a", 0, "REH", "3"), ("a", 2, "REH", None), ("a", 3, "X", "1")]
    for order in (rows, rows[::-1]):
        items = spark.createDataFrame(order, "city string, pos int, category string, value string").coalesce(1)
        assert [tuple(r) for r in items_to_wide(items, ["city"], ["T1H", "REH"]).collect()] == [("a", "7", None)]


def test_items_by_time_meet_side_by_side(spark, land):
    """Items of a time are found together wherever they stand; no lambda looks them up in the array by an index."""
    mixed = [i for pair in zip(forecast("20240102", "0600", TMP="1", REH="2"), forecast("20240101", "0600", TMP="3", REH="4"), strict=True) for i in pair]
    docs = land(doc("서울", "202401010500", mixed), doc("부산", "202401010500", []), doc("광주", "202401010500", None))
    got = items_by_time(with_items(docs))
    groups = {r["city"]: r["groups"] for r in got.collect()}
    assert [(g["fcstdate"], [(i["category"], i["fcstValue"]) for i in g["items"]]) for g in groups["서울"]] == [
        ("20240101", [("TMP", "3"), ("REH", "4")]), ("20240102", [("TMP", "1"), ("REH", "2")])]
    assert not groups["부산"] and not groups["광주"]
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(arrays_zip(" in text and not re.search(r"by_time#\d+\[lambda", text)


def test_region_by_grid_cell(spark, regions):
    cells = with_grid(regions)
    assert {(r["city"], r["nx"], r["ny"]) for r in cells.collect()} == {("서울", 60, 127), ("부산", 98, 76)}
    sent = spark.createDataFrame([(60, 127, "x")], "nx int, ny int, value string")
    assert attach_region(sent, regions, by="grid").first()["city"] == "서울"
    away = attach_region(sent.withColumn("nx", F.lit(1)), regions, by="grid").first()
    assert (away["city"], away["known_region"]) == (None, False)


def test_any_feed(spark, land, regions):
    docs = land(doc("서울", "202401010500", observed(**NOW_VALUES)))
    assert ingest.parse(NOW, docs, regions, default_icons(spark), as_of=None).count() == 1
    assert ingest.parse(ULTRA, docs, regions, default_icons(spark)).where(F.size("rejected_fields") == 0).count() == 0
    with pytest.raises(ValueError):
        ingest.parse("other", docs, regions, default_icons(spark))
