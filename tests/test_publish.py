"""Documents as their readers parse them."""

from __future__ import annotations

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from weather import SHORT, ULTRA, frame, state

from skyledger.plans import mapview, publish, views
from skyledger.sources.dimensions import default_tiers, inline_table
from skyledger.sources.documents import EMPTY, cache_key, read_documents, read_geojson, write_documents

AS_OF = datetime(2024, 1, 3, 8, 0)


def joined(lines):
    """Lines in their order as one text."""
    return "".join(r["text"] for r in sorted(lines, key=lambda r: (r["section"], r["text"])))


def parsed(docs):
    by_key = {}
    for row in docs.collect():
        by_key.setdefault(row["cache_key"], []).append(row)
    return {key: json.loads(joined(lines)) for key, lines in by_key.items()}


def test_documents_hold_the_views(spark):
    rows = frame(spark, ULTRA, state(ULTRA, 60))
    docs = publish.documents(publish.ultrashort_features(rows), publish.ultrashort_keys(spark), AS_OF)
    got = parsed(docs)
    assert sorted(got) == ["ultrashort:cond", "ultrashort:humid", "ultrashort:rain", "ultrashort:wind"]
    wind = got["ultrashort:wind"]
    assert wind["type"] == "FeatureCollection"
    want = {r["도시"]: r for r in views.ultrashort_wind(rows).collect()}
    assert len(wind["features"]) == len(want)
    for feature in wind["features"]:
        row = want[feature["properties"]["도시"]]
        assert feature["type"] == "Feature"
        assert feature["geometry"] == {"type": "Point", "coordinates": [row["geom"]["lng"], row["geom"]["lat"]]}
        speed = None if row["풍속"] is None else float(row["풍속"])
        assert feature["properties"] == {"도시": row["도시"], "풍향": row["풍향"], "풍속": speed}
    cond = got["ultrashort:cond"]["features"][0]
    assert cond["properties"]["geometry"] == cond["geometry"]


def test_null_properties_and_points_stay(spark):
    rows = frame(spark, ULTRA, [{**r, "RN1": None, "geom": None} for r in state(ULTRA, 5, cities=1)])
    doc = publish.documents(publish.ultrashort_features(rows), publish.ultrashort_keys(spark), AS_OF)
    feature = parsed(doc)["ultrashort:rain"]["features"][0]
    assert feature["geometry"] is None and feature["properties"]["강수량"] is None


def test_date_groups_and_empty_documents(spark):
    rows = frame(spark, SHORT, state(SHORT, 200))  # 3, 4 and 5 January
    docs = publish.documents(publish.short_features(rows, AS_OF.date()), publish.short_keys(spark, AS_OF.date()), AS_OF)
    got = parsed(docs)
    assert len(got) == 16
    dates = {k.split(":")[1]: {f["properties"]["fcstdate"] for f in d["features"]} for k, d in got.items()}
    assert dates == {"today": {"20240103"}, "tomorrow": {"20240104"}, "dayafter": {"20240105"}, "twodaysafter": set()}
    assert joined(docs.where("cache_key = 'short:twodaysafter:rain'").collect()) == EMPTY
    assert {r["expires_at"] for r in docs.collect()} == {datetime(2024, 1, 3, 14, 0)}


def test_a_large_collection_is_one_document(spark, root):
    features = spark.range(5000).select(F.lit("ultrashort:cond").alias("cache_key"), F.concat(F.lit('{"n":'), "id", F.lit("}")).alias("feature"))
    write_documents(publish.documents(features, publish.ultrashort_keys(spark), AS_OF), root)
    lines = read_geojson(read_documents(spark, root), "cond", None, AS_OF)
    text = "".join(r["text"] for r in lines.collect())
    assert sorted(f["n"] for f in json.loads(text)["features"]) == list(range(5000))
    assert lines.groupBy("section").count().where("section != 2 and count > 1").isEmpty()


def test_publish_read_and_expiry(spark, root):
    ultra, short = frame(spark, ULTRA, state(ULTRA, 60)), frame(spark, SHORT, state(SHORT, 60))
    none = publish.documents(publish.ultrashort_features(ultra.where("false")), publish.ultrashort_keys(spark), AS_OF)
    assert joined(read_geojson(none.where("false"), "cond", None, AS_OF).collect()) == EMPTY
    publish.publish_ultrashort(ultra, root, AS_OF)
    publish.publish_short(short, root, AS_OF)
    publish.publish_short(short, root, AS_OF)  # again: replaced, not doubled
    store = read_documents(spark, root)
    assert len(parsed(store)) == 20

    def read(layout, group, at):
        return json.loads(joined(read_geojson(store, layout, group, at).collect()))["features"]

    assert read("cond", None, datetime(2024, 1, 3, 9, 59)) and not read("cond", None, datetime(2024, 1, 3, 10, 0))
    assert read("rain", "today", datetime(2024, 1, 3, 13, 59)) and not read("rain", "today", datetime(2024, 1, 3, 14, 0))


@pytest.mark.parametrize("zone", ["UTC", "Asia/Seoul", "America/Los_Angeles"])
def test_expiry_is_wall_clock_in_any_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = frame(spark, ULTRA, state(ULTRA, 5))
        docs = publish.documents(publish.ultrashort_features(rows), publish.ultrashort_keys(spark), AS_OF)
        assert {r["t"] for r in docs.selectExpr("CAST(expires_at AS STRING) AS t").collect()} == {"2024-01-03 10:00:00"}
        alive = read_geojson(docs, "cond", None, datetime(2024, 1, 3, 9, 59)).collect()
        assert joined(alive) != EMPTY
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_unknown_keys_are_refused():
    assert cache_key("wind", "dayafter") == "short:dayafter:wind"
    with pytest.raises(ValueError):
        cache_key("snow")
    with pytest.raises(ValueError):
        cache_key("cond", "yesterday")


@pytest.mark.parametrize("zoom,shown", [(6, set()), (7, {"서울"}), (8, {"서울", "인천"}), (9, {"서울", "인천", "수원"}),
                                        (10, {"서울", "인천", "수원"}), (11, {"서울", "인천", "수원", "광명"}),
                                        (20, {"서울", "인천", "수원", "광명"}), (21, set())])
def test_map_tiers(spark, zoom, shown):
    view = inline_table(spark, [(c, 1) for c in ("서울", "인천", "수원", "광명")], ["도시", "습도"])
    assert {r["도시"] for r in mapview.map_features(view, default_tiers(spark), zoom).collect()} == shown
    assert {r["도시"] for r in mapview.cities_without_tier(view, default_tiers(spark)).collect()} == {"광명"}


def test_keys_by_day(spark):
    got = {r["cache_key"]: r["fcstdate"] for r in publish.short_keys(spark, date(2024, 2, 27)).collect()}
    assert got["short:twodaysafter:humid"] == "20240301"
