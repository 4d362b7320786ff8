"""The jobs end to end, as a scheduler calls them."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from test_ingest import NOW_VALUES, SHORT_VALUES, ULTRA_VALUES, doc, forecast, observed

from skyledger import jobs
from skyledger.constants import FEEDS, NOW, SHORT, ULTRA
from skyledger.sources import zones
from skyledger.sources.documents import read_documents, read_geojson


def documents(feed, city, day):
    stamp = f"{day:%Y%m%d}"
    if feed == NOW:
        return doc(city, f"{stamp}0500", observed(**NOW_VALUES))
    if feed == ULTRA:
        return doc(city, f"{stamp}0530", forecast(stamp, "0600", **ULTRA_VALUES))
    return doc(city, f"{stamp}0500", [
        item for n in range(5) for item in forecast(f"{day + timedelta(days=n):%Y%m%d}", "0600", **SHORT_VALUES)])


@pytest.mark.parametrize("feed", FEEDS)
def test_from_landing_to_the_archive_and_documents(spark, root, tmp_path, feed):
    day = datetime(2024, 1, 31)
    (tmp_path / "landing").mkdir()
    (tmp_path / "landing/1.json").write_text(
        "\n".join(json.dumps(documents(feed, c, day), ensure_ascii=False) for c in ("서울", "부산")), encoding="utf-8")
    (tmp_path / "region.json").write_text(json.dumps({
        "서울": {"province": "p", "lat": 37.5, "lng": 127.0}, "부산": {"province": "p", "lat": 35.1, "lng": 129.0}}), encoding="utf-8")
    state = [] if feed == NOW else ["--state", f"{root}/state"]
    jobs.main(["ingest", "--feed", feed, "--as-of", "2024-01-31T05:50", "--landing", f"{root}/landing", "--regions",
               f"{root}/region.json", "--raw", f"{root}/raw", "--rejects", f"{root}/rejects", "--checkpoint", f"{root}/checkpoint", *state])
    jobs.main(["daily", "--feed", feed, "--as-of", "2024-02-01", "--source", f"{root}/raw", "--target", f"{root}/daily"])
    jobs.main(["monthly", "--feed", feed, "--as-of", "2024-02-01", "--source", f"{root}/daily", "--target", f"{root}/monthly"])
    jobs.main(["yearly", "--feed", feed, "--as-of", "2025-01-01", "--source", f"{root}/monthly", "--target", f"{root}/yearly"])
    count = {NOW: 2, ULTRA: 2, SHORT: 10}[feed]
    assert zones.read_zone(spark, f"{root}/yearly", feed).count() == count
    if feed == NOW:
        jobs.main(["weekly", "--as-of", "2024-02-01T01:00", "--source", f"{root}/daily", "--target", f"{root}/summary"])
        assert sorted(r["city"] for r in spark.read.parquet(f"{root}/summary").collect()) == ["부산", "서울"]
        return
    command, group = {ULTRA: ("publish-ultrashort", None), SHORT: ("publish-short", "twodaysafter")}[feed]
    jobs.main([command, "--as-of", "2024-01-31T06:00", "--state", f"{root}/state", "--target", f"{root}/documents"])
    found = read_geojson(read_documents(spark, f"{root}/documents"), "cond", group, datetime(2024, 1, 31, 7, 0)).collect()
    assert {f["properties"]["도시"] for f in json.loads("".join(r["text"] for r in found))["features"]} == {"서울", "부산"}


def test_a_missing_day_is_an_error(spark, root):
    with pytest.raises(FileNotFoundError):
        jobs.main(["daily", "--feed", NOW, "--as-of", "2024-02-01", "--source", f"{root}/none", "--target", f"{root}/daily"])
