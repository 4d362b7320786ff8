"""Streams end at the state a batch would have."""

from __future__ import annotations

import json

import pytest
from test_ingest import NOW_VALUES, ULTRA_VALUES, doc, forecast, observed

from skyledger.constants import NOW, ULTRA
from skyledger.plans import ingest
from skyledger.sources import zones
from skyledger.sources.dimensions import default_icons, inline_table
from skyledger.sources.landing import read_landing, stream_landing
from skyledger.sources.snapshot import SnapshotStore
from skyledger.streaming import jobs
from datetime import date


@pytest.fixture
def regions(spark):
    return inline_table(spark, [("a", "p", 37.5, 127.0), ("b", "p", 35.1, 129.0)], ["city", "province", "lat", "lng"])


@pytest.fixture
def landing(tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()

    def put(name, *docs):
        (folder / name).write_text("\n".join(json.dumps(d, ensure_ascii=False) for d in docs), encoding="utf-8")

    put.path = f"file://{folder}"
    return put


def now_doc(city, stamp, temp):
    return doc(city, stamp, observed(**{**NOW_VALUES, "T1H": temp}))


def ultra_doc(city, stamp, temp):
    first = f"{(int(stamp[8:10]) + 1) % 24:02d}00"
    return doc(city, stamp, forecast(stamp[:8], first, **{**ULTRA_VALUES, "T1H": temp}), "2024-01-01T12:00:00")


def multiset(df):
    return sorted(map(str, df.collect()))


def test_runs_over_the_same_folder_equal_one_batch(spark, root, landing, regions):
    def run():
        jobs.ingest_stream(
            stream_landing(spark, landing.path, files_per_trigger=1), NOW, regions, default_icons(spark),
            raw_root=f"{root}/raw", checkpoint=f"{root}/checkpoint", rejects_root=f"{root}/rejects")

    landing("1.json", now_doc("a", "202401010000", "1"))
    landing("2.json", now_doc("b", "202401010000", "2"), now_doc("a", "202401010100", "bad"))
    run()
    run()  # nothing new
    landing("3.json", now_doc("b", "202401010100", "3"))
    run()
    whole = ingest.accepted(ingest.parse_now(read_landing(spark, landing.path), regions))
    raw = zones.read_raw(spark, f"{root}/raw", NOW, date(2024, 1, 1)).drop("issue", "batch")
    assert multiset(raw) == multiset(whole) and raw.count() == 3
    assert spark.read.parquet(f"{root}/rejects").count() == 1


def test_latest_state_of_a_stream(spark, root, landing, regions):
    store = SnapshotStore(spark, f"{root}/state", ULTRA)

    def run():
        jobs.ingest_stream(
            stream_landing(spark, landing.path), ULTRA, regions, default_icons(spark),
            raw_root=f"{root}/raw", rejects_root=f"{root}/rejects", checkpoint=f"{root}/checkpoint", store=store)
        return sorted((r["city"], r["basetime"], float(r["T1H"])) for r in store.read().collect())

    landing("1.json", ultra_doc("a", "202401010130", "1"), ultra_doc("b", "202401010130", "1"))
    assert run() == [("a", "202401010130", 1.0), ("b", "202401010130", 1.0)]
    landing("2.json", ultra_doc("a", "202401010030", "9"))  # late and older
    assert run() == [("a", "202401010130", 1.0), ("b", "202401010130", 1.0)]
    landing("3.json", ultra_doc("a", "202401010230", "2"))  # first piece of a newer issue
    assert run() == [("a", "202401010230", 2.0)]
    landing("4.json", ultra_doc("b", "202401010230", "3"))  # second piece
    assert run() == [("a", "202401010230", 2.0), ("b", "202401010230", 3.0)]
    raw = zones.read_raw(spark, f"{root}/raw", ULTRA, date(2024, 1, 1))
    assert raw.count() == 5


def test_conflicting_copies_in_one_batch_settle_alike(spark, root, landing, regions):
    landing("1.json", *[ultra_doc("a", "202401010130", t) for t in ("1", "3", "2")])
    for n in range(2):
        store = SnapshotStore(spark, f"{root}/state{n}", ULTRA)
        jobs.ingest_stream(
            stream_landing(spark, landing.path), ULTRA, regions, default_icons(spark),
            raw_root=f"{root}/raw{n}", rejects_root=f"{root}/rejects{n}", checkpoint=f"{root}/checkpoint{n}", store=store)
        assert [float(r["T1H"]) for r in store.read().collect()] == [3.0]


def test_bad_values_are_set_aside_and_the_next_issue_loads(spark, root, landing, regions):
    store = SnapshotStore(spark, f"{root}/state", ULTRA)

    def run():
        jobs.ingest_stream(
            stream_landing(spark, landing.path), ULTRA, regions, default_icons(spark),
            raw_root=f"{root}/raw", rejects_root=f"{root}/rejects", checkpoint=f"{root}/checkpoint", store=store)

    def bad(**values):
        return doc("a", "202401010130", forecast("20240101", "0200", **{**ULTRA_VALUES, **values}), "2024-01-01T12:00:00")

    landing("1.json", ultra_doc("a", "202401010130", "1"))
    run()
    landing("2.json", bad(PTY="y"), bad(T1H="12345"), bad(T1H="NaN"), bad(REH="99999999999"), ultra_doc("b", "202401010130", "2"))
    run()
    landing("3.json", doc("a", "202401010130", forecast("20240101", "0200", **ULTRA_VALUES), None))  # no time of the call
    run()
    landing("4.json", ultra_doc("b", "202401010230", "3"))
    run()
    rejects = spark.read.parquet(f"{root}/rejects")
    assert sorted(r[0] for r in rejects.selectExpr("array_join(rejected_fields, ',')").collect()) == ["PTY", "REH", "T1H", "T1H", "crawled_at"]
    assert zones.read_raw(spark, f"{root}/raw", ULTRA, date(2024, 1, 1)).count() == 3
    assert [(r["city"], r["basetime"]) for r in store.read().collect()] == [("b", "202401010230")]


def test_first_copies_in_any_order(spark, root):
    """Copies and late rows over several batches: each key once, none lost."""
    batches = [[(1, "20240101"), (2, "20240103")], [(1, "20240101"), (3, "20240101")], [(4, "20231231"), (3, "20240101"), (2, "20240103")]]
    for rows in batches:
        spark.createDataFrame(rows, "id int, day string").coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema("id int, day string").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    for _ in range(2):
        jobs.first_copies(stream, ["id"], "day", f"{root}/out", f"{root}/checkpoint")
    assert sorted(r["id"] for r in spark.read.parquet(f"{root}/out").collect()) == [1, 2, 3, 4]
