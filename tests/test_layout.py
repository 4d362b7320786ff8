"""Rows dealt over tasks, and lookups that no order of the items changes."""

from __future__ import annotations

import random

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from skyledger.constants import SHORT, ULTRA
from skyledger.lens import queries
from skyledger.operators.layout import ROWS_EACH, deal
from skyledger.operators.typing import REJECTED
from skyledger.plans import ingest
from skyledger.schemas import LANDING
from skyledger.sources import dimensions

REGIONS = [("A", "P", 37.0, 127.0)]


def _rows_by_task(df):
    counts = df.groupBy(F.spark_partition_id().alias("p")).count().collect()
    return [r["count"] for r in counts]


def test_one_row_group_is_dealt_over_all_cores(spark, root, tmp_path):
    """A file read in many pieces may hold all its rows in one of them."""
    path = str(tmp_path / "events.parquet")
    n = 200_000
    pq.write_table(pa.table({"event_id": pa.array(range(n)), "props": [f"{k * 7919 % n:060d}" for k in range(n)]}), path, row_group_size=n)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        events = spark.read.parquet(path)
        assert events.rdd.getNumPartitions() >= 8 and len(_rows_by_task(events)) == 1
        dealt = queries._dealt_events(spark, str(tmp_path))
        assert dealt.count() == n
        assert len(_rows_by_task(dealt)) >= 8 and max(_rows_by_task(dealt)) < 2 * ROWS_EACH
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_more_rows_make_more_tasks_not_longer_ones(spark):
    for rows in (0, 1, 10 * ROWS_EACH, 40 * ROWS_EACH + 1):
        assert deal(spark.range(1), rows).rdd.getNumPartitions() == max(8, -(-rows // ROWS_EACH))


def _item(category, time, value, date="20240131"):
    return {"category": category, "fcstDate": date, "fcstTime": time, "fcstValue": value}


def _parsed(spark, feed, items):
    response = {"body": {"items": {"item": items}}}
    docs = spark.createDataFrame([("A", "202401310530", None, response)], LANDING).withColumn(
        "crawled_at", F.lit("2024-01-31 05:50:00").cast("timestamp_ntz")
    )
    regions = dimensions.inline_table(spark, REGIONS, ["city", "province", "lat", "lng"])
    rows = ingest.parse(feed, docs, regions, dimensions.default_icons(spark)).collect()
    return [r.asDict() for r in rows]


def test_items_of_a_time_need_not_lie_together(spark):
    """Mixed slots, repeated categories (the last wins), times and categories that run together, and NULLs."""
    draw = random.Random(3)
    names = ["PTY", "SKY", "LGT", "T1H", "REH", "VEC", "WSD", "UUU", "VVV"]
    items = [_item(c, f"{h:02d}00", str(draw.randint(0, 4))) for h in range(6, 13) for c in names * 2]
    items += [_item("T1H", "0400", "8"), _item("T1H", None, "8"), _item(None, "0600", "8"), _item("0T1H", "060", "8")]
    draw.shuffle(items)
    want = {}
    for item in items:
        if item["fcstTime"] and item["category"]:
            want[item["fcstTime"], item["category"]] = item["fcstValue"]
    rows = _parsed(spark, ULTRA, items)
    assert sorted(r["fcsthour"] for r in rows) == list(range(1, 8))
    for r in rows:
        assert r[REJECTED] == [] and r["RN1"] == "0mm"
        for c in names:
            assert float(r[c]) == float(want[f"{r['fcsthour'] + 5:02d}00", c])


def test_slot_without_a_known_category_is_kept(spark):
    assert [r["fcsthour"] for r in _parsed(spark, ULTRA, [_item("XXX", "0700", "1")])] == [2]
    assert [r["fcsthour"] for r in _parsed(spark, ULTRA, [])] == [None]
    assert [r["fcsthour"] for r in _parsed(spark, ULTRA, [_item("T1H", None, "1")])] == [None]


def test_short_items_in_any_order(spark):
    draw = random.Random(4)
    names = ["PTY", "SKY", "TMP", "REH", "POP", "VEC", "WSD", "UUU", "VVV"]
    items = [_item(c, f"{h:02d}00", str(draw.randint(0, 4)), d) for d in ("20240131", "20240201") for h in (0, 3) for c in names * 2]
    lying = _parsed(spark, SHORT, items)
    draw.shuffle(items)
    mixed = _parsed(spark, SHORT, items)
    for rows, sent in ((mixed, items),):
        want = {(i["fcstDate"], i["fcstTime"], i["category"]): i["fcstValue"] for i in sent}
        assert len(rows) == len(lying) == 4
        for r in rows:
            assert r[REJECTED] == []
            assert all(float(r[c]) == float(want[r["fcstdate"], r["fcsthour"], c]) for c in names)


def test_deliveries_to_the_state_are_dealt_before_their_payloads(spark, monkeypatch):
    """Not after them, when a row is many times as large, nor only if the files are few."""
    plans = []
    monkeypatch.setattr(queries.jobs, "ingest_stream", lambda docs, *_, **__: plans.append(docs._jdf.queryExecution().analyzed().toString()))
    queries.QUERIES["ingest_state_ultrashort"](spark, "/root/testdata/sf0.001")
    assert len(plans) == 3
    for plan in plans:
        assert plan.index("from_json") < plan.index("Repartition")  # the later step stands first
