"""Plans: pruning, pushdown, map-side combining, nothing outside the JVM."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from test_archive import raw_rows
from weather import SHORT, ULTRA, frame, state

from skyledger.constants import NOW
from skyledger.lens import rows as lens
from skyledger.lens.queries import QUERIES
from skyledger.plans import archive, ingest, publish, views, weekly
from skyledger.sources import zones
from skyledger.sources.dimensions import default_icons
from skyledger.sources.landing import read_landing
from skyledger.streaming import jobs

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def details(df) -> str:
    """The formatted plan, with nothing cut short."""
    jvm = df.sparkSession._jvm
    return jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_weekly_prunes_folders_columns_and_row_groups(spark, root):
    zones.write_raw(raw_rows(spark, NOW), f"{root}/raw")
    archive.daily_rollup(spark, NOW, f"{root}/raw", f"{root}/daily", date(2023, 12, 31), date(2024, 1, 2))
    as_of = datetime(2024, 1, 8)
    week = weekly.read_week(spark, f"{root}/daily", as_of)
    text = details(weekly.weekly_city_temp(week, as_of))
    assert "GreaterThanOrEqual(basetime,202401010000)" in text and "LessThanOrEqual(basetime,202401080000)" in text
    assert "ReadSchema: struct<city:string,basetime:string,T1H:double>" in text
    # of the eight folders of the span those that are there; the day before is not listed
    assert {f.split("/daily/")[1].rsplit("/", 1)[0] for f in week.inputFiles()} == {f"year=2024/month=1/day={d}" for d in (1, 2)}
    assert "RLIKE" not in text.split("(4) HashAggregate")[0]  # nothing is parsed row by row


def test_zone_read_lists_one_year_and_prunes_the_month(spark, root):
    zones.write_raw(raw_rows(spark, NOW), f"{root}/raw")
    archive.daily_rollup(spark, NOW, f"{root}/raw", f"{root}/daily", date(2023, 12, 31), date(2024, 1, 2))
    df = zones.read_zone(spark, f"{root}/daily", NOW, 2024, 1)
    assert all("year=2024" in name for name in df.inputFiles()) and df.inputFiles()
    assert "(month" in details(df).split("PartitionFilters")[1].split("\n")[0]


@pytest.mark.parametrize("feed,table", [(ULTRA, views.ULTRA_VIEWS), (SHORT, views.SHORT_VIEWS)])
def test_views_combine_before_their_first_shuffle(spark, feed, table):
    df = frame(spark, feed, state(feed, 10))
    for layout, view in table.items():
        text = plan(view(df))
        below = text[text.rindex("Exchange"):]
        assert "HashAggregate" in below, layout
        assert "Join" not in text and "Window" not in text, layout
        assert "SortAggregate" not in below, layout


NO_STREAM_OR_WRITE = [n for n in QUERIES if not n.startswith(("stream_", "rollup_", "serve_", "ingest_state", "weekly_table", "snapshot_store", "raw_"))]


@pytest.mark.parametrize("name", NO_STREAM_OR_WRITE)
def test_no_python_and_no_cross_join(spark, name):
    text = plan(QUERIES[name](spark, SF))
    for word in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEval"):
        assert word not in text, name


def test_ingest_does_not_shuffle(spark, root):
    """The parse of landed documents is narrow."""
    for feed, texts in (("now", lens.now_texts), (ULTRA, lens.ultra_texts), (SHORT, lens.short_texts)):
        texts(lens.base(spark, SF)).select("value").write.text(f"{root}/{feed}")
        docs = read_landing(spark, f"{root}/{feed}")
        text = plan(ingest.parse(feed, docs, lens.regions(spark, SF), default_icons(spark)))
        assert "Exchange hashpartitioning" not in text and "RoundRobin" not in text, feed
        assert "SortMergeJoin" not in text, feed


def test_payload_work_uses_all_cores(spark):
    """Events are one file that cannot be split; they are dealt out before their payloads are made and parsed."""
    for name in ("ingest_now", "ingest_ultrashort", "ingest_short", "horizon_match", "pivot_items"):
        text = plan(QUERIES[name](spark, SF))
        below = text[text.rindex("Exchange RoundRobinPartitioning(8)"):]
        assert "named_struct" not in below, name


def test_redelivery_reads_only_the_buckets_of_a_batch(spark, root):
    def write(ids):
        rows = spark.createDataFrame([(i, f"2024010{1 + i % 3}") for i in ids], "id int, day string")
        rows.write.mode("append").parquet(f"{root}/in")
        jobs.first_copies(spark.readStream.schema("id int, day string").parquet(f"{root}/in"), ["id"], "day", f"{root}/out", f"{root}/checkpoint")

    write(range(300))
    write([3, 300])
    batch = spark.createDataFrame([(6, "20240101")], "id int, day string").withColumn("bucket", jobs.key_bucket(["id"]))
    seen = jobs.seen_keys(spark, f"{root}/out", "id INT", "day", "string", 9)
    new = jobs.not_seen(batch, seen, ["id"], "day")
    assert new.count() == 0 and jobs.not_seen(batch.withColumn("id", F.lit(-1)), seen, ["id"], "day").count() == 1
    scan = next(part for part in details(new).split("\n\n") if "ReadSchema: struct<id:int,bucket:int>" in part)
    assert "20240101" in scan.split("PartitionFilters: ")[1].split("\n")[0]
    assert "bucket" in scan.split("PushedFilters: ")[1].split("\n")[0]
    assert spark.read.parquet(f"{root}/out").count() == 301


def test_latest_row_is_limited_before_the_shuffle(spark):
    text = plan(QUERIES["snapshot_ultra"](spark, SF))
    assert text.count("WindowGroupLimit") == 2


def test_published_dates_reach_the_scan(spark, root):
    lens.state(spark, SF, SHORT).write.parquet(f"{root}/state")
    text = details(publish.short_features(spark.read.parquet(f"{root}/state"), date(2024, 1, 3)))
    assert "In(fcstdate, [20240103,20240104,20240105,20240106])" in text
