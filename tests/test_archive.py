"""Raw to daily to monthly to yearly: whole, repeatable, pruned."""

from __future__ import annotations

import glob
import os
from datetime import date, datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from skyledger.constants import FEEDS, NOW
from skyledger.plans import archive, weekly
from skyledger.schemas import RAW
from skyledger.sources import zones

YEARS = (2023, 2024)
ISSUES = [datetime(2023, 12, 31, 22), datetime(2023, 12, 31, 23), datetime(2024, 1, 1, 0), datetime(2024, 1, 2, 5)]


def raw_rows(spark, feed, issues=ISSUES, cities=("a", "b"), temp=1.5):
    texts = {"province": "p", "icon_map": "비_d.png", "PTY": "0", "SKY": "1", "RN1": "0mm", "PCP": "0mm", "SNO": "0cm", "LGT": "0"}
    values = {**texts, "lat": 1.0, "lng": 2.0, "fcsthour": 1 if feed != "shortFcst" else "0600", "fcstdate": "20240102",
              "T1H": temp, "TMP": temp, "WSD": 1.0, "UUU": 0.0, "VVV": 0.0, "REH": 5, "VEC": 6, "POP": 7}
    rows = [
        tuple({**values, "city": c, "basetime": f"{t:%Y%m%d%H%M}"}.get(n) for n in RAW[feed].names)
        for t in issues for c in cities
    ]
    return spark.createDataFrame(rows, RAW[feed])


def multiset(df):
    return sorted(map(str, df.collect()))


def roll_all(spark, feed, root):
    archive.daily_rollup(spark, feed, f"{root}/raw", f"{root}/daily", date(2023, 12, 31), date(2024, 1, 2))
    for year, month in ((2023, 12), (2024, 1)):
        archive.monthly_rollup(spark, feed, f"{root}/daily", f"{root}/monthly", year, month)
    for year in YEARS:
        archive.yearly_rollup(spark, feed, f"{root}/monthly", f"{root}/yearly", year)


@pytest.mark.parametrize("feed", FEEDS)
def test_round_trip_and_rerun(spark, root, tmp_path, feed):
    rows = raw_rows(spark, feed)
    for _ in range(2):
        zones.write_raw(rows, f"{root}/raw")
        roll_all(spark, feed, root)
        for level in ("daily", "monthly", "yearly"):
            back = zones.read_zone(spark, f"{root}/{level}", feed)
            assert multiset(back.select(*RAW[feed].names)) == multiset(rows), level
            assert back.where("basetime = '202401020500'").select("year", "month", "day").distinct().collect() == [(2024, 1, 2)]
    assert os.path.isdir(tmp_path / "daily/year=2024/month=1/day=2")
    assert not glob.glob(f"{tmp_path}/monthly/year=2024/month=1/day=*")
    assert not glob.glob(f"{tmp_path}/yearly/year=2024/month=*")


def test_only_the_rewritten_days_change(spark, root):
    zones.write_raw(raw_rows(spark, NOW), f"{root}/raw")
    roll_all(spark, NOW, root)
    zones.write_raw(raw_rows(spark, NOW, [ISSUES[-1]], cities=("z",)), f"{root}/raw")
    archive.daily_rollup(spark, NOW, f"{root}/raw", f"{root}/daily", date(2024, 1, 2))
    daily = zones.read_zone(spark, f"{root}/daily", NOW)
    assert {r["city"] for r in daily.where("day = 2").collect()} == {"z"}
    assert daily.where("day <> 2").count() == 6


def test_append_adds(spark, root):
    zones.write_raw(raw_rows(spark, NOW), f"{root}/raw")
    for _ in range(2):
        archive.daily_rollup(spark, NOW, f"{root}/raw", f"{root}/daily", date(2024, 1, 2), mode="append")
    assert zones.read_zone(spark, f"{root}/daily", NOW).count() == 4
    with pytest.raises(ValueError):
        archive.daily_rollup(spark, NOW, f"{root}/raw", f"{root}/daily", date(2024, 1, 2), mode="upsert")


def test_missing_day_fails_unless_allowed(spark, root):
    zones.write_raw(raw_rows(spark, NOW), f"{root}/raw")
    with pytest.raises(FileNotFoundError):
        archive.daily_rollup(spark, NOW, f"{root}/raw", f"{root}/daily", date(2022, 1, 1))
    archive.daily_rollup(spark, NOW, f"{root}/raw", f"{root}/daily", date(2022, 1, 1), missing_ok=True)
    assert zones.read_raw(spark, f"{root}/raw", NOW, date(2022, 1, 1), missing_ok=True).count() == 0


def test_flat_issue_files(spark, root, tmp_path):
    rows = raw_rows(spark, NOW).toPandas()
    (tmp_path / "flat").mkdir()
    for stamp, part in rows.groupby("basetime"):
        part.to_parquet(tmp_path / "flat" / f"{stamp}_weather_now.parquet", index=False)
    archive.daily_rollup(spark, NOW, f"{root}/flat", f"{root}/daily", date(2024, 1, 1), date(2024, 1, 2), flat_files=True)
    daily = zones.read_zone(spark, f"{root}/daily", NOW)
    got = daily.select("basetime", "year", "month", "day").distinct().orderBy("basetime").collect()
    assert got == [("202401010000", 2024, 1, 1), ("202401020500", 2024, 1, 2)]
    with pytest.raises(FileNotFoundError):
        zones.read_raw_files(spark, f"{root}/flat", NOW, date(2020, 1, 1))


def test_file_without_issue_time_fails(spark):
    names = spark.createDataFrame([("x_weather.parquet",)], "file string")
    with pytest.raises(PySparkException, match="no issue time"):
        zones.with_issue_date(names.select(zones.issue_of_file(F.col("file")).alias("issue"))).collect()


def test_redelivered_rows_are_reduced_to_the_last(spark, root):
    zones.write_raw(raw_rows(spark, NOW, temp=1.0), f"{root}/raw", batch=1)
    zones.write_raw(raw_rows(spark, NOW, temp=2.0, cities=("a",)), f"{root}/raw", batch=2)
    archive.daily_rollup(spark, NOW, f"{root}/raw", f"{root}/daily", date(2023, 12, 31), date(2024, 1, 2))
    daily = zones.read_zone(spark, f"{root}/daily", NOW)
    assert daily.count() == 8
    assert {(r["city"], r["T1H"]) for r in daily.collect()} == {("a", 2.0), ("b", 1.0)}


def test_missing_months_and_years_are_errors(spark, root):
    with pytest.raises(FileNotFoundError):
        archive.monthly_rollup(spark, NOW, f"{root}/none", f"{root}/monthly", 2024, 1)
    with pytest.raises(FileNotFoundError):
        archive.yearly_rollup(spark, NOW, f"{root}/none", f"{root}/yearly", 2024)


def test_weekly_window_and_sentinel(spark, root):
    issues = [datetime(2024, 1, 1, 9), datetime(2024, 1, 1, 10), datetime(2024, 1, 1, 11), datetime(2024, 1, 8, 9)]
    rows = raw_rows(spark, NOW, issues, cities=("b", "a"))
    hour = F.substring("basetime", 9, 2)
    rows = rows.withColumn("T1H", F.when(hour == "11", F.lit(-999.0)).when(hour == "10", F.lit(None)).otherwise(F.col("T1H")))
    extra = rows.limit(1).withColumn("basetime", F.lit("2024999")).withColumn("T1H", F.lit(77.0))
    zones.write_raw(rows, f"{root}/raw")
    archive.daily_rollup(spark, NOW, f"{root}/raw", f"{root}/daily", date(2024, 1, 1), date(2024, 1, 8))
    daily = zones.read_zone(spark, f"{root}/daily", NOW)
    as_of = datetime(2024, 1, 8, 9, 0)
    got = [tuple(r) for r in weekly.weekly_city_temp(daily, as_of).collect()]
    assert got == [(c, d, 1.5, 1.5) for c in "ab" for d in (date(2024, 1, 1), date(2024, 1, 8))]
    later = [tuple(r) for r in weekly.weekly_city_temp(daily, datetime(2024, 1, 8, 9, 0, 1)).collect()]
    assert [(c, d) for c, d, *_ in later] == [("a", date(2024, 1, 8)), ("b", date(2024, 1, 8))]
    assert weekly.weekly_city_temp(rows.unionByName(extra), as_of).count() == 4
    # a rerun over an archive that has gone on, from the eight folders of its span
    week = weekly.read_week(spark, f"{root}/daily", as_of - timedelta(days=1))
    assert [d for _, d, *_ in weekly.weekly_city_temp(week, as_of - timedelta(days=1)).collect()] == [date(2024, 1, 1)] * 2
    assert all("month=1/day=" in f for f in week.inputFiles())
    for fmt in ("parquet", "json"):
        weekly.write_weekly(weekly.weekly_city_temp(daily, as_of), f"{root}/summary-{fmt}", fmt)
        weekly.write_weekly(weekly.weekly_city_temp(daily, as_of), f"{root}/summary-{fmt}", fmt)
        assert spark.read.format(fmt).load(f"{root}/summary-{fmt}").count() == 4
