"""Scalar rules against boundary tables."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from skyledger import constants as C
from skyledger.functions import clock, geo, icons, labels, precipitation
from skyledger.functions.grid import grid_cell
from skyledger.functions.sql import register_functions

TEXT = "string"


def apply(spark, rows, schema, expression):
    """Values of ``expression`` over the rows, in row order."""
    numbered = [(i, *row) for i, row in enumerate(rows)]
    df = spark.createDataFrame(numbered, f"n int, {schema}")
    return [r[0] for r in df.select("n", expression.alias("v")).orderBy("n").select("v").collect()]


def check(spark, table, schema, expression):
    rows = [key if isinstance(key, tuple) else (key,) for key, _ in table]
    assert apply(spark, rows, schema, expression) == [value for _, value in table]


def test_first_number(spark):
    table = [("1mm 미만", 1.0), ("강수없음", None), ("30~50mm", 30.0), ("", None), (None, None), ("0.5cm", 0.5)]
    check(spark, table, "s string", precipitation.first_number(F.col("s")))


def test_rain_class(spark):
    table = [("0mm", "약한비"), ("2.9", "약한비"), ("3.0", "비"), ("14.9mm", "비"), ("15.0", "강한비"), ("", None), (None, None)]
    check(spark, table, "s string", icons.rain_class(F.col("s")))


def test_snow_class(spark):
    table = [("0.9cm", "약한눈"), ("1.0", "눈"), ("4.9", "눈"), ("5.0cm", "강한눈"), ("없음", None)]
    check(spark, table, "s string", icons.snow_class(F.col("s")))


def test_normalised_rain_now(spark):
    table = [(None, "0mm"), ("강수없음", "0mm"), ("적설없음", "0mm"), ("", "0mm"), ("0", "0"), ("1.5", "1.5")]
    check(spark, table, "s string", precipitation.norm_rain_now(F.col("s")))


def test_normalised_rain(spark):
    table = [("0", "0mm"), ("강수없음", "0mm"), ("적설없음", "적설없음"), (None, "0mm"), ("", "0mm")]
    check(spark, table, "s string", precipitation.norm_rain(F.col("s")))


def test_normalised_snow(spark):
    table = [("0", "0cm"), ("적설없음", "0cm"), (None, "0cm"), ("강수없음", "강수없음")]
    check(spark, table, "s string", precipitation.norm_snow(F.col("s")))


def test_icon_key_short(spark):
    table = [
        (("0", "4", None, None), "흐림"),
        (("1", None, "0mm", None), "약한비"),
        (("1", "3", "", None), "구름많음"),
        (("2", None, None, None), "눈비"),
        (("3", None, None, "5cm"), "강한눈"),
        (("4", None, None, None), "소나기"),
        (("5", "3", None, None), "구름많음"),
        ((None, None, None, None), "맑음"),
    ]
    key = icons.weather_key_short(F.col("pty"), F.col("sky"), F.col("pcp"), F.col("sno"))
    check(spark, table, "pty string, sky string, pcp string, sno string", key)


def test_icon_key_ultra(spark):
    table = [
        (("1", "1", "3.5", "0mm"), "번개,뇌우"),
        (("0", "4", "0", None), "흐림"),
        (("5", None, None, "15mm"), "강한비"),
        (("6", None, None, None), "눈비"),
        (("7", None, "없음", None), "눈"),
        (("4", None, "", None), "소나기"),
        (("0", "1", None, None), "맑음"),
        (("1", "9", None, None), "맑음"),
    ]
    key = icons.weather_key_ultra(F.col("pty"), F.col("sky"), F.col("lgt"), F.col("rn1"))
    check(spark, table, "pty string, sky string, lgt string, rn1 string", key)


def test_daytime_by_season(spark):
    def at(month, hour):
        return datetime(2024, month, 15, hour, 30)

    table = [
        (at(3, 5), False), (at(3, 6), True), (at(3, 18), True), (at(3, 19), False), (at(11, 18), True),
        (at(7, 4), False), (at(7, 5), True), (at(7, 19), True), (at(7, 20), False),
        (at(1, 7), False), (at(1, 8), True), (at(1, 17), True), (at(1, 18), False), (at(12, 17), True),
    ]
    check(spark, table, "t timestamp_ntz", clock.is_daytime(F.col("t")))


def test_compass_equals_the_sixteen_ranges(spark):
    # The degree range of each wind name after north.
    ranges = [(12, 33), (34, 56), (57, 78), (79, 101), (102, 123), (124, 146), (147, 168), (169, 191),
              (192, 213), (214, 236), (237, 258), (259, 281), (282, 303), (304, 326), (327, 348)]
    wanted = {d: "북풍" for d in [*range(0, 12), *range(349, 361)]}
    for (low, high), name in zip(ranges, C.COMPASS[1:]):
        wanted.update({d: name for d in range(low, high + 1)})
    table = [(d, wanted.get(d)) for d in [-1, *range(0, 361), 361, None]]
    check(spark, table, "d int", labels.compass16(F.col("d")))


def test_base_times(spark):
    stamps = [datetime(2024, 3, 1, 0, 44, 59), datetime(2024, 3, 1, 0, 45), datetime(2024, 3, 1, 1, 59, 59), datetime(2024, 3, 1, 2, 0),
              datetime(2024, 3, 1, 4, 59), datetime(2024, 3, 1, 23, 0)]
    rows = [(t,) for t in stamps]

    def values(base):
        return apply(spark, rows, "t timestamp_ntz", clock.stamp12(base(F.col("t"))))

    assert values(clock.base_time_now) == [
        "202403010000", "202403010000", "202403010100", "202403010200", "202403010400", "202403012300"]
    assert values(clock.base_time_ultra) == [
        "202402292330", "202403010030", "202403010130", "202403010130", "202403010430", "202403012230"]
    assert values(clock.base_time_short) == [
        "202402292300", "202402292300", "202402292300", "202403010200", "202403010200", "202403012300"]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Seoul", "America/Los_Angeles"])
def test_times_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        # 02:30 does not exist on this day in Los Angeles
        rows = [("202403100230",)]
        back = clock.stamp12(clock.base_time_now(clock.parse_stamp12(F.col("s"))))
        assert apply(spark, rows, "s string", back) == ["202403100200"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_bad_times_are_null(spark):
    table = [("202413010000", None), ("2024010100", None), ("abc", None), (None, None), ("202401010560", None)]
    check(spark, table, "s string", clock.parse_stamp12(F.col("s")))
    table = [("20240230", None), ("20240229", date(2024, 2, 29)), ("2024", None), ("202402290500", date(2024, 2, 29))]
    check(spark, table, "s string", clock.parse_stamp8(F.col("s")))


def test_stamp_check_agrees_with_the_calendar(spark):
    texts = ["202401012359", "202401012400", "202401010060", "20240101000", "20240101000 ", " 20240101000",
             "2024010100000", "+20240101000", "abcdefghijkl", None, "202402290000", "202302290000", "210002290000",
             "200002290000", "202404310000", "202412310000", "202413010000", "202400010000", "202401000000", "202401320000"]

    def real(text):
        try:
            return len(text) == 12 and text.isdigit() and bool(datetime.strptime(text, "%Y%m%d%H%M"))
        except (TypeError, ValueError):
            return False

    both = F.struct(clock.is_stamp12(F.col("s")), clock.parse_stamp12(F.col("s")).isNotNull())
    got = apply(spark, [(t,) for t in texts], "s string", both)
    assert [tuple(g) for g in got] == [(real(t), real(t)) for t in texts]


def test_horizon_wraps_midnight(spark):
    slots = apply(spark, [(22,)], "h int", clock.horizon_slots(F.col("h")))[0]
    assert [tuple(s) for s in slots] == [
        (1, "2300"), (2, "0000"), (3, "0100"), (4, "0200"), (5, "0300"), (6, "0400"), (7, "0500")]


def test_target_periods():
    assert clock.target_day(date(2024, 3, 1)) == date(2024, 2, 29)
    assert clock.target_month(date(2024, 1, 1)) == (2023, 12)
    assert clock.target_month(date(2024, 3, 31)) == (2024, 2)
    assert clock.target_year(date(2024, 1, 1)) == 2023


def test_rain_label_short(spark):
    table = [
        (("2", "20240104", "202401010500"), "시간당 3~15mm"),
        (("1", "20240104", "202401011400"), "시간당 3mm 미만"),
        (("3", "20240104", "202401010200"), "시간당 15mm 이상"),
        (("2", "20240104", "202401011700"), "2mm"),
        (("2.5", "20240104", "202401012300"), "2.5mm"),
        (("2.5mm", "20240104", "202401012300"), "2.5mm"),
        (("2", "20240103", "202401010500"), "2"),
        (("4", "20240104", "202401010500"), "4"),
        ((None, "20240104", "202401010500"), None),
        (("2", "20240302", "202402280500"), "시간당 3~15mm"),
    ]
    label = precipitation.rain_label_short(F.col("p"), F.col("d"), F.col("b"))
    check(spark, table, "p string, d string, b string", label)


def test_snow_label_short(spark):
    table = [
        (("1", "20240104", "202401010500"), "시간당 1cm 미만"),
        (("2", "20240104", "202401010800"), "시간당 1cm 이상"),
        (("3", "20240104", "202401010800"), "3"),
        (("1.5", "20240104", "202401012300"), "1.5cm"),
    ]
    label = precipitation.snow_label_short(F.col("s"), F.col("d"), F.col("b"))
    check(spark, table, "s string, d string, b string", label)


def test_rain_label_ultra(spark):
    strict = [("0mm", "0mm"), ("3.5", "3.5mm"), ("3.5mm", "3.5mmmm"), ("30~50mm", "30~50mm"), (None, None)]
    check(spark, strict, "r string", precipitation.rain_label_ultra(F.col("r"), strict=True))
    plain = [("0mm", "0mm"), ("3.5", "3.5mm"), ("3.5mm", "3.5mm"), ("1mm 미만", "1mm 미만"), (None, None)]
    check(spark, plain, "r string", precipitation.rain_label_ultra(F.col("r")))


def test_sort_values(spark):
    rain = [(None, 0.0), ("0mm", 0.0), ("1mm 미만", 0.5), ("30~50mm", 30.0), ("50mm 이상", 50.0), ("7.5mm", 7.5),
            ("30.0~50.0mm", 30.0), ("많음", 0.0), ("1234mm", 1234.0)]
    check(spark, rain, "r string", precipitation.rain_order_ultra(F.col("r")))
    check(spark, [("1", 1.0), ("3", 3.0), ("1mm 미만", 0.5)], "r string", precipitation.rain_order_short(F.col("r")))
    snow = [(None, 0.0), ("0cm", 0.0), ("0.5cm 미만", 0.25), ("5.0cm 이상", 5.0), ("2", 2.0), ("1.5cm", 1.5)]
    check(spark, snow, "r string", precipitation.snow_order(F.col("r")))


def test_severity(spark):
    keys = ["번개,뇌우", "강한눈", "강한비", "눈비", "눈", "비", "약한눈", "약한비", "소나기", "흐림", None]
    rows = [(k,) for k in keys]
    assert apply(spark, rows, "k string", icons.severity_ultra(F.col("k"))) == [9, 8, 7, 6, 5, 4, 3, 2, 1, 1, 1]
    assert apply(spark, rows, "k string", icons.severity_short(F.col("k"))) == [1, 8, 7, 6, 5, 4, 3, 2, 1, 1, 1]


def test_icon_file_to_key(spark):
    table = [("번개,뇌우_n.png", "번개,뇌우"), ("맑음_d.png", "맑음"), (None, None)]
    check(spark, table, "f string", icons.key_of_icon(F.col("f")))


def test_temperature_label(spark):
    from decimal import Decimal

    table = [((Decimal("12.0"), Decimal("-3.5")), "12.0 ~ -3.5"), ((Decimal("0.0"), None), None)]
    check(spark, table, "h decimal(4,1), l decimal(4,1)", labels.temp_label(F.col("h"), F.col("l")))


def test_points(spark):
    table = [((127.0, 37.5), (127.0, 37.5)), ((None, 37.5), None), ((127.0, None), None)]
    df_values = apply(spark, [k for k, _ in table], "lng double, lat double", geo.make_point(F.col("lng"), F.col("lat")))
    assert [v and tuple(v) for v in df_values] == [v for _, v in table]


def test_grid_cells(spark):
    # Cells of well-known places.
    table = [
        ((37.5665, 126.9780), (60, 127)), ((35.1796, 129.0756), (98, 76)), ((37.7519, 128.8761), (92, 132)),
        ((37.4840, 130.9050), (127, 127)), ((33.4996, 126.5312), (53, 38)), ((33.2541, 126.5093), (52, 33)),
        ((37.9667, 124.7167), (21, 135)),
    ]
    values = apply(spark, [k for k, _ in table], "lat double, lng double", grid_cell(F.col("lat"), F.col("lng")))
    assert [tuple(v) for v in values] == [v for _, v in table]


def test_sql_functions_equal_the_column_functions(spark):
    register_functions(spark)
    rows = [("1", "3", "3.5", "7.5mm", "5cm", 200, datetime(2024, 7, 1, 1, 10), 37.5665, 126.978),
            ("3", "4", "0", "0mm", "0.5cm", 361, datetime(2024, 1, 1, 23, 50), 33.4996, 126.5312),
            (None, None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(
        rows, "pty string, sky string, lgt string, rain string, snow string, vec int, t timestamp_ntz, lat double, lng double")
    df.createOrReplaceTempView("obs")
    c = F.col
    ours = df.select(
        precipitation.first_number(c("rain")), icons.rain_class(c("rain")), icons.snow_class(c("snow")),
        icons.sky_class(c("sky")), icons.weather_key_short(c("pty"), c("sky"), c("rain"), c("snow")),
        icons.weather_key_ultra(c("pty"), c("sky"), c("lgt"), c("rain")),
        icons.severity_ultra(icons.rain_class(c("rain"))), icons.severity_short(icons.snow_class(c("snow"))),
        labels.compass16(c("vec")), clock.is_daytime(c("t")), clock.base_time_now(c("t")),
        clock.base_time_ultra(c("t")), clock.base_time_short(c("t")), grid_cell(c("lat"), c("lng")),
    ).collect()
    theirs = spark.sql("""
        SELECT first_number(rain), rain_class(rain), snow_class(snow), sky_class(sky),
          weather_key_short(pty, sky, rain, snow), weather_key_ultra(pty, sky, lgt, rain),
          severity_ultra(rain_class(rain)), severity_short(snow_class(snow)), compass16(vec), is_daytime(t),
          base_time_now(t), base_time_ultra(t), base_time_short(t), grid_cell(lat, lng)
        FROM obs""").collect()
    assert [tuple(r) for r in ours] == [tuple(r) for r in theirs]
