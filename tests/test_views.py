"""Views against brute force on small fixtures with NULLs, ties and a hot city."""

from __future__ import annotations

import random
import re
from collections import Counter
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F
from weather import SHORT, ULTRA, frame, groups, high_first, null_last, state

from skyledger.operators.ranking import pack_wind, unpack_wind
from skyledger.plans import views

FEEDS = [(ULTRA, ("city",)), (SHORT, ("city", "fcstdate"))]
LAYOUT_VIEWS = {ULTRA: views.ULTRA_VIEWS, SHORT: views.SHORT_VIEWS}
# Severity of a weather key.
SEVERITY = {"눈비": 6, "눈": 5, "비": 4, "약한눈": 3, "약한비": 2}


def collected(view):
    return Counter(tuple(map(str, row)) for row in view.drop("geometry").collect())


def expected(rows):
    return Counter(tuple(map(str, row)) for row in rows)


def point(row):
    return f"Row(lng={row['geom'][0]}, lat={row['geom'][1]})"


@pytest.mark.parametrize("feed,keys", FEEDS)
def test_conditions(spark, feed, keys):
    rows, temp = state(feed, 400), "T1H" if feed == ULTRA else "TMP"
    rows.append({**rows[0], "city": "only-null", "icon_map": None, "fcsthour": 999999 if feed == ULTRA else "x"})
    want = []
    for key, members in groups(rows, *keys).items():
        temps = [m[temp] for m in members if m[temp] is not None]
        known = [m["icon_map"] for m in members if m["icon_map"]]
        if not known:
            continue
        count = Counter(i.split("_")[0] for i in known)
        top = min(known, key=lambda i: (-SEVERITY.get(i.split("_")[0], 1), -count[i.split("_")[0]], i))
        label = f"{max(temps)} ~ {min(temps)}" if temps else None
        want.append((*key, label, top, top.split("_")[0], point(members[0])))
    assert collected(LAYOUT_VIEWS[feed]["cond"](frame(spark, feed, rows))) == expected(want)


def amount(text, codes):
    fixed = {None: 0, "0mm": 0, "1mm 미만": 0.5, "30~50mm": 30, "50mm 이상": 50,
             "0cm": 0, "0.5cm 미만": 0.25, "5.0cm 이상": 5}
    if text in fixed:
        return fixed[text]
    digits = re.sub(r"[^0-9.]", "", text)
    if re.fullmatch(r"\d+(\.\d+)?", digits):
        return float(digits)
    first = re.search(r"\d+(\.\d+)?", text)
    return float(first.group()) if first else 0.0


def test_ultrashort_rain(spark):
    rows = [r for r in state(ULTRA, 300) if r["RN1"] != "50mm 이상"]
    want, strict = [], []
    for (city,), members in groups(rows, "city").items():
        top = min(members, key=lambda m: (-amount(m["RN1"], False), null_last(m["RN1"])))
        text = top["RN1"]
        bare = text is not None and re.fullmatch(r"[0-9]+(\.[0-9]+)?", text)
        want.append((city, f"{text}mm" if bare else text, point(top)))
        fixed = text in (None, "0mm", "1mm 미만", "30~50mm", "50mm 이상")
        strict.append((city, text if fixed else f"{text}mm", point(top)))
    df = frame(spark, ULTRA, rows)
    assert collected(views.ultrashort_rain(df)) == expected(want)
    assert collected(views.ultrashort_rain(df, strict=True)) == expected(strict)


def test_zero_rain_is_preferred_to_unknown(spark):
    rows = [{**r, "RN1": text} for r, text in zip(state(ULTRA, 40, cities=1), [None, "0mm"] * 20)]
    assert views.ultrashort_rain(frame(spark, ULTRA, rows)).first()["강수량"] == "0mm"


def day3(date, base):
    return date == f"{int(base[:8]) + 3}"


def label(text, date, base, words, unit):
    if day3(date, base) and base[8:10] in ("02", "05", "08", "11", "14") and text in words:
        return words[text]
    if day3(date, base) and base[8:10] in ("17", "20", "23") and text and re.fullmatch(r"[0-9]+(\.[0-9]+)?", text):
        return text + unit
    return text


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_short_rain(spark, seed):
    rows = [r for r in state(SHORT, 250, seed) if r["PCP"] not in ("50mm 이상", "30~50mm", "30.0~50.0mm") or seed == 1]
    rain_words = {"1": "시간당 3mm 미만", "2": "시간당 3~15mm", "3": "시간당 15mm 이상"}
    snow_words = {"1": "시간당 1cm 미만", "2": "시간당 1cm 이상"}
    want = []
    for (city, date), members in groups(rows, "city", "fcstdate").items():
        r = min(members, key=lambda m: (
            -amount(m["PCP"], True), high_first(m["POP"]), null_last(m["PCP"]), -int(m["basetime"])))
        s = min(members, key=lambda m: (-amount(m["SNO"], True), null_last(m["SNO"]), -int(m["basetime"])))
        want.append((
            city, date, label(r["PCP"], date, r["basetime"], rain_words, "mm"),
            label(s["SNO"], date, s["basetime"], snow_words, "cm"), r["POP"], point(r)))
    assert collected(views.short_rain(frame(spark, SHORT, rows))) == expected(want)


# The sixteen wind names from north, one per 22.5 degrees.
NAMES = "북풍 북북동 북동 동북동 동풍 동남동 동남풍 남남동 남풍 남남서 남서풍 서남서 서풍 서북서 북서풍 북북서".split()


def wind_name(vec):
    return NAMES[int((vec + 11.25) // 22.5) % 16] if vec is not None and 0 <= vec <= 360 else None


@pytest.mark.parametrize("feed,keys", FEEDS)
@pytest.mark.parametrize("known_only", [True, False])
def test_wind(spark, feed, keys, known_only):
    rows = [r for r in state(feed, 300) if r["WSD"] is not None or not known_only]
    want = []
    for key, members in groups(rows, *keys).items():
        top = min(members, key=lambda m: (high_first(m["WSD"]), m["VEC"] is None, m["VEC"] or 0))
        want.append((*key, wind_name(top["VEC"]), top["WSD"], point(top)))
    assert collected(LAYOUT_VIEWS[feed]["wind"](frame(spark, feed, rows))) == expected(want)


def test_packed_wind_orders_and_unpacks_every_pair(spark):
    speeds = [None, Decimal("-9999.9"), Decimal("-0.1"), Decimal("0.0"), Decimal("0.1"), Decimal("9999.9")]
    directions = [None, -(2**31), -1, 0, 360, 2**31 - 1]
    pairs = [(s, d) for s in speeds for d in directions]
    df = spark.createDataFrame(pairs, "s decimal(5,1), d int").withColumn("p", pack_wind(F.col("s"), F.col("d")))
    back = df.select("s", "d", "p", *[c.alias(n) for c, n in zip(unpack_wind(F.col("p")), ("s2", "d2"))]).collect()
    assert all((r["s"], r["d"]) == (r["s2"], r["d2"]) for r in back)
    by_pack = [(r["s"], r["d"]) for r in sorted(back, key=lambda r: -r["p"])]
    assert by_pack == sorted(pairs, key=lambda p: (high_first(p[0]), p[1] is None, p[1] or 0))


@pytest.mark.parametrize("feed,keys,shown", [(ULTRA, ("city", "basetime"), 1), (SHORT, ("city", "fcstdate"), 2)])
def test_humidity(spark, feed, keys, shown):
    rows = state(feed, 300)
    want = []
    for key, members in groups(rows, *keys).items():
        known = [m["REH"] for m in members if m["REH"] is not None]
        mean = (Decimal(sum(known)) / len(known)).quantize(Decimal(1), ROUND_HALF_UP) if known else None
        want.append((*key[:shown], mean, point(members[0])))
    assert collected(LAYOUT_VIEWS[feed]["humid"](frame(spark, feed, rows))) == expected(want)


@pytest.mark.parametrize("feed", [ULTRA, SHORT])
def test_input_order_and_split_do_not_matter(spark, feed):
    rows = state(feed, 300, seed=11)
    shuffled = random.Random(5).sample(rows, len(rows))
    first = frame(spark, feed, rows)
    for layout, view in LAYOUT_VIEWS[feed].items():
        whole = collected(view(first))
        assert whole == collected(view(frame(spark, feed, shuffled).repartition(7))), layout
        apart = collected(view(first.where("city = 'c0'"))) + collected(view(first.where("city <> 'c0'")))
        assert whole == apart, layout


def test_sql_views(spark):
    views.register_views(frame(spark, ULTRA, state(ULTRA, 50)), frame(spark, SHORT, state(SHORT, 50)))
    for layout in ("cond", "rain", "wind", "humid"):
        assert spark.table(f"ultrashort_{layout}").count() > 0
        assert spark.sql(f"SELECT `도시` FROM short_{layout} WHERE fcstdate = '20240103'").count() > 0
