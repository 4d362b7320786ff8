"""Latest-state store: whole versions, key checks, late and partial issues."""

from __future__ import annotations

import os
from datetime import timedelta
from itertools import permutations

import pytest
from pyspark.sql import functions as F
from weather import ULTRA, frame, state

from skyledger.sources.snapshot import KeyViolation, SnapshotStore, conform


def rows(spark, issue, cities, hours=(1, 2), **values):
    base = state(ULTRA, 1)[0]
    return frame(spark, ULTRA, [
        {**base, "city": c, "basetime": issue, "fcsthour": h, **values} for c in cities for h in hours])


@pytest.fixture
def store(spark, root):
    return SnapshotStore(spark, f"{root}/state", ULTRA)


def held(store):
    return sorted((r["city"], r["basetime"], r["fcsthour"], r["REH"]) for r in store.read().collect())


def test_replace_swaps_the_whole_state(spark, store):
    assert store.read().count() == 0 and store.entry() is None
    assert store.replace(rows(spark, "202401010030", "ab", REH=1))
    before = store.read()
    assert store.replace(rows(spark, "202401010130", "c", REH=2))
    assert held(store) == [("c", "202401010130", 1, 2), ("c", "202401010130", 2, 2)]
    assert before.count() == 4  # a reader of the old version is not disturbed


def test_empty_load_keeps_the_state(spark, store):
    store.replace(rows(spark, "202401010030", "ab"))
    assert not store.replace(rows(spark, "202401010130", "a").where("false"))
    assert store.read().count() == 4
    assert not store.update(rows(spark, "202401010130", "a").where("false"), [])


def test_keys_are_checked_before_the_swap(spark, store):
    good = rows(spark, "202401010030", "a")
    store.replace(good)
    with pytest.raises(KeyViolation, match="2 repeated"):
        store.replace(good.unionByName(good))
    with pytest.raises(KeyViolation, match="incomplete"):
        store.replace(good.withColumn("city", F.lit(None).cast("string")))
    assert store.read().count() == 2
    newer = good.withColumn("REH", F.lit(99))
    both = good.withColumn("n", F.lit(1)).unionByName(newer.withColumn("n", F.lit(2)))
    store.replace(both, on_dup="last", order=[F.col("n")])
    assert {r["REH"] for r in store.read().collect()} == {99}
    with pytest.raises(ValueError):
        store.replace(good, on_dup="first")


def test_update_by_issue(spark, store):
    order = [F.col("REH")]
    assert store.update(rows(spark, "202401010130", "a", REH=1), order)
    assert not store.update(rows(spark, "202401010030", "ab", REH=9), order)  # older, late
    assert store.update(rows(spark, "202401010130", "b", REH=1), order)  # rest of the same issue
    assert store.update(rows(spark, "202401010130", "b", hours=(2,), REH=5), order)  # a later row in the order
    assert store.update(rows(spark, "202401010130", "b", hours=(1, 2), REH=0), order)  # arrives last, but comes first in it
    assert held(store) == [
        ("a", "202401010130", 1, 1), ("a", "202401010130", 2, 1), ("b", "202401010130", 1, 1), ("b", "202401010130", 2, 5)]
    mixed = rows(spark, "202401010230", "c", REH=3).unionByName(rows(spark, "202401010030", "d", REH=3))
    assert store.update(mixed, order)
    assert {c for c, *_ in held(store)} == {"c"}


@pytest.mark.parametrize("turn", list(permutations(range(3))))
def test_pieces_in_any_order_give_one_state(spark, store, turn):
    pieces = [rows(spark, "202401010130", "ab", REH=n).withColumn("n", F.lit(n)) for n in range(3)]
    pieces[1] = pieces[1].where("city = 'a'").unionByName(rows(spark, "202401010130", "b", REH=1).withColumn("n", F.lit(9)))
    for n in (*turn, turn[0]):  # and one of them twice
        store.update(pieces[n], [F.col("n")])
    assert held(store) == [(c, "202401010130", h, reh) for c, reh in (("a", 2), ("b", 1)) for h in (1, 2)]
    assert "_rank_of_row" not in store.read().columns


def test_a_reader_is_not_disturbed_by_many_updates(spark, store, tmp_path):
    store.update(rows(spark, "202401010030", "ab", REH=7), [F.col("REH")])
    reader = store.read()
    for hour in range(1, 4):
        assert store.update(rows(spark, f"20240101{hour:02d}30", "c", REH=hour), [F.col("REH")])
    assert reader.count() == 4 and {r["REH"] for r in reader.collect()} == {7}
    assert len(os.listdir(tmp_path / "state/versions")) == 4
    assert store.expire(lease=timedelta(0)) == 2 and held(store) == [("c", "202401010330", h, 3) for h in (1, 2)]


def test_updates_keep_few_versions(spark, root, tmp_path):
    store = SnapshotStore(spark, f"{root}/state", ULTRA, lease=timedelta(0))
    for hour in range(4):
        assert store.update(rows(spark, f"20240101{hour:02d}30", "a"), [F.col("REH")])
    assert len(os.listdir(tmp_path / "state/versions")) == 2
    with pytest.raises(KeyViolation):
        store.replace(rows(spark, "202401010930", "aa"))
    assert not store.replace(rows(spark, "202401010930", "a").where("false"))
    assert len(os.listdir(tmp_path / "state/versions")) == 2
    with pytest.raises(ValueError):
        store.replace(rows(spark, "202401010930", "a"), on_dup="last")


def test_a_text_code_in_a_second_piece_does_not_stop_the_state(spark, store):
    first = rows(spark, "202401010130", "a").withColumn("PTY", F.lit("1"))
    second = rows(spark, "202401010130", "b").withColumn("PTY", F.lit("y"))
    assert store.update(first, [F.col("REH")]) and store.update(second, [F.col("REH")])
    assert {(r["city"], r["PTY"]) for r in store.read().collect()} == {("a", 1), ("b", None)}


def test_expire_keeps_the_newest(spark, store, tmp_path):
    for hour in range(4):
        store.replace(rows(spark, f"20240101{hour:02d}30", "a"))
    assert store.expire(keep=2, lease=timedelta(0)) == 2
    assert len(os.listdir(tmp_path / "state/versions")) == 2
    assert {b for _, b, *_ in held(store)} == {"202401010330"}


def test_types_and_point(spark):
    raw = spark.createDataFrame(
        [("a", "p", 33.1234567, None, "202401010030", 1, "i", "x", "1", 2.25, 50, "0mm", "0", 10, 1.0, 0.0, 0.0)],
        "city string, province string, lat double, lng double, basetime string, fcsthour bigint, icon_map string,"
        " PTY string, SKY string, T1H double, REH bigint, RN1 string, LGT string, VEC bigint, WSD double, UUU double, VVV double")
    row = conform(raw, ULTRA).first()
    assert (str(row["lat"]), str(row["T1H"]), row["PTY"], row["SKY"], row["geom"]) == ("33.123457", "2.3", None, 1, None)
