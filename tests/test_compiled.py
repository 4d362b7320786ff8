"""The parse of payloads is compiled: no lambda over items or slots, no method too long for the JIT."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from skyledger.constants import NOW, SHORT, ULTRA
from skyledger.functions.util import apart
from skyledger.lens import queries
from skyledger.operators.pivot import spans_of_times
from skyledger.operators.typing import REJECTED, accepted, cast_numbers, rejected

SF = "/root/testdata/sf0.001"


def _optimized(df) -> str:
    """The optimized plan, with no expression cut short."""
    conf = df.sparkSession.conf
    old = conf.get("spark.sql.debug.maxToStringFields")
    conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        return df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        conf.set("spark.sql.debug.maxToStringFields", old)


@pytest.mark.parametrize("feed", [NOW, ULTRA, SHORT])
def test_rejected_fields_are_listed_without_a_lambda(spark, feed):
    text = _optimized(rejected(queries._parsed(spark, SF, feed)))
    assert "filter(array(CASE WHEN" not in text
    # the steps that hold the checks are no part of a whole stage
    assert re.search(r"Filter .*known_region#\d+.*lambda", text)


@pytest.mark.parametrize("name", ["ingest_rejects", "ingest_ultrashort", "ingest_short"])
def test_no_lambda_over_items_or_slots(spark, name):
    text = _optimized(queries.QUERIES[name](spark, SF))
    assert "transform(items#" not in text and "transform(response#" not in text
    assert not re.search(r"transform\((filter|sequence|\[1,2|hours)", text)


@pytest.mark.parametrize("feed", [ULTRA, SHORT])
def test_methods_are_short_enough_for_the_jit(spark, feed):
    explain = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for part in (accepted, rejected):
            text = explain(part(queries._parsed(spark, SF, feed))._jdf.queryExecution(), "codegen")
            sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
            assert sizes and max(sizes) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_rejected_fields_in_their_order_and_without_null(spark):
    rows = spark.createDataFrame([("1", "x", None), ("2", "5", True), (None, "NaN", False)], "REH string, WSD string, ok boolean")
    typed = cast_numbers(rows, ("REH", "WSD"), {"ok": F.col("ok")})
    # a check that is NULL does not count against a row, as before
    assert [r[REJECTED] for r in typed.collect()] == [["WSD"], [], ["REH", "WSD", "ok"]]
    assert not typed.schema[REJECTED].dataType.containsNull
    assert [r[REJECTED] for r in cast_numbers(rows, (), {}).collect()] == [[], [], []]


def test_spans_of_slots_that_are_absent_or_null(spark):
    docs = spark.createDataFrame(
        [(["b", "a", None, "b"], [1, 2, 3, 4], ["a", "b", "c"]), ([], [], ["a", None, "c"]), (None, None, None)],
        "times array<string>, n array<int>, at array<string>",
    ).withColumn("slots", F.transform("at", lambda t: F.struct(t.alias("t"))))
    spans = [r["spans"] for r in spans_of_times(docs, "slots", 3, "t", "times", "n").collect()]
    assert [s and s["n"] for s in spans[0]] == [[2], [1, 2, 3, 4], None]
    assert spans[1] == spans[2] == [None, None, None]


def test_apart_changes_no_value(spark):
    rows = spark.createDataFrame([("a",), (None,)], "v string")
    assert [r[0] for r in rows.select(apart(F.col("v"))).collect()] == ["a", None]
