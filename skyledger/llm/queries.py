"""The registered queries of the operators over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm import toxicity
from skyledger.llm.decontaminate import benchmark_hits
from skyledger.llm.line_dedup import repeated_lines
from skyledger.llm.minhash import near_duplicates
from skyledger.llm.packing import pack
from skyledger.llm.periodic_runs import periodic_runs
from skyledger.llm.quality_model import scored
from skyledger.llm.quality_rules import judged
from skyledger.llm.secrets import secret_spans
from skyledger.llm.storage import ship_code
from skyledger.llm.substring_dedup import without_repeated_spans
from skyledger.llm.token_alignment import aligned
from skyledger.llm.token_counts import token_counts
from skyledger.llm.token_files import read_token_files, write_token_files
from skyledger.session import scratch_dir

TOKEN_LIMIT = 4096


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op5_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return without_repeated_spans(_table(spark, sf, "documents").select("doc_id", "text"))


def op6_token_files(spark: SparkSession, sf: str) -> DataFrame:
    target = scratch_dir(spark, "token-files")
    write_token_files(_table(spark, sf, "documents"), target, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, target)


def op7_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    rows = secret_spans(_table(spark, sf, "documents"))
    return rows.withColumn("base_sha256", F.sha2("base_spans", 256)).drop("base_spans")


def op8_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    counts = token_counts(_table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op9_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    hits = benchmark_hits(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"), keep=["doc_id"])
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op1_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    gone = repeated_lines(docs).select(F.col("doc").alias("doc_id"), "body", "places")
    lines = docs.select("doc_id", F.xxhash64("text").alias("body"), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("bigint").alias("n_lines"))
    places = F.coalesce("places", F.array().cast("array<int>"))
    return lines.join(gone, ["doc_id", "body"], "left").select(
        "doc_id", "n_lines", F.size(places).cast("bigint").alias("n_removed"), F.array_join(places.cast("array<string>"), ",").alias("removed_lines")
    )


def op2_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    rows = judged(_table(spark, sf, "documents"))
    return rows.withColumn("failed", F.array_join("failed", ","))


def op3_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack(_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(_table(spark, sf, "documents"), words=4)


def op10_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return scored(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op11_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """One in five documents, by a checksum of the id, is held out from learning."""
    docs, labels = _table(spark, sf, "documents"), _table(spark, sf, "labels")

    def held_out(id: str) -> Column:
        return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 5 == 0, F.lit(False))

    rows = toxicity.scored(docs, toxicity.train(docs, labels, ~held_out("id")), ["doc_id"])
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def with_loops(docs: DataFrame) -> DataFrame:
    """Documents of which one in ten, by a checksum of the id, repeats a few of its words to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda word: word != "")
    chosen = F.when(h % 10 == 0, words)
    parts = docs.select("doc_id", "text", chosen.alias("words"), F.floor(h / 10).alias("g"))
    sized = parts.withColumn("n", F.size("words").cast("bigint")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    loop = sized.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    unit = F.slice("words", (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    tail = F.flatten(F.array_repeat(unit, F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    head = F.slice("words", F.lit(1), F.col("a").cast("int"))
    looped = F.slice(F.concat(head, tail), F.lit(1), F.col("n").cast("int"))
    return loop.select("doc_id", F.when(F.col("n") > 0, F.array_join(looped, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    found = periodic_runs(with_loops(_table(spark, sf, "documents")), ["doc_id"])
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")

    def better(best: Column, run: Column) -> Column:
        # in the order of start and period, so the first of equal ones stays
        more = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best.isNull() | more, run).otherwise(best)

    line = F.transform("runs", lambda run: F.concat_ws(",", run["start"], run["length"], run["period"]))
    lines = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise("")
    rows = found.select("doc_id", "collapsed", "runs", lines.alias("lines"), F.reduce("runs", none, better).alias("best"))
    return rows.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return aligned(_table(spark, sf, "documents"), ["doc_id"], a, b)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_packing": op3_packing,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_token_files": op6_token_files,
    "op7_secret_scan": op7_secret_scan,
    "op8_token_counts": op8_token_counts,
    "op9_decontaminate": op9_decontaminate,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_toxicity": op11_toxicity,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_token_alignment": op13_token_alignment,
}
