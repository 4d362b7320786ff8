"""Quality rules: a table of thresholds compiled into one projection of text statistics.

Everything is a built-in expression over the row; there is no user function and
no shuffle. Words are runs of characters other than ASCII white space.

n_words, word_chars   words and the characters in them
n_symbols             characters of `#*$%&|<>`
n_dup_lines           lines with a word that equal an earlier line
n_repeat_words        words inside 3-word windows found twice or more
n_stop_words          words of the stop list, in any case
n_lines, n_upper, n_shouts   lines with a word, A-Z, exclamation marks

Repeated windows: windows are hashed to 64 bits and sorted as numbers whose low
bits hold the position, so equal windows are neighbours, and the work is that
of a sort for any text.

Defined results: a NULL or empty text has no words and fails; rules whose ratio
has no denominator do not fail; repeated rows are judged each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Frequent function words of the four languages.
STOP_WORDS = (
    "a an and are as at be by for from he in is it of on or that the this to was were with"  # en
    " als au auf das dem den der des die ein eine für ist mit nicht sich und von zu"  # de
    " avec dans de du elle en est et il la le les ne pas pour que qui sur un une"  # fr
    " al como con del el ella en es lo los las no para por se su una y"  # es
).split()


@dataclass(frozen=True)
class Rule:
    """`value` below `least` or above `most` fails; a base rule is part of base_failed."""

    name: str
    value: str
    least: float | None = None
    most: float | None = None
    base: bool = False


RULES = (
    Rule("few_words", "n_words", least=50, base=True),
    Rule("repeated_words", "100 * n_repeat_words - 50 * n_words", most=0, base=True),
    Rule("word_length", "word_chars / nullif(n_words, 0)", least=2, most=15),
    Rule("symbols", "n_symbols / nullif(n_words, 0)", most=0.3),
    Rule("stop_words", "n_stop_words / nullif(n_words, 0)", least=0.02),
    Rule("repeated_lines", "n_dup_lines / nullif(n_lines, 0)", most=0.4),
    Rule("upper_case", "n_upper / nullif(word_chars, 0)", most=0.4),
    Rule("shouting", "n_shouts / nullif(n_words, 0)", most=0.5),
)


def _repeat_words(words: Column, n: Column) -> list[tuple[str, Column]]:
    """Columns to add one after another; the last is the number of words in repeated windows of three."""
    bits = F.length(F.bin(n))
    high = F.call_function("shiftleft", F.lit(-1).cast("bigint"), bits)
    at = lambda x: x.bitwiseAND(F.bitwise_not(F.col("_high"))).cast("int")
    same = lambda x, y: F.coalesce(F.get("_windows", at(x)) == F.get("_windows", at(y)), F.lit(False))
    windows = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    near = lambda x, i: same(x, F.get("_sorted", i - 1)) | same(x, F.get("_sorted", i + 1))
    covered = F.transform("_places", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_places", i + 1) - p, F.lit(3))))
    return [
        ("_high", high),
        ("_windows", F.slice(windows, F.lit(1), F.greatest(n - 2, F.lit(0)).cast("int"))),
        ("_sorted", F.sort_array(F.transform("_windows", lambda x, i: x.bitwiseAND(F.col("_high")).bitwiseOR(i.cast("bigint"))))),
        ("_places", F.sort_array(F.transform(F.filter("_sorted", near), at))),
        ("n_repeat_words", F.aggregate(covered, F.lit(0).cast("bigint"), lambda total, x: total + x)),
    ]


def text_statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` of the documents and the statistics above."""
    df = docs.select(*[F.col(c) for c in keep], F.coalesce(text, F.lit("")).alias("_text"))
    words = F.col("_words")
    steps: list[tuple[str, Column]] = [
        ("_words", F.array_remove(F.split("_text", r"[\x20\x09-\x0D]+"), "")),
        ("_lines", F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))),
        ("n_words", F.size(words).cast("bigint")),
        *_repeat_words(words, F.col("n_words")),
    ]
    for name, value in steps:
        df = df.withColumn(name, value)
    count = lambda pattern: F.regexp_count("_text", F.lit(pattern)).cast("bigint")
    return df.select(
        *keep,
        "n_words",
        F.aggregate(words, F.lit(0).cast("bigint"), lambda total, w: total + F.length(w)).alias("word_chars"),
        count("[#*$%&|<>]").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        "n_repeat_words",
        F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).cast("bigint").alias("n_stop_words"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        count("[A-Z]").alias("n_upper"),
        count("!").alias("n_shouts"),
    )


def _fails(rule: Rule) -> Column:
    value = F.expr(rule.value)
    below = value < rule.least if rule.least is not None else F.lit(False)
    above = value > rule.most if rule.most is not None else F.lit(False)
    return F.coalesce(below | above, F.lit(False))


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The statistics, base_failed, the names of all rules that failed, and kept."""
    stats = text_statistics(docs, text, keep)
    base = F.lit(False)
    for rule in rules:
        base = base | _fails(rule) if rule.base else base
    failed = F.array_compact(F.array(*[F.when(_fails(rule), F.lit(rule.name)) for rule in rules]))
    return stats.withColumn("base_failed", base).withColumn("failed", failed).withColumn("kept", F.size("failed") == 0)
