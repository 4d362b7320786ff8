"""Text to number, with the rows that do not convert set aside."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.constants import FLOAT_CATEGORIES, INT_CATEGORIES

REJECTED = "rejected_fields"
# Whole numbers that every later type of these fields holds; fixed-point fields have one decimal.
LIMITS = {"double": 999.9, "bigint": 2_147_483_647}


def cast_numbers(
    df: DataFrame, columns: Sequence[str], checks: Mapping[str, Column], strict: bool = False
) -> DataFrame:
    """Cast the number columns and list, per row, those that did not convert.

    A missing value, a value that is no number (NaN) and one beyond the types of
    the latest state count as not convertible, so a row that is taken in can be
    stored everywhere. ``checks`` adds fields with a condition of their own. With ``strict`` the first bad row fails the job, as
    a load without a quarantine would.
    """
    types = {c: "double" for c in FLOAT_CATEGORIES} | {c: "bigint" for c in INT_CATEGORIES}
    numbers = [c for c in columns if c in types]
    typed = {c: F.trim(c).try_cast(types[c]) for c in numbers}
    in_range = {c: F.coalesce(F.abs(value) <= LIMITS[types[c]], F.lit(False)) for c, value in typed.items()}
    wrong = {c: ~good for c, good in in_range.items()} | {c: ~good for c, good in checks.items()}
    # Pieces put together are compiled, conditions inside the argument of a lambda (as of array_compact) are not.
    none = F.array().cast(T.ArrayType(T.StringType(), containsNull=False))
    bad = F.concat(none, *[F.when(condition, F.array(F.lit(c))).otherwise(none) for c, condition in wrong.items()])
    if strict:
        message = F.concat(F.lit("unusable: "), F.array_join(bad, ","))
        bad = F.when(F.size(bad) > 0, F.raise_error(message).cast("array<string>")).otherwise(bad)
    return df.withColumn(REJECTED, bad).withColumns(typed)


def accepted(df: DataFrame) -> DataFrame:
    return df.where(F.size(REJECTED) == 0).drop(REJECTED)


def rejected(df: DataFrame) -> DataFrame:
    return df.where(F.size(REJECTED) > 0)
