"""Category/value items to one wide row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.util import apart


def last_value(items: Column, category: str, field: str) -> Column:
    """Value of a category in an item array; a repeated category: the last wins.

    Works inside the payload row, so a landed document turns into wide rows
    without any shuffle. The turned arrays are the same for all categories and
    made once; a search in them is compiled, which a lambda is not.
    """
    return value_at(F.reverse(items["category"]), F.reverse(items[field]), F.lit(category))


def value_at(keys: Column, values: Column, key: Column) -> Column:
    """The value that stands where the key stands first; NULL without the key."""
    return F.get(values, (F.array_position(keys, key) - 1).cast("int"))


def time_keys(items: Column) -> Column:
    """Forecast hour and category of each item, as ``time_key`` gives them."""
    return F.arrays_zip(items["fcstTime"].alias("time"), items["category"].alias("category"))


def time_key(time: Column, category: Column) -> Column:
    return F.struct(time.alias("time"), category.alias("category"))


def spans_of_times(docs: DataFrame, slots: str, n: int, at: str, times: str, *arrays: str) -> DataFrame:
    """The ``n`` slots (structs with a time ``at``), each with its stretch of the arrays, as ``spans``.

    NULL stands for a slot that does not occur among ``times``. A stretch goes
    from the first to the last item of the time, so it is short if they lie
    together; whatever lies between them is told apart by its key. All slots are
    written out, as a lambda over them is not compiled.
    """
    slot = [F.get(F.col(slots), F.lit(i)) for i in range(n)]
    first = F.array(*[F.array_position(F.col(times), s[at]).cast("int") for s in slot])
    last = F.array(*[(apart(F.size(times)) + 1 - F.array_position(F.col("turned"), s[at])).cast("int") for s in slot])

    def span(i: int) -> Column:
        start, end = F.get(F.col("first"), F.lit(i)), F.get(F.col("last"), F.lit(i))
        stretches = [F.slice(F.col(c), start, end - start + 1).alias(c) for c in arrays]
        return F.when(apart(start > 0), F.struct(slot[i].alias("slot"), *stretches))

    # Each step is referred to more than once by the next, so it stays a column of its own, evaluated once.
    return (
        docs.withColumn("turned", F.reverse(F.col(times)))
        .withColumns({"first": first, "last": last})
        .withColumn("spans", F.array(*[span(i) for i in range(n)]))
        .drop("turned", "first", "last")
    )


def items_by_time(docs: DataFrame) -> DataFrame:
    """Split each document's items by forecast date and hour, as ``groups``.

    ``groups`` is an array of ``struct<fcstdate, fcsthour, items>``. The items
    are sorted once and cut where the time changes; picking the items of every
    time out of the whole array would be quadratic in the payload. The items of
    a time keep their order.
    """
    sent = F.col("items")
    by_time = F.sort_array(
        F.arrays_zip(
            sent["fcstDate"].alias("fcstdate"),
            sent["fcstTime"].alias("fcsthour"),
            F.when(apart(F.size(sent) > 0), F.sequence(F.lit(1), F.size(sent))).alias("pos"),
            sent["category"].alias("category"),
            sent["fcstValue"].alias("fcstValue"),
        )
    )
    # Each step is referred to more than once by the next, so the optimizer
    # keeps it as a column of its own and evaluates it once per document. A lambda
    # is not compiled: each time meets the next one side by side, not by an index.
    items, times, ends = F.col("by_time"), F.col("times"), F.col("ends")
    beside = F.arrays_zip(
        F.sequence(F.lit(1), F.size(times)).alias("end"), times.alias("time"), F.slice(times, 2, F.size(times)).alias("next")
    )
    last_of_time = F.filter(beside, lambda item: ~item["time"].eqNullSafe(item["next"]))["end"]

    def group(end: Column, n: Column) -> Column:
        start = F.coalesce(F.get(ends, n - 1), F.lit(0))
        time = F.get(times, start)
        return F.struct(
            time["fcstdate"].alias("fcstdate"),
            time["fcsthour"].alias("fcsthour"),
            F.slice("sent", start + 1, end - start).alias("items"),
        )

    return (
        docs.withColumn("by_time", by_time)
        .withColumns(
            {
                "times": F.arrays_zip(items["fcstdate"].alias("fcstdate"), items["fcsthour"].alias("fcsthour")),
                "sent": F.arrays_zip(items["category"].alias("category"), items["fcstValue"].alias("fcstValue")),
            }
        )
        .withColumn("ends", F.when(F.size(times) > 0, last_of_time))
        .withColumn("groups", F.transform(ends, group))
        .drop("by_time", "times", "sent", "ends", "items")
    )


def items_to_wide(
    items: DataFrame, key: Sequence[str], categories: Sequence[str], position: str = "pos"
) -> DataFrame:
    """The same pivot for items that already lie in one row each.

    The category list is fixed, so there is no discovery pass, and the
    aggregates combine before the shuffle. Each row updates all of them, so a
    category is told by its number, and place and value are one struct: the last
    place wins, of equal places the greatest value.
    """
    number = F.array_position(F.array(*[F.lit(c) for c in categories]), F.col("category")).cast("int")
    placed = F.struct(F.col(position).alias("at"), F.col("value"))
    last = [F.max(F.when(F.col("_number_") == n, placed))["value"].alias(c) for n, c in enumerate(categories, 1)]
    return items.withColumn("_number_", number).groupBy(*key).agg(*last)
