"""Write layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def compact(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Few, well-sized files per output partition.

    AQE merges small shuffle partitions up to the advisory size and splits a
    partition that holds too much, so one very large day is written by many
    tasks and many small issues by few.
    """
    return df.hint("rebalance", *columns)


# Rows of which each becomes a payload of several kilobytes: so many give a task of seconds.
ROWS_EACH = 20_000


def deal(df: DataFrame, rows: int) -> DataFrame:
    """Rows dealt over all cores, and over more tasks the more ``rows`` there are.

    For small rows that costly work follows on. The number of partitions a file comes in says little: all rows of
    one row group lie in one of them, and bytes do not tell the work. So the rows move once, whatever they lie in.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-rows // ROWS_EACH)))


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores if the input came in fewer pieces, as a file that cannot be split does.

    The rows move once before the work on them begins; an input of enough pieces stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
