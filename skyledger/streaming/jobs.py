"""Incremental ingest, latest state and re-delivery safety."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.storagelevel import StorageLevel

from skyledger.operators.layout import compact, spread
from skyledger.operators.typing import accepted, rejected
from skyledger.plans.ingest import parse
from skyledger.plans.latest import latest_rows
from skyledger.sources.snapshot import SnapshotStore
from skyledger.sources.zones import write_raw


def run_available(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process what has arrived since the last run, then stop."""
    query = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def ingest_stream(
    docs: DataFrame,
    feed: str,
    regions: DataFrame,
    icon_dim: DataFrame,
    *,
    raw_root: str,
    checkpoint: str,
    rejects_root: str,
    store: SnapshotStore | None = None,
    as_of: datetime | None = None,
) -> StreamingQuery:
    """Landed documents to the raw zone and, if given, to the latest state.

    A replayed batch rewrites its own part of each issue and merges the same
    keys, so a restart after any failure leaves one copy of every row. Rows that
    cannot be used, and documents that cannot be read, go to ``rejects_root``.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = parse(feed, spread(batch), regions, icon_dim, as_of=as_of).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            good = accepted(rows)
            if not good.isEmpty():
                write_raw(good, raw_root, batch_id + 1)
                if store is not None:
                    # a later batch wins; copies within one batch: any order will do, but always the same
                    latest = latest_rows(good, feed)
                    store.update(latest, [F.lit(batch_id).cast("bigint"), F.struct(*latest.columns)])
            rejected(rows).write.mode("overwrite").parquet(f"{rejects_root}/batch={batch_id}")
        finally:
            rows.unpersist()

    return run_available(docs, handle, checkpoint)


def state_stream(rows: DataFrame, store: SnapshotStore, order: Sequence[Column], checkpoint: str) -> StreamingQuery:
    """Keep the newest issue of a stream of raw rows as the latest state."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            store.update(latest_rows(kept, store.feed), list(order))
        finally:
            kept.unpersist()

    return run_available(rows, handle, checkpoint)


BUCKETS = 1024


def key_bucket(key: Sequence[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def seen_keys(spark: SparkSession, root: str, key_schema: str, partition: str, kind: str, batch: int) -> DataFrame:
    """Keys that batches before ``batch`` have written, by the folders of ``partition``."""
    schema = f"{key_schema}, bucket INT, `{partition}` {kind}, batch BIGINT"
    return spark.read.schema(schema).parquet(f"{root}/_keys").where(F.col("batch") < batch)


def not_seen(once: DataFrame, seen: DataFrame, key: Sequence[str], partition: str) -> DataFrame:
    """Rows whose key is not among those seen; only the folders and buckets of these rows are read."""
    # the partition values of one batch, and its buckets
    touched = once.agg(F.collect_set(partition).alias("folders"), F.collect_set("bucket").alias("buckets")).first()
    here = F.col(partition).isin(touched["folders"]) & F.col("bucket").isin(touched["buckets"])
    return once.join(seen.where(here).select(*key), list(key), "left_anti")


def first_copies(
    rows: DataFrame, key: Sequence[str], partition: str, root: str, checkpoint: str, buckets: int = BUCKETS
) -> StreamingQuery:
    """Write the rows of a stream whose key has not come before, by the folders of ``partition``.

    Beside the rows lies an index of the keys that have come, in folders of the
    partition value and, within them, in the order of a bucket of the key's hash.
    A batch is compared with keys alone, and a small one with the files and row
    groups of the buckets it touches, so the rows of earlier batches are not read
    again. Nothing depends on the order or the delay of arrival, and no
    row is given up. A batch has folders of its own for rows and keys, and a
    replayed one is compared with the batches before it only, so a restart
    writes the same rows again.
    """
    schema = rows.schema
    fields = [schema[c] for c in key if c != partition]
    key_schema = schema_text(T.StructType(fields))
    kind = schema[partition].dataType.simpleString()

    def write(df: DataFrame, folder: str, *folders: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(folder)

    def handle(batch: DataFrame, batch_id: int) -> None:
        once = batch.dropDuplicates(list(key)).withColumn("bucket", key_bucket(key, buckets))
        once = once.withColumn("batch", F.lit(batch_id).cast("bigint")).persist(StorageLevel.MEMORY_AND_DISK)
        new = once
        try:
            if batch_id:
                seen = seen_keys(batch.sparkSession, root, key_schema, partition, kind, batch_id)
                new = not_seen(once, seen, key, partition).persist(StorageLevel.MEMORY_AND_DISK)
            write(compact(new.drop("bucket"), [partition]), root, partition, "batch")
            index = new.select(*[f.name for f in fields], "bucket", partition, "batch").repartitionByRange(partition, "bucket")
            write(index.sortWithinPartitions(partition, "bucket"), f"{root}/_keys", partition, "batch")
        finally:
            new.unpersist()
            once.unpersist()

    return run_available(rows, handle, checkpoint)


def schema_text(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
