"""Latest-state store: versions of a table, and which of them is current.

A version is written and checked completely before one small log row makes it
current. Readers therefore always see a whole version, and a failed load leaves
the old one in place. One writer per store is assumed.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass
from datetime import timedelta
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.functions.geo import make_point
from skyledger.operators.ranking import keep_last
from skyledger.schemas import SNAPSHOT, SNAPSHOT_KEY

_LOG = "seq BIGINT, version STRING, issue STRING, at_ms BIGINT"
# The order value of a row beside the columns of the state; readers do not see it.
RANK = "_rank_of_row"
LEASE = timedelta(hours=1)


def conform(df: DataFrame, feed: str, *keep: str) -> DataFrame:
    """Columns and types of the latest-state table, with the point of lat/lng, and the columns ``keep``."""
    given = df.withColumn("geom", make_point(F.col("lng"), F.col("lat")))

    def typed(name: str, wanted: T.DataType) -> Column:
        # codes arrive as text and may be anything; numbers must fit their type
        if isinstance(given.schema[name].dataType, T.StringType):
            return F.col(name).try_cast(wanted)
        return F.col(name).cast(wanted)

    return given.select(*[typed(f.name, f.dataType).alias(f.name) for f in SNAPSHOT[feed]], *keep)


def _ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    return df.withColumn(RANK, F.struct(*[c.alias(f"by{n}") for n, c in enumerate(order)]))


class KeyViolation(ValueError):
    """Rows with the same, or without a, primary key."""


@dataclass(frozen=True)
class Entry:
    seq: int
    version: str
    issue: str


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str, feed: str, lease: timedelta = LEASE):
        """``lease`` is how long a version that is no longer current stays for those who read it."""
        self.spark, self.root, self.feed, self.lease = spark, root.rstrip("/"), feed, lease
        self.key = SNAPSHOT_KEY[feed]

    # -- reading ------------------------------------------------------------

    def entry(self) -> Entry | None:
        """The current version; one row reaches the driver."""
        try:
            log = self.spark.read.schema(_LOG).parquet(f"{self.root}/log")
            top = log.agg(F.max_by(F.struct("seq", "version", "issue"), "seq").alias("top")).first()["top"]
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return Entry(top["seq"], top["version"], top["issue"]) if top else None

    def read(self) -> DataFrame:
        """The current rows; empty before the first load."""
        now = self.entry()
        if now is None:
            return self.spark.createDataFrame([], SNAPSHOT[self.feed])
        return self._version(now.version)

    def _version(self, version: str, *more: T.StructField) -> DataFrame:
        schema = T.StructType([*SNAPSHOT[self.feed].fields, *more])
        return self.spark.read.schema(schema).parquet(f"{self.root}/versions/{version}")

    # -- writing ------------------------------------------------------------

    def replace(self, df: DataFrame, on_dup: str = "fail", order: list[Column] | None = None) -> bool:
        """Make ``df`` the current state; an empty ``df`` changes nothing.

        ``on_dup="fail"`` rejects a load with a repeated key; ``"last"`` keeps
        the last row in ``order``.
        """
        if on_dup not in ("fail", "last"):
            raise ValueError(f"unknown duplicate rule: {on_dup}")
        if on_dup == "last" and not order:
            raise ValueError("keeping the last row needs an order")
        rows = keep_last(_ranked(df, order), self.key, [F.col(RANK)]) if on_dup == "last" else df
        return self._publish(conform(rows, self.feed, *[c for c in rows.columns if c == RANK]), unique=on_dup == "last")

    def _publish(self, rows: DataFrame, unique: bool) -> bool:
        """Write a version, check it, and make it current."""
        version = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/versions/{version}")
        try:
            issue = self._check(version, unique)
        except KeyViolation:
            self._delete([version])
            raise
        if issue is None:
            self._delete([version])
            return False
        now = self.entry()
        self.spark.range(1).select(
            F.lit(now.seq + 1 if now else 1).cast("bigint").alias("seq"),
            F.lit(version).alias("version"),
            F.lit(issue).alias("issue"),
            F.lit(time.time_ns() // 1_000_000).cast("bigint").alias("at_ms"),
        ).coalesce(1).write.mode("append").parquet(f"{self.root}/log")
        return True

    def _check(self, version: str, unique: bool) -> str | None:
        """Check the key of a written version; only key columns are read.

        Returns the newest issue time, None for an empty version. Rows that are
        ``unique`` by construction are not grouped again.
        """
        keys = self._version(version).select(*self.key, F.lit(1).cast("bigint").alias("n"))
        if not unique:
            keys = keys.groupBy(*self.key).agg(F.count("*").alias("n"))
        found = keys.agg(
            F.max("basetime").alias("issue"),
            F.count_if(F.col("n") > 1).alias("repeated"),
            F.count_if(reduce(Column.__or__, [F.col(c).isNull() for c in self.key])).alias("missing"),
        ).first()
        if found["repeated"] or found["missing"]:
            raise KeyViolation(
                f"{self.feed}: {found['repeated']} repeated and {found['missing']} incomplete keys {self.key}"
            )
        return found["issue"]

    def update(self, df: DataFrame, order: list[Column]) -> bool:
        """Take in rows of any issues and keep the newest issue as the state.

        An issue older than the state is ignored, rows of the same issue are
        merged by key (an issue may land in pieces), a newer issue replaces it.
        The last row of a key in ``order`` stays, and its order value with it, so
        the state is the same however the pieces arrive and however often. Rows
        of equal order are told apart by their values. ``order`` must have the
        same types in all calls.
        """
        newest = df.agg(F.max("basetime").alias("issue")).first()["issue"]
        now = self.entry()
        if newest is None or (now is not None and newest < now.issue):
            return False
        # both sides get the types of the state first: a union of text and number would cast the text strictly
        rows = conform(_ranked(df.where(F.col("basetime") == newest), order), self.feed, RANK)
        if now is not None and newest == now.issue:
            rows = rows.unionByName(self._version(now.version, rows.schema[RANK]))
        values = F.struct(*SNAPSHOT[self.feed].names)
        done = self._publish(keep_last(rows, self.key, [F.col(RANK), values]), unique=True)
        if done:
            self.expire()
        return done

    def expire(self, keep: int = 2, lease: timedelta | None = None) -> int:
        """Delete versions that stopped being current a ``lease`` ago, and their log rows; returns how many.

        The ``keep`` newest versions stay at any age. Whoever began to read a
        version while it was current has the lease to finish.
        """
        log = self.spark.read.schema(_LOG).parquet(f"{self.root}/log")
        rows = log.dropDuplicates(["seq"]).orderBy(F.desc("seq")).collect()  # one row for each version not yet deleted
        limit = time.time_ns() // 1_000_000 - (self.lease if lease is None else lease) // timedelta(milliseconds=1)
        ended = [None, *[row["at_ms"] or 0 for row in rows]]
        kept = {row["version"] for n, row in enumerate(rows) if n < keep or ended[n] > limit}
        fs, folder = self._files("versions")
        old = [s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName() not in kept]
        self._delete(old)
        # one small file a version; those of kept versions are the newest
        fs, folder = self._files("log")
        parts = [s for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")]
        for status in sorted(parts, key=lambda s: s.getModificationTime())[: -8 * max(keep, len(kept))]:
            fs.delete(status.getPath(), False)
        return len(old)

    def _files(self, name: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), folder

    def _delete(self, versions: list[str]) -> None:
        fs, folder = self._files("versions")
        for version in versions:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(folder, version), True)
