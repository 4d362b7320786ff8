"""Raw, daily, monthly and yearly zones (Parquet)."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.operators.layout import compact
from skyledger.schemas import RAW

ISSUE_FILE = r"^(\d{12})"


def _days(start: date, end: date) -> list[str]:
    return [f"{start + timedelta(days=n):%Y%m%d}" for n in range((end - start).days + 1)]


def _plus(feed: str, kind: T.DataType, *columns: str) -> T.StructType:
    return T.StructType([*RAW[feed].fields, *[T.StructField(c, kind) for c in columns]])


def checked(df: DataFrame, what: str, missing_ok: bool) -> DataFrame:
    if not missing_ok and df.isEmpty():
        raise FileNotFoundError(f"no rows in {what}")
    return df


# -- raw --------------------------------------------------------------------


_RAW_FOLDERS = ["issue_date", "issue", "batch"]


_COMMITS = "issue_date STRING, issue STRING, batch BIGINT, whole BOOLEAN"


def write_raw(df: DataFrame, root: str, batch: int = 0, whole: bool = False) -> None:
    """Write issues as one delivery; readers see it once its commits are logged.

    One folder per issue time stands for one file per issue: a crowded issue
    can then be many files, written by many tasks. Only rows of the same
    ``batch`` are replaced, so a stream may bring an issue in pieces and still
    repeat a batch safely. A ``whole`` delivery replaces what batches before it
    brought for its issues. The rows are computed twice, for the files and for
    the log; persist what is costly.
    """
    keyed = (
        df.withColumn("issue_date", F.substring("basetime", 1, 8))
        .withColumn("issue", F.col("basetime"))
        .withColumn("batch", F.lit(batch).cast("bigint"))
    )
    (
        compact(keyed, _RAW_FOLDERS)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*_RAW_FOLDERS)
        .parquet(root)
    )
    log = keyed.select(*_RAW_FOLDERS).distinct().withColumn("whole", F.lit(whole))
    compact(log, ["issue_date"]).write.mode("append").partitionBy("issue_date").parquet(f"{root}/_commits")


def raw_commits(spark: SparkSession, root: str, days: str = "*") -> DataFrame | None:
    """(issue, batch) of the deliveries that are current; None for a folder without a log."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_commits")
    if not folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder):
        return None
    log = _read_folders(spark, f"{root}/_commits", f"issue_date={days}", T.StructType.fromDDL(_COMMITS))
    batches = log.groupBy("issue").agg(F.collect_set("batch").alias("batches"), F.max(F.when(F.col("whole"), F.col("batch"))).alias("since"))
    return batches.select("issue", "since", F.explode("batches").alias("batch")).where("since IS NULL OR batch >= since").drop("since")


def _read_folders(spark: SparkSession, root: str, folders: str, schema: T.StructType) -> DataFrame:
    """Read some folders of a zone. Only they are listed; none at all gives no rows."""
    try:
        return spark.read.schema(schema).option("basePath", root).parquet(f"{root}/{folders}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_raw(spark: SparkSession, root: str, feed: str, start: date, end: date | None = None,
             missing_ok: bool = False) -> DataFrame:
    """Raw rows of the given days, with ``issue`` (12 digits) and ``batch`` from the folder.

    Of an issue that was delivered whole more than once, the last delivery and
    what came after it are read; what no commit names is not.
    """
    days = ",".join(_days(start, end or start))
    schema = _plus(feed, T.StringType(), "issue_date", "issue").add("batch", T.LongType())
    df = _read_folders(spark, root, f"issue_date={{{days}}}", schema)
    current = raw_commits(spark, root, f"{{{days}}}")
    if current is not None:
        df = df.join(current, ["issue", "batch"], "left_semi")
    return checked(df, f"{root} for {days}", missing_ok).drop("issue_date")


def read_raw_files(spark: SparkSession, root: str, feed: str, start: date, end: date | None = None,
                   missing_ok: bool = False) -> DataFrame:
    """The same from a flat folder of ``<12 digits>_....parquet`` files."""
    end = end or start
    pattern = "{" + ",".join(_days(start, end)) + "}*.parquet"
    df = spark.read.schema(RAW[feed]).option("pathGlobFilter", pattern).parquet(root)
    df = checked(df, f"{root}/{pattern}", missing_ok)
    issue = issue_of_file(F.col("_metadata.file_name"))
    return df.withColumn("issue", issue).withColumn("batch", F.lit(0).cast("bigint"))


def issue_of_file(file_name: Column) -> Column:
    """Issue time at the start of a file name; NULL when there is none."""
    stamp = F.regexp_extract(file_name, ISSUE_FILE, 1)
    return F.when(stamp != "", stamp)


def with_issue_date(df: DataFrame, issue: str = "issue") -> DataFrame:
    """Columns ``year``, ``month`` and ``day`` of the issue time.

    A row without an issue time fails the job instead of landing in a partition
    of its own.
    """
    def part(start: int, size: int) -> Column:
        number = F.substring(issue, start, size).try_cast("int")
        wrong = F.raise_error(F.concat(F.lit("no issue time: "), F.coalesce(issue, F.lit("NULL")))).cast("int")
        return F.coalesce(number, wrong)

    return df.withColumns({"year": part(1, 4), "month": part(5, 2), "day": part(7, 2)})


# -- processed zones --------------------------------------------------------


def write_zone(df: DataFrame, root: str, partitions: Sequence[str], mode: str = "overwrite",
               compacted: bool = False) -> None:
    """Write a partitioned zone.

    ``overwrite`` replaces exactly the partitions that ``df`` holds, so a rerun
    changes nothing; ``append`` adds to them.
    """
    if mode not in ("overwrite", "append"):
        raise ValueError(f"unknown write mode: {mode}")
    out = compact(df, partitions) if compacted else df
    writer = out.write.mode(mode).partitionBy(*partitions)
    if mode == "overwrite":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(root)


def read_days(spark: SparkSession, root: str, feed: str, start: date, end: date) -> DataFrame:
    """Rows of some days of the daily zone. Only the folders of these days are listed."""
    schema = _plus(feed, T.IntegerType(), "year", "month", "day")
    days = [start + timedelta(days=n) for n in range((end - start).days + 1)]
    folders = ",".join(f"year={d.year}/month={d.month}/day={d.day}" for d in days)
    return _read_folders(spark, root, f"{{{folders}}}", schema)


def read_zone(spark: SparkSession, root: str, feed: str, year: int | None = None,
              month: int | None = None) -> DataFrame:
    """Rows of a zone; a year limits which folders are listed, a month which are read."""
    schema = _plus(feed, T.IntegerType(), "year", "month", "day")
    if year is None:
        return spark.read.schema(schema).parquet(root)
    df = _read_folders(spark, root, f"year={year}", schema)
    return df if month is None else df.where(F.col("month") == month)
