"""Command line of the jobs, for ``spark-submit`` or ``python -m skyledger.jobs``.

Every job takes the date or time it runs for, so a rerun does what the first
run did, and fails with an exit code a scheduler can see.
"""

from __future__ import annotations

import argparse
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession

from skyledger.constants import FEEDS, NOW, SHORT, ULTRA
from skyledger.functions import clock
from skyledger.plans import archive, publish, weekly
from skyledger.session import build_session
from skyledger.sources import dimensions
from skyledger.sources.landing import stream_landing
from skyledger.sources.snapshot import SnapshotStore
from skyledger.streaming import jobs


def ingest(spark: SparkSession, args: argparse.Namespace) -> None:
    """Landed documents that are new since the last run: raw zone and latest state."""
    icons: DataFrame = dimensions.load_icons(spark, args.icons) if args.icons else dimensions.default_icons(spark)
    keeps_state = args.feed != NOW and args.state
    jobs.ingest_stream(
        stream_landing(spark, args.landing),
        args.feed,
        dimensions.load_regions(spark, args.regions),
        icons,
        raw_root=args.raw,
        checkpoint=args.checkpoint,
        store=SnapshotStore(spark, args.state, args.feed) if keeps_state else None,
        rejects_root=args.rejects,
        as_of=args.as_of,
    )


def daily(spark: SparkSession, args: argparse.Namespace) -> None:
    """The day before ``--as-of``."""
    archive.daily_rollup(
        spark, args.feed, args.source, args.target, clock.target_day(args.as_of),
        flat_files=args.flat_files,
    )


def monthly(spark: SparkSession, args: argparse.Namespace) -> None:
    """The month before ``--as-of``."""
    archive.monthly_rollup(spark, args.feed, args.source, args.target, *clock.target_month(args.as_of))


def yearly(spark: SparkSession, args: argparse.Namespace) -> None:
    """The year before ``--as-of``."""
    archive.yearly_rollup(spark, args.feed, args.source, args.target, clock.target_year(args.as_of))


def weekly_summary(spark: SparkSession, args: argparse.Namespace) -> None:
    """The seven days before ``--as-of``."""
    table = weekly.weekly_city_temp(weekly.read_week(spark, args.source, args.as_of), args.as_of)
    weekly.write_weekly(table, args.target, args.format)


def publish_ultrashort(spark: SparkSession, args: argparse.Namespace) -> None:
    publish.publish_ultrashort(SnapshotStore(spark, args.state, ULTRA).read(), args.target, args.as_of)


def publish_short(spark: SparkSession, args: argparse.Namespace) -> None:
    publish.publish_short(SnapshotStore(spark, args.state, SHORT).read(), args.target, args.as_of)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="skyledger")
    commands = top.add_subparsers(required=True)

    def command(name: str, run, as_of, *paths: str, feed: bool = False) -> argparse.ArgumentParser:
        sub = commands.add_parser(name, help=run.__doc__)
        sub.set_defaults(run=run)
        if feed:
            sub.add_argument("--feed", choices=FEEDS, required=True)
        sub.add_argument("--as-of", type=as_of, required=True, help="wall clock in Korea, ISO format")
        for path in paths:
            sub.add_argument(f"--{path}", required=True)
        return sub

    landed = command("ingest", ingest, datetime.fromisoformat, "landing", "regions", "raw", "rejects", "checkpoint", feed=True)
    for optional in ("state", "icons"):
        landed.add_argument(f"--{optional}")
    days = command("daily", daily, date.fromisoformat, "source", "target", feed=True)
    days.add_argument("--flat-files", action="store_true", help="raw folder of <issue time>_*.parquet files")
    command("monthly", monthly, date.fromisoformat, "source", "target", feed=True)
    command("yearly", yearly, date.fromisoformat, "source", "target", feed=True)
    summary = command("weekly", weekly_summary, datetime.fromisoformat, "source", "target")
    summary.add_argument("--format", default="parquet")
    command("publish-ultrashort", publish_ultrashort, datetime.fromisoformat, "state", "target")
    command("publish-short", publish_short, datetime.fromisoformat, "state", "target")
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(build_session(f"skyledger-{args.run.__name__}"), args)


if __name__ == "__main__":
    main()
