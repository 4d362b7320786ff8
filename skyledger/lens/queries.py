"""The registered queries: every operator and job over the whole driver tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.constants import CATEGORIES, DATE_GROUPS, NOW, SHORT, ULTRA
from skyledger.functions import clock, icons, precipitation
from skyledger.functions.grid import grid_cell
from skyledger.lens import formulas as L
from skyledger.lens import rows as lens
from skyledger.functions.sql import register_functions
from skyledger.operators import dims, horizon, pivot, ranking
from skyledger.operators.layout import deal
from skyledger.operators.typing import REJECTED, accepted, rejected
from skyledger.plans import archive, ingest, mapview, publish, views, weekly
from skyledger.plans.latest import latest_rows
from skyledger.schemas import RAW_KEY, SNAPSHOT_KEY
from skyledger.session import scratch_dir
from skyledger.sources import dimensions, documents, zones
from skyledger.sources.landing import explode_items
from skyledger.sources.snapshot import SnapshotStore, conform
from skyledger.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]

WEEKLY_AS_OF = datetime(2024, 1, 17, 9, 30)
PUBLISH_AS_OF = datetime(2024, 1, 28, 9, 0)
SERVE_AS_OF = (datetime(2024, 1, 28, 10, 0), datetime(2024, 1, 28, 12, 0))
ZOOM = 9
MAP_TIERS = [(f"NATION_{n}", 1 + n // 8) for n in range(20)]


def flat(df: DataFrame) -> DataFrame:
    """Only text, BIGINT and DOUBLE columns, for comparison across engines."""
    columns = []
    for field in df.schema:
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, T.StructType) and kind.names == ["lng", "lat"]:
            columns += [column["lng"].alias("geom_lng"), column["lat"].alias("geom_lat")]
            continue
        if isinstance(kind, T.StructType):
            column = F.to_json(column)
        elif isinstance(kind, T.DecimalType):
            column = column.cast("double" if kind.scale else "bigint")
        elif isinstance(kind, T.IntegerType):
            column = column.cast("bigint")
        elif isinstance(kind, (T.DateType, T.TimestampNTZType)):
            column = column.cast("string")
        columns.append(column.alias(field.name))
    return df.select(*columns)


# -- views ------------------------------------------------------------------


def _view(view: Callable[[DataFrame], DataFrame], feed: str) -> Query:
    return lambda spark, sf: flat(view(lens.state(spark, sf, feed)))


# -- archive ----------------------------------------------------------------


def _period(rows: DataFrame) -> tuple[date, date]:
    """First and last issue date of raw rows."""
    low, high = rows.agg(F.min("basetime"), F.max("basetime")).first()
    return datetime.strptime(low[:8], "%Y%m%d").date(), datetime.strptime(high[:8], "%Y%m%d").date()


def _daily_zone(spark: SparkSession, sf: str, feed: str, root: str) -> tuple[str, date, date]:
    """Every issue is delivered twice: by the rows of even events, then by those of odd ones, which replace equal keys."""
    rows = lens.raw(lens.base(spark, sf), feed, "event_id")
    period = _period(rows)
    for odd in (0, 1):
        delivery = ranking.keep_last(rows.where(F.col("event_id") % 2 == odd), RAW_KEY[feed], [F.col("event_id")])
        zones.write_raw(delivery.drop("event_id"), f"{root}/raw", odd)
    archive.daily_rollup(spark, feed, f"{root}/raw", f"{root}/daily", *period)
    return f"{root}/daily", *period


def _rollup(level: str, feed: str) -> Query:
    """Raw rows moved to a level of the archive over all their periods, then read back."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        root = scratch_dir(spark, level)
        zone, first, last = _daily_zone(spark, sf, feed, root)
        months = sorted({(d.year, d.month) for d in (first + timedelta(days=n) for n in range((last - first).days + 1))})
        if level != "daily":
            for year, month in months:
                archive.monthly_rollup(spark, feed, zone, f"{root}/monthly", year, month)
            zone = f"{root}/monthly"
        if level == "yearly":
            for year in sorted({year for year, _ in months}):
                archive.yearly_rollup(spark, feed, zone, f"{root}/yearly", year)
            zone = f"{root}/yearly"
        return flat(zones.read_zone(spark, zone, feed))

    return run


def weekly_city_temp(spark: SparkSession, sf: str) -> DataFrame:
    return flat(weekly.weekly_city_temp(lens.raw(lens.base(spark, sf), NOW), WEEKLY_AS_OF))


def weekly_table(spark: SparkSession, sf: str) -> DataFrame:
    """The weekly job as it runs: partitioned daily zone in, overwritten table out."""
    root = scratch_dir(spark, "weekly")
    daily, _, _ = _daily_zone(spark, sf, NOW, root)
    table = weekly.weekly_city_temp(weekly.read_week(spark, daily, WEEKLY_AS_OF), WEEKLY_AS_OF)
    weekly.write_weekly(table, f"{root}/summary")
    return flat(spark.read.parquet(f"{root}/summary"))


def filename_dates(spark: SparkSession, sf: str) -> DataFrame:
    events = spark.read.parquet(f"{sf}/events.parquet")
    named = events.select("event_id", F.concat(clock.stamp12(F.col("ts")), F.lit("_weather_now.parquet")).alias("file"))
    issued = named.select("event_id", zones.issue_of_file(F.col("file")).alias("issue"))
    return flat(zones.with_issue_date(issued))


def raw_redelivery(spark: SparkSession, sf: str) -> DataFrame:
    """All issues delivered, then those of 06 and 18 o'clock again, whole, with fewer and other rows; what raw holds."""
    root = scratch_dir(spark, "raw")
    rows = lens.raw(lens.base(spark, sf), ULTRA, "event_id")
    zones.write_raw(rows.drop("event_id"), root, 1, whole=True)
    again = rows.where(F.substring("basetime", 9, 2).isin("06", "18") & (F.col("event_id") % 2 == 1))
    zones.write_raw(again.withColumn("REH", F.col("REH") + 1).drop("event_id"), root, 2, whole=True)
    return flat(zones.read_raw(spark, root, ULTRA, *_period(rows)))


def raw_files(spark: SparkSession, sf: str) -> DataFrame:
    """A flat folder with one file per issue, read by the issue time in the names of its files."""
    root = scratch_dir(spark, "flat")
    rows = lens.raw(lens.base(spark, sf), NOW).withColumn("issue", F.col("basetime"))
    rows.repartition("issue").write.partitionBy("issue").parquet(f"{root}/parted")
    # the files get their names on the store, one for each issue
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fs.mkdirs(path(f"{root}/flat"))
    for status in fs.globStatus(path(f"{root}/parted/issue=*/part-*.parquet")):
        issue = status.getPath().getParent().getName().removeprefix("issue=")
        fs.rename(status.getPath(), path(f"{root}/flat/{issue}_weather_now.parquet"))
    read = zones.read_raw_files(spark, f"{root}/flat", NOW, *_period(rows))
    return flat(zones.with_issue_date(read).drop("batch"))


# -- scalar operators -------------------------------------------------------


def icon_short(spark: SparkSession, sf: str) -> DataFrame:
    rows = lens.raw(lens.base(spark, sf), SHORT, "event_id").drop("icon_map")
    key = icons.weather_key_short(F.col("PTY"), F.col("SKY"), F.col("PCP"), F.col("SNO"))
    shown = dims.attach_icon(rows, dimensions.default_icons(spark), key, F.lit("day"))
    return flat(shown.select("event_id", "icon_map"))


def icon_ultra(spark: SparkSession, sf: str) -> DataFrame:
    rows = lens.raw(lens.base(spark, sf), ULTRA, "event_id", "ts").drop("icon_map")
    key = icons.weather_key_ultra(F.col("PTY"), F.col("SKY"), F.col("LGT"), F.col("RN1"))
    folder = F.when(clock.is_daytime(F.col("ts")), F.lit("day")).otherwise(F.lit("night"))
    shown = dims.attach_icon(rows, dimensions.default_icons(spark), key, folder)
    severity = icons.severity_ultra(icons.key_of_icon(F.col("icon_map")))
    return flat(shown.select("event_id", "icon_map", severity.alias("severity")))


def norm_precip(spark: SparkSession, sf: str) -> DataFrame:
    events = spark.read.parquet(f"{sf}/events.parquet")
    sent = events.selectExpr(
        "event_id",
        f"{L.sent_rain(lens.D, 'event_id')} AS rain",
        f"{L.sent_snow(lens.D, 'event_id')} AS snow",
    )
    rain, snow = F.col("rain"), F.col("snow")
    return flat(
        sent.select(
            "event_id",
            precipitation.norm_rain_now(rain).alias("rn1_now"),
            precipitation.norm_rain(rain).alias("rain"),
            precipitation.norm_snow(snow).alias("snow"),
            precipitation.first_number(rain).alias("rain_number"),
            precipitation.rain_order_ultra(precipitation.norm_rain(rain)).alias("rain_order"),
            precipitation.snow_order(precipitation.norm_snow(snow)).alias("snow_order"),
            icons.rain_class(rain).alias("rain_class"),
            icons.snow_class(snow).alias("snow_class"),
        )
    )


def base_times(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.col("ts")
    month = clock.previous_month(ts)
    return flat(
        spark.read.parquet(f"{sf}/events.parquet").select(
            "event_id",
            clock.stamp12(clock.base_time_now(ts)).alias("base_now"),
            clock.stamp12(clock.base_time_ultra(ts)).alias("base_ultra"),
            clock.stamp12(clock.base_time_short(ts)).alias("base_short"),
            clock.stamp8(clock.previous_day(ts)).alias("prev_day"),
            (F.year(month) * 100 + F.month(month)).alias("prev_month"),
            clock.previous_year(ts).alias("prev_year"),
            clock.is_daytime(ts).cast("int").alias("daytime"),
            *[clock.stamp8(F.date_add(ts.cast("date"), n)).alias(group) for group, n in DATE_GROUPS.items()],
        )
    )


def horizon_slots(spark: SparkSession, sf: str) -> DataFrame:
    """Every slot of the issue each event falls into."""
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts")
    hour = F.hour(clock.base_time_ultra(F.col("ts")))
    return flat(horizon.explode_slots(events, hour).drop("ts"))


def _dealt_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events dealt over all cores for the work on their payloads; counting reads the footers only."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    return deal(events, events.count())


def _named_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as cities of their own."""
    return _dealt_events(spark, sf).withColumn("n_name", F.col("event_id").cast("string"))


def horizon_match(spark: SparkSession, sf: str) -> DataFrame:
    """Payload items of the slots, with their lead index."""
    docs = lens.documents(_named_events(spark, sf), ULTRA)
    hour = clock.base_hour(F.col("basetime")).try_cast("int")
    items = horizon.within_horizon(explode_items(docs), hour, F.col("fcstTime"))
    return flat(items.groupBy("city", "fcsthour").agg(F.count("*").alias("items")).withColumnRenamed("city", "event"))


def grid_projection(spark: SparkSession, sf: str) -> DataFrame:
    customers = spark.read.parquet(f"{sf}/customer.parquet").selectExpr(
        "c_custkey", f"{L.GRID_LAT} AS lat", f"{L.GRID_LNG} AS lng"
    )
    return flat(customers.select("c_custkey", grid_cell(F.col("lat"), F.col("lng")).alias("cell")).select("c_custkey", "cell.*"))


# -- ingest -----------------------------------------------------------------


def _parsed(spark: SparkSession, sf: str, feed: str) -> DataFrame:
    docs = lens.documents(lens.place(_dealt_events(spark, sf), sf), feed)
    return ingest.parse(feed, docs, lens.regions(spark, sf), dimensions.default_icons(spark))


def _ingest(feed: str) -> Query:
    return lambda spark, sf: flat(accepted(_parsed(spark, sf, feed)))


def _ingest_state(feed: str) -> Query:
    """Payload documents in three deliveries through the ingest stream to the latest state."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        root = scratch_dir(spark, "ingest-state")
        store = SnapshotStore(spark, f"{root}/state", feed)
        regions, icon_dim = lens.regions(spark, sf), dimensions.default_icons(spark)

        landed = spark.read.parquet(f"{sf}/events.parquet")
        rows = landed.count()

        def deliver(events: DataFrame) -> None:
            jobs.ingest_stream(
                lens.documents(lens.place(deal(events, rows // 3), sf), feed), feed, regions, icon_dim,
                raw_root=f"{root}/raw", rejects_root=f"{root}/rejects", checkpoint=f"{root}/checkpoint", store=store,
            )

        _in_pieces(landed, F.col("event_id") % 3, 3, f"{root}/in", deliver)
        return flat(store.read())

    return run


def ingest_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """What the quarantine holds: rows per feed and unusable fields."""
    parts = []
    for feed in (NOW, ULTRA, SHORT):
        fields = F.array_join(REJECTED, ",").alias("fields")
        parts.append(rejected(_parsed(spark, sf, feed)).select(F.lit(feed).alias("feed"), fields))
    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return flat(union.groupBy("feed", "fields").agg(F.count("*").alias("rows")))


def pivot_items(spark: SparkSession, sf: str) -> DataFrame:
    """Long items, one row each, to wide rows; the last of a repeated category wins."""
    items = explode_items(lens.documents(_named_events(spark, sf), SHORT))
    key = ["city", "basetime", "fcstDate", "fcstTime"]
    return flat(pivot.items_to_wide(items, key, CATEGORIES[SHORT]).withColumnRenamed("city", "event"))


def regions_json(spark: SparkSession, sf: str) -> DataFrame:
    """The region dimension as one JSON text, loaded and joined to the nowcast payloads."""
    path = f"{scratch_dir(spark, 'regions')}/region.json"
    info = F.struct("province", "lat", "lng")
    cities = F.map_from_entries(F.collect_list(F.struct("city", info)))  # one row a city
    lens.regions(spark, sf).select(F.to_json(cities).alias("value")).coalesce(1).write.text(path)
    docs = lens.documents(lens.place(_dealt_events(spark, sf), sf), NOW)
    parsed = accepted(ingest.parse_now(docs, dimensions.load_regions(spark, path)))
    return flat(parsed.groupBy("city", "province", "lat", "lng").agg(F.count("*").alias("rows")))


def icons_json(spark: SparkSession, sf: str) -> DataFrame:
    """An icon set of its own as one JSON text, loaded and joined to the short forecast by weather and folder."""
    path = f"{scratch_dir(spark, 'icons')}/icons.json"
    files = dimensions.default_icons(spark).groupBy("folder").agg(
        F.map_from_entries(F.collect_list(F.struct("weather_key", F.concat(F.lit("set/"), "icon_file")))).alias("files")
    )
    text = F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("folder", "files"))).alias("icons")))
    files.agg(text.alias("value")).coalesce(1).write.text(path)
    rows = lens.raw(lens.base(spark, sf), SHORT, "event_id").drop("icon_map")
    key = icons.weather_key_short(F.col("PTY"), F.col("SKY"), F.col("PCP"), F.col("SNO"))
    folder = F.when(F.col("event_id") % 2 == 0, F.lit("day")).otherwise(F.lit("night"))
    return flat(dims.attach_icon(rows, dimensions.load_icons(spark, path), key, folder).select("event_id", "icon_map"))


def sql_surface(spark: SparkSession, sf: str) -> DataFrame:
    """Views and functions as a user of SQL meets them."""
    short = lens.state(spark, sf, SHORT)
    register_functions(spark)
    views.register_views(lens.state(spark, sf, ULTRA), short)
    short.createOrReplaceTempView("short_rows")
    return flat(spark.sql("""
        SELECT w.`도시` AS city, w.fcstdate, w.`풍향` AS wind_dir, w.`풍속` AS wind_speed, h.`습도` AS humidity, k.weather, k.n, k.worst
        FROM short_wind w JOIN short_humid h ON h.`도시` = w.`도시` AND h.fcstdate = w.fcstdate
        JOIN (SELECT city, fcstdate, weather_key_short(CAST(PTY AS STRING), CAST(SKY AS STRING), PCP, SNO) AS weather, count(*) AS n,
                max(severity_short(split_part(icon_map, '_', 1))) AS worst
              FROM short_rows GROUP BY ALL) k
          ON k.city = w.`도시` AND k.fcstdate = w.fcstdate"""))


# -- latest state -----------------------------------------------------------


def _snapshot(feed: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = latest_rows(lens.raw(lens.base(spark, sf), feed, "event_id"), feed)
        kept = ranking.keep_last(rows, SNAPSHOT_KEY[feed], [F.col("event_id")])
        return flat(conform(kept, feed))

    return run


def snapshot_store(spark: SparkSession, sf: str) -> DataFrame:
    """All rows loaded as one state, keys checked, then read back."""
    store = SnapshotStore(spark, scratch_dir(spark, "state"), ULTRA)
    rows = latest_rows(lens.raw(lens.base(spark, sf), ULTRA, "event_id"), ULTRA)
    store.replace(rows, on_dup="last", order=[F.col("event_id")])
    return flat(store.read())


# -- publish ----------------------------------------------------------------


def _features(spark: SparkSession, sf: str) -> list[tuple[DataFrame, DataFrame]]:
    today = PUBLISH_AS_OF.date()
    return [
        (publish.ultrashort_features(lens.state(spark, sf, ULTRA)), publish.ultrashort_keys(spark)),
        (publish.short_features(lens.state(spark, sf, SHORT), today), publish.short_keys(spark, today)),
    ]


def publish_keys(spark: SparkSession, sf: str) -> DataFrame:
    counts = [publish.feature_counts(features, keys) for features, keys in _features(spark, sf)]
    return flat(counts[0].unionByName(counts[1]))


def geojson_features(spark: SparkSession, sf: str) -> DataFrame:
    both = [features for features, _ in _features(spark, sf)]
    return flat(both[0].unionByName(both[1]))


def feature_collection(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of all twenty documents."""
    ultra, short = _features(spark, sf)
    docs = publish.documents(*ultra, PUBLISH_AS_OF).unionByName(publish.documents(*short, PUBLISH_AS_OF))
    return flat(docs)


def serve_geojson(spark: SparkSession, sf: str) -> DataFrame:
    """Both jobs into one store, read an hour later and three hours later: by then the very-short keys have run out."""
    root = scratch_dir(spark, "documents")
    publish.publish_ultrashort(lens.state(spark, sf, ULTRA), root, PUBLISH_AS_OF)
    publish.publish_short(lens.state(spark, sf, SHORT), root, PUBLISH_AS_OF)
    keys = publish.ultrashort_keys(spark).select("cache_key").unionByName(
        publish.short_keys(spark, PUBLISH_AS_OF.date()).select("cache_key")
    )
    docs = documents.read_documents(spark, root)
    served = [documents.serve(docs, keys, at).withColumn("hours", F.lit((at - PUBLISH_AS_OF).seconds // 3600)) for at in SERVE_AS_OF]
    return flat(served[0].unionByName(served[1]))


def map_tier_features(spark: SparkSession, sf: str) -> DataFrame:
    tiers = dimensions.inline_table(spark, MAP_TIERS, ["city", "tier"])
    return flat(mapview.map_features(views.short_wind(lens.state(spark, sf, SHORT)), tiers, ZOOM))


def cities_without_tier(spark: SparkSession, sf: str) -> DataFrame:
    tiers = dimensions.inline_table(spark, MAP_TIERS, ["city", "tier"])
    return flat(mapview.cities_without_tier(views.short_humid(lens.state(spark, sf, SHORT)), tiers))


# -- streaming --------------------------------------------------------------


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    # a pattern, as a stream takes a single file only through one
    return spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]")


def _in_pieces(rows: DataFrame, piece: Column, n: int, root: str, deliver: Callable[[DataFrame], None]) -> None:
    """Bring the rows as a stream in n micro-batches, by ``piece``: a piece lands as many files, then the stream runs."""
    for k in range(n):
        rows.where(piece == k).write.mode("append").parquet(root)
        deliver(rows.sparkSession.readStream.schema(rows.schema).parquet(root))


def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Payload documents as a stream into the raw zone, read back."""
    root = scratch_dir(spark, "ingest")
    docs = lens.documents(lens.place(_event_stream(spark, sf), sf), NOW)
    jobs.ingest_stream(
        docs, NOW, lens.regions(spark, sf), dimensions.default_icons(spark),
        raw_root=f"{root}/raw", rejects_root=f"{root}/rejects", checkpoint=f"{root}/checkpoint",
    )
    period = _period(lens.raw(lens.base(spark, sf), NOW))
    return flat(zones.read_raw(spark, f"{root}/raw", NOW, *period).drop("issue", "batch"))


def stream_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """The newest issue of a stream of raw rows that comes in three pieces, each with rows of all issues."""
    root = scratch_dir(spark, "stream-state")
    store = SnapshotStore(spark, f"{root}/state", ULTRA)
    rows = lens.raw(lens.base(spark, sf), ULTRA, "event_id")
    _in_pieces(
        rows, F.col("event_id") % 3, 3, f"{root}/in",
        lambda stream: jobs.state_stream(stream, store, [F.col("event_id")], f"{root}/checkpoint"),
    )
    return flat(store.read())


def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Events that arrive up to three times, in four micro-batches and any order of time, are kept once."""
    root = scratch_dir(spark, "dedup")
    events = spark.read.parquet(f"{sf}/events.parquet").select(
        "event_id", "user_id", F.date_format("ts", "yyyyMMdd").alias("day"), F.explode(F.sequence(F.lit(0), F.col("event_id") % 3)).alias("copy")
    )
    _in_pieces(
        events, (F.col("event_id") + F.col("copy")) % 4, 4, f"{root}/in",
        lambda stream: jobs.first_copies(stream, ["event_id"], "day", f"{root}/out", f"{root}/checkpoint"),
    )
    return flat(spark.read.parquet(f"{root}/out").select("event_id", "user_id"))


QUERIES: dict[str, Query] = {
    **{f"ultrashort_{layout}": _view(view, ULTRA) for layout, view in views.ULTRA_VIEWS.items()},
    **{f"short_{layout}": _view(view, SHORT) for layout, view in views.SHORT_VIEWS.items()},
    "ultrashort_rain_strict": _view(partial(views.ultrashort_rain, strict=True), ULTRA),
    "weekly_city_temp": weekly_city_temp,
    "weekly_table": weekly_table,
    "icon_short": icon_short,
    "icon_ultra": icon_ultra,
    "norm_precip": norm_precip,
    "base_times": base_times,
    "horizon_slots": horizon_slots,
    "horizon_match": horizon_match,
    "grid_projection": grid_projection,
    "pivot_items": pivot_items,
    "ingest_now": _ingest(NOW),
    "ingest_ultrashort": _ingest(ULTRA),
    "ingest_short": _ingest(SHORT),
    "ingest_rejects": ingest_rejects,
    "ingest_state_ultrashort": _ingest_state(ULTRA),
    "ingest_state_short": _ingest_state(SHORT),
    "regions_json": regions_json,
    "icons_json": icons_json,
    "sql_surface": sql_surface,
    "raw_redelivery": raw_redelivery,
    "raw_files": raw_files,
    "snapshot_ultra": _snapshot(ULTRA),
    "snapshot_short": _snapshot(SHORT),
    "snapshot_store": snapshot_store,
    **{f"rollup_{level}_{feed}".lower(): _rollup(level, feed) for level in ("daily", "monthly", "yearly") for feed in (NOW, ULTRA, SHORT)},
    "filename_dates": filename_dates,
    "map_tier_features": map_tier_features,
    "cities_without_tier": cities_without_tier,
    "publish_keys": publish_keys,
    "geojson_features": geojson_features,
    "feature_collection": feature_collection,
    "serve_geojson": serve_geojson,
    "stream_ingest": stream_ingest,
    "stream_snapshot": stream_snapshot,
    "stream_dedup": stream_dedup,
}
__all__ = ["QUERIES", "flat"]
