"""Condition, rain, wind and humidity per city, or per city and forecast date.

The very-short and the short forecast share each view; only the grouping and
the text rules differ. Each view first shrinks the rows with a hash aggregate,
which combines on the map side, and ranks what is left: a city with a third of
all rows costs its tasks no more than the others send.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions import icons, labels, precipitation
from skyledger.functions.geo import geometry
from skyledger.operators.ranking import asc, best, desc, pack_wind, unpack_wind
from skyledger.schemas import NAMES as N

BY_CITY = ("city",)
BY_DATE = ("city", "fcstdate")


def _named(df: DataFrame, keys: Sequence[str], **columns: Column) -> DataFrame:
    head = [F.col(k).alias(N.get(k, k)) for k in keys]
    return df.select(*head, *[c.alias(N.get(n, n)) for n, c in columns.items()], F.col("geom"))


def _conditions(rows: DataFrame, keys: Sequence[str], temp: str, severity: Callable[[Column], Column]) -> DataFrame:
    per_icon = rows.groupBy(*keys, "icon_map", "geom").agg(
        F.count("*").alias("n"), F.max(temp).alias("high"), F.min(temp).alias("low")
    )
    # A few rows per group from here on; one exchange serves both aggregates.
    per_weather = (
        per_icon.repartition(*keys)
        .withColumn("weather", icons.key_of_icon(F.col("icon_map")))
        .groupBy(*keys, "weather")
        .agg(
            F.sum("n").alias("n"),
            F.min("icon_map").alias("icon"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max("geom").alias("geom"),
        )
    )
    # Rows without an icon count for the temperatures but cannot win.
    known = F.col("weather").isNotNull()
    top = best(
        [~known, *desc(severity(F.col("weather"))), *desc(F.col("n")), F.col("icon")],
        icon=F.col("icon"),
        weather=F.col("weather"),
    )
    per_group = per_weather.groupBy(*keys).agg(
        F.max("high").alias("high"), F.min("low").alias("low"), F.max("geom").alias("geom"), top.alias("top")
    )
    return _named(
        per_group.where(F.col("top.weather").isNotNull()),
        keys,
        temp=labels.temp_label(F.col("high"), F.col("low")),
        icon=F.col("top.icon"),
        weather=F.col("top.weather"),
    )


def ultrashort_cond(rows: DataFrame) -> DataFrame:
    view = _conditions(rows, BY_CITY, "T1H", icons.severity_ultra)
    return view.withColumn("geometry", geometry(F.col("geom")))


def short_cond(rows: DataFrame) -> DataFrame:
    return _conditions(rows, BY_DATE, "TMP", icons.severity_short)


def ultrashort_rain(rows: DataFrame, strict: bool = False) -> DataFrame:
    """The heaviest rain text of each city."""
    texts = rows.select(*BY_CITY, "RN1", "geom").distinct()
    amount = precipitation.rain_order_ultra(F.col("RN1"))
    top = best(
        [*desc(amount), *asc(F.col("RN1")), F.col("geom")],
        rn1=F.col("RN1"),
        geom=F.col("geom"),
    )
    won = texts.groupBy(*BY_CITY).agg(top.alias("top")).select(*BY_CITY, "top.*")
    return _named(won, BY_CITY, rain=precipitation.rain_label_ultra(F.col("rn1"), strict))


def short_rain(rows: DataFrame) -> DataFrame:
    """The heaviest rain, with its probability, and the heaviest snow.

    Rain and snow texts are counted side by side in one pass (grouping sets),
    not as pairs, so the groups stay few; their winners then come out of one
    grouping and need no join.
    """
    shared = [*BY_DATE, "basetime", "geom"]
    texts = rows.groupingSets([[*shared, "PCP"], [*shared, "SNO"]], *shared, "PCP", "SNO").agg(
        F.grouping("PCP").alias("is_snow"),
        F.max("POP").alias("pop"),
        F.count_if(F.col("POP").isNull()).alias("unknown"),
    )
    is_snow = F.col("is_snow") == 1
    # an unknown probability ranks above every known one
    pop = F.when(F.col("unknown") == 0, F.col("pop"))
    newest = [*desc(F.col("basetime").try_cast("bigint")), F.col("basetime")]
    heaviest = desc(precipitation.rain_order_short(F.col("PCP")))
    rain = best(
        [is_snow, *heaviest, *desc(pop), *asc(F.col("PCP")), *newest, F.col("geom")],
        pcp=F.col("PCP"),
        pop=pop,
        basetime=F.col("basetime"),
        geom=F.col("geom"),
    )
    snow = best(
        [~is_snow, *desc(precipitation.snow_order(F.col("SNO"))), *asc(F.col("SNO")), *newest],
        sno=F.col("SNO"),
        basetime=F.col("basetime"),
    )
    won = texts.groupBy(*BY_DATE).agg(rain.alias("r"), snow.alias("s")).withColumn("geom", F.col("r.geom"))
    date = F.col("fcstdate")
    return _named(
        won,
        BY_DATE,
        rain=precipitation.rain_label_short(F.col("r.pcp"), date, F.col("r.basetime")),
        snow=precipitation.snow_label_short(F.col("s.sno"), date, F.col("s.basetime")),
        pop=F.col("r.pop"),
    )


def _wind(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The strongest wind and its direction."""
    per_point = rows.groupBy(*keys, "geom").agg(F.max(pack_wind(F.col("WSD"), F.col("VEC"))).alias("wind"))
    top = best([-F.col("wind"), F.col("geom")], wind=F.col("wind"), geom=F.col("geom"))
    won = per_point.groupBy(*keys).agg(top.alias("top")).select(*keys, "top.*")
    speed, direction = unpack_wind(F.col("wind"))
    return _named(won, keys, wind_dir=labels.compass16(direction), wind_speed=speed)


def ultrashort_wind(rows: DataFrame) -> DataFrame:
    return _wind(rows, BY_CITY)


def short_wind(rows: DataFrame) -> DataFrame:
    return _wind(rows, BY_DATE)


def _humidity(rows: DataFrame, keys: Sequence[str], shown: Sequence[str]) -> DataFrame:
    mean = F.round(F.avg("REH"), 0).cast("decimal(10,0)")
    return _named(rows.groupBy(*keys, "geom").agg(mean.alias("mean")), shown, humidity=F.col("mean"))


def ultrashort_humid(rows: DataFrame) -> DataFrame:
    return _humidity(rows, ("city", "basetime"), BY_CITY)


def short_humid(rows: DataFrame) -> DataFrame:
    return _humidity(rows, BY_DATE, BY_DATE)


ULTRA_VIEWS = {
    "cond": ultrashort_cond,
    "rain": ultrashort_rain,
    "wind": ultrashort_wind,
    "humid": ultrashort_humid,
}
SHORT_VIEWS = {
    "cond": short_cond,
    "rain": short_rain,
    "wind": short_wind,
    "humid": short_humid,
}


def register_views(ultra_rows: DataFrame, short_rows: DataFrame) -> None:
    """Temp views ``ultrashort_<layout>`` and ``short_<layout>`` for SQL users."""
    for layout, view in ULTRA_VIEWS.items():
        view(ultra_rows).createOrReplaceTempView(f"ultrashort_{layout}")
    for layout, view in SHORT_VIEWS.items():
        view(short_rows).createOrReplaceTempView(f"short_{layout}")
