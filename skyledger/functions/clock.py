"""Issue times, forecast slots and target periods.

Times are wall-clock values (``TIMESTAMP_NTZ``). Everything is built from
calendar fields, never through the session time zone, so results are the same
in every session.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def wall_clock(when: datetime | None) -> Column:
    """Literal of a wall-clock time.

    From text, as a Python time would pass through the zones of the process and
    of the session.
    """
    return F.lit(when and when.isoformat(sep=" ")).cast("timestamp_ntz")


def _at(day: Column, hour: Column, minute: Column) -> Column:
    return F.make_timestamp_ntz(F.year(day), F.month(day), F.day(day), hour, minute, F.lit(0))


def _minus_hours(ts: Column, hours: Column) -> Column:
    return ts - F.make_dt_interval(F.lit(0), hours)


def base_time_now(ts: Column) -> Column:
    """Issue time of the nowcast: the full hour."""
    return _at(ts, F.hour(ts), F.lit(0))


def base_time_ultra(ts: Column) -> Column:
    """Issue time of the very-short forecast: HH:30, available from HH:45."""
    shifted = _minus_hours(ts, F.when(F.minute(ts) < 45, F.lit(1)).otherwise(F.lit(0)))
    return _at(shifted, F.hour(shifted), F.lit(30))


def base_time_short(ts: Column) -> Column:
    """Issue time of the short forecast: the latest of 02, 05, ..., 23 o'clock."""
    shifted = _minus_hours(ts, F.lit(2))
    slot = F.hour(shifted) - F.hour(shifted) % 3
    return _at(shifted, slot, F.lit(0)) + F.make_dt_interval(F.lit(0), F.lit(2))


def stamp12(ts: Column) -> Column:
    """``yyyyMMddHHmm`` text of a wall-clock time."""
    number = (
        F.year(ts).cast("long") * 100000000
        + F.month(ts) * 1000000
        + F.day(ts) * 10000
        + F.hour(ts) * 100
        + F.minute(ts)
    )
    return F.lpad(number.cast("string"), 12, "0")


def stamp8(day: Column) -> Column:
    """``yyyyMMdd`` text of a date or wall-clock time."""
    return F.date_format(day.cast("date"), "yyyyMMdd")


def _spelled(text: Column) -> Column:
    """``yyyy-MM-dd`` spelling of a text that starts with ``yyyyMMdd``."""
    return F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2))


def parse_stamp8(text: Column) -> Column:
    """Date of a ``yyyyMMdd`` text (or of the first 8 characters of a longer one).

    NULL when it is none. A number of eight digits leaves no room for signs and
    blanks, so the cast sees digits only.
    """
    digits = F.substring(text, 1, 8).try_cast("int").between(10**7, 10**8 - 1)
    return F.when(digits, _spelled(text).try_cast("date"))


def parse_stamp12(text: Column) -> Column:
    """Wall-clock time of a ``yyyyMMddHHmm`` text; NULL when it is not one."""
    spelled = F.concat(_spelled(text), F.lit(" "), F.substring(text, 9, 2), F.lit(":"), F.substring(text, 11, 2))
    return F.when(_is_number12(text), spelled.try_cast("timestamp_ntz"))


def _is_number12(text: Column) -> Column:
    return (F.length(text) == 12) & text.try_cast("bigint").between(10**11, 10**12 - 1)


def is_stamp8(text: Column) -> Column:
    """Whether a text is a ``yyyyMMdd`` date; never NULL."""
    return F.coalesce((F.length(text) == 8) & parse_stamp8(text).isNotNull(), F.lit(False))


def is_stamp12(text: Column) -> Column:
    """Whether a text is a ``yyyyMMddHHmm`` time; never NULL."""
    return parse_stamp12(text).isNotNull()


def base_hour(stamp: Column) -> Column:
    """``HH`` of an issue time text."""
    return F.substring(stamp, 9, 2)


def days_after(stamp: Column, days: int) -> Column:
    """``yyyyMMdd`` of the day ``days`` after an issue time text."""
    return stamp8(F.date_add(parse_stamp8(stamp), days))


def is_daytime(ts: Column) -> Column:
    """Whether a wall-clock time falls in the day hours of its season."""
    month, hour = F.month(ts), F.hour(ts)
    return (
        F.when(month.between(6, 8), hour.between(5, 19))
        .when(month.between(3, 5) | month.between(9, 11), hour.between(6, 18))
        .otherwise(hour.between(8, 17))
    )


def horizon_slots(hour: Column, slots: int = 7) -> Column:
    """Array of ``struct<fcsthour, fcsttime>``: the full hours after a base hour.

    ``fcsthour`` is the lead index from 1, ``fcsttime`` the ``HH00`` text; the
    hours wrap at midnight.
    """
    def slot(lead: int) -> Column:
        text = F.lpad(F.pmod(hour + lead, F.lit(24)).cast("string"), 2, "0")
        return F.struct(F.lit(lead).cast("long").alias("fcsthour"), F.concat(text, F.lit("00")).alias("fcsttime"))

    return F.array(*[slot(lead) for lead in range(1, slots + 1)])


def previous_day(day: Column) -> Column:
    return F.date_sub(day.cast("date"), 1)


def previous_month(day: Column) -> Column:
    return F.add_months(day.cast("date"), -1)


def previous_year(day: Column) -> Column:
    return F.year(day) - 1


def target_day(as_of: date) -> date:
    """Day a daily job that runs on ``as_of`` works on."""
    return as_of - timedelta(days=1)


def target_month(as_of: date) -> tuple[int, int]:
    """(year, month) a monthly job that runs on ``as_of`` works on."""
    last = as_of.replace(day=1) - timedelta(days=1)
    return last.year, last.month


def target_year(as_of: date) -> int:
    """Year a yearly job that runs on ``as_of`` works on."""
    return as_of.year - 1
