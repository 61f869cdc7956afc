"""Calendar parts, cyclic encoding and time text."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

WEEKEND_DAYS = (5, 6)
RUSH_HOURS = (7, 8, 9, 17, 18, 19)
PERIODS = {"hour": 24, "month": 12, "dow": 7}


def hour_start(ts: Column) -> Column:
    """The full hour of a ``timestamp_ntz``, kept ``timestamp_ntz``.

    ``date_trunc`` would go through the session time zone.
    """
    zero = F.lit(0)
    return F.make_timestamp_ntz(F.year(ts), F.month(ts), F.day(ts), F.hour(ts), zero, zero)


def epoch_hours(ts: Column) -> Column:
    """Hours since 1970-01-01 as bigint, free of any time zone."""
    return F.unix_date(F.to_date(ts)).cast("long") * 24 + F.hour(ts)


def weekend_flag(day_of_week: Column) -> Column:
    return day_of_week.isin(*WEEKEND_DAYS).cast("int")


def rush_flag(hour: Column) -> Column:
    return hour.isin(*RUSH_HOURS).cast("int")


def calendar_parts(ts: Column) -> dict[str, Column]:
    """hour, day_of_week (Monday = 0), month and the two flags."""
    return {
        "hour": F.hour(ts),
        "day_of_week": F.weekday(ts),
        "month": F.month(ts),
        "is_weekend": weekend_flag(F.weekday(ts)),
        "is_rush_hour": rush_flag(F.hour(ts)),
    }


def cyclic_parts(hour: Column, month: Column, day_of_week: Column) -> dict[str, Column]:
    parts = {}
    for name, value in (("hour", hour), ("month", month), ("dow", day_of_week)):
        angle = F.lit(2 * math.pi) * value / F.lit(PERIODS[name])
        parts[f"{name}_sin"] = F.sin(angle)
        parts[f"{name}_cos"] = F.cos(angle)
    return parts


def plus_hours(ts: Column, hours: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), hours)


def parse_timestamp(text: Column, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Null where the text does not match."""
    return F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")


def parse_iso(text: Column) -> Column:
    """ISO text with or without seconds (``2025-03-04T16:00``)."""
    return text.try_cast("timestamp_ntz")


def weekday_clock(ts: Column) -> Column:
    return F.date_format(ts, "E HH:mm")


def long_clock(ts: Column) -> Column:
    return F.date_format(ts, "MMM dd, yyyy  HH:mm")


def horizon_text(hours: Column) -> Column:
    return F.concat(hours.cast("int").cast("string"), F.lit("h ahead"))
