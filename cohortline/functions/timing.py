"""Timestamps without zone, read as UTC wall-clock time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortline.functions.clean import col

MICROS_PER_HOUR = 3_600_000_000

# Month-first layouts of the raw extracts.
DATETIME_LAYOUT = "M/d/yyyy H:mm:ss"
DATE_LAYOUT = "M/d/yyyy"


def parse_datetime(c: Column | str, layout: str = DATETIME_LAYOUT) -> Column:
    """Month-first text to timestamp; unreadable text becomes null."""
    return F.try_to_timestamp(col(c), F.lit(layout)).cast("timestamp_ntz")


def parse_date(c: Column | str) -> Column:
    return parse_datetime(c, DATE_LAYOUT)


def micros_between(start: Column | str, end: Column | str) -> Column:
    return F.timestamp_diff("MICROSECOND", col(start), col(end))


def hours_between(start: Column | str, end: Column | str) -> Column:
    return micros_between(start, end) / F.lit(float(MICROS_PER_HOUR))


def days_between(start: Column | str, end: Column | str) -> Column:
    return hours_between(start, end) / F.lit(24.0)


def day_of(c: Column | str) -> Column:
    return F.date_trunc("day", col(c)).cast("timestamp_ntz")


def plus_days(c: Column | str, days: int) -> Column:
    return col(c) + F.expr(f"INTERVAL {int(days)} DAY")


def time_slot(ts: Column | str, hours: float) -> Column:
    """Number of the fixed-width slot holding ``ts``; never decreases as ``ts`` grows."""
    width = max(1, round(hours * MICROS_PER_HOUR))
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    since = micros_between(epoch, ts)
    return F.floor(since / F.lit(float(width)))
