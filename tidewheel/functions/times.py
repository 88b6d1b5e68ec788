"""Times are integer nanoseconds since the epoch, durations integer nanoseconds."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000_000
DAY = 86_400 * SECOND


def duration(value: int | timedelta, least: int = 1) -> int:
    """Nanoseconds of a duration; ``least`` is 0 where an operator allows none."""
    ns = value if isinstance(value, int) else (value.days * 86_400 + value.seconds) * SECOND + value.microseconds * 1000
    if ns < least:
        raise ValueError("the duration must be positive" if least else "the duration must not be negative")
    return ns


def nanos(ts: Column) -> Column:
    """Nanoseconds of a TIMESTAMP_NTZ column, whatever the session's time zone."""
    return (F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts) * 1000).cast("bigint")


def floored(t: Column, size: int, start: int = 0) -> Column:
    """The last of start, start + size and so on, and before it, that is not after t; in integers, exact at any time."""
    return t - F.pmod(t - F.lit(start).cast("bigint"), F.lit(size).cast("bigint"))


def display(t: Column) -> Column:
    """Seconds with nine digits after the point; before the epoch the fraction still counts upwards."""
    rest = F.pmod(t, F.lit(SECOND).cast("bigint"))
    return F.concat(F.call_function("div", t - rest, F.lit(SECOND).cast("bigint")).cast("string"), F.lit("."), F.lpad(rest.cast("string"), 9, "0"))
