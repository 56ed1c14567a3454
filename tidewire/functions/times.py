"""Time buckets, ranges and quiet hours."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HHMM = r"^(?:[01][0-9]|2[0-3]):[0-5][0-9]$"


def instant(value: datetime | str | Column) -> Column:
    """A literal instant; naive values are session time (UTC)."""
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast("timestamp")


def epoch(ts: Column | str) -> Column:
    """Whole seconds since 1970."""
    return F.unix_seconds(F.col(ts) if isinstance(ts, str) else ts)


def bucket_start(ts: Column | str, seconds: int) -> Column:
    e = epoch(ts)
    return F.timestamp_seconds(e - F.pmod(e, F.lit(seconds)))


def in_range(
    df: DataFrame,
    start: datetime | str | Column,
    end: datetime | str | Column,
    ts: str = "bucket_ts",
    date: str = "bucket_date",
) -> DataFrame:
    """Rows of a time range, inclusive on both ends.

    The date column gets its own predicate, so a table partitioned by date
    reads only the partitions in range.
    """
    low, high = instant(start), instant(end)
    condition = F.col(ts).between(low, high)
    if date in df.columns:
        condition = condition & F.col(date).between(low.cast("date"), high.cast("date"))
    return df.filter(condition)


def minute_of_day(hhmm: Column) -> Column:
    return F.get(F.split(hhmm, ":"), F.lit(0)).try_cast("int") * 60 + F.get(
        F.split(hhmm, ":"), F.lit(1)
    ).try_cast("int")


def in_quiet_hours(ts: Column, start: Column, end: Column) -> Column:
    """Inclusive minutes, wrapping midnight; blank bounds are never quiet."""
    low, high = minute_of_day(start), minute_of_day(end)
    now = F.hour(ts) * 60 + F.minute(ts)
    wrapped = F.when(low <= high, now.between(low, high)).otherwise((now >= low) | (now <= high))
    usable = (F.size(F.split(start, ":")) == 2) & (F.size(F.split(end, ":")) == 2)
    return F.coalesce(usable & wrapped, F.lit(False))
