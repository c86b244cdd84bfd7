"""Column functions on time. "Now" is always a parameter, so that results can be repeated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ago(now: Column, **parts: int) -> Column:
    return now - F.make_dt_interval(*[F.lit(parts.get(k, 0)) for k in ("days", "hours", "minutes", "seconds")])


def elapsed_seconds(start: Column, end: Column) -> Column:
    return F.timestamp_diff("SECOND", start, end)


def whole_minutes(seconds: Column) -> Column:
    return F.floor(seconds / 60).cast("long")


def is_future(at: Column, now: Column) -> Column:
    return F.coalesce(at > now, F.lit(False))


def iso(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssxxx")


def day_first(at: Column) -> Column:
    return F.date_format(at, "dd.MM.yyyy HH:mm")


def keep_first(old: Column, new: Column) -> Column:
    return F.coalesce(old, new)


def milliseconds(nanoseconds: Column) -> Column:
    return F.round(nanoseconds / 1_000_000).cast("long")
