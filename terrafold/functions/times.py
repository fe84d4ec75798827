"""Time functions. The present is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAIVE = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(\.\d{1,9})?$"


def naive(x: Column) -> Column:
    """A time as text with a space or T and an optional fraction; else null."""
    return F.when(x.rlike(NAIVE), x.try_cast("timestamp_ntz"))


def expired(expiration: Column, now: Column) -> Column:
    """What cannot be read never expires."""
    return F.coalesce(expiration < now, F.lit(False))


def plus_minutes(start: Column, minutes: Column) -> Column:
    return start + F.make_dt_interval(mins=minutes.cast("int"))


def older_than(x: Column, now: Column, minutes: int) -> Column:
    return F.coalesce(plus_minutes(x, F.lit(minutes)) < now, F.lit(False))


def local_text(utc: Column, zone: str) -> Column:
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), utc), "yyyy/MM/dd HH:mm:ss")


def date_part(x: Column) -> Column:
    return F.split(x, "T")[0]
