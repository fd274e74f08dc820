"""Instants without a zone: arithmetic that no session time zone can change."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from start to end, negative if end is earlier."""
    return F.floor(micros_between(start, end) / 1_000_000).cast("long")


def micros_between(start: Column, end: Column) -> Column:
    gap = end - start
    days, hours, minutes = (F.extract(F.lit(p), gap).cast("long") for p in ("DAY", "HOUR", "MINUTE"))
    return (days * 86_400 + hours * 3_600 + minutes * 60) * 1_000_000 + F.round(F.extract(F.lit("SECOND"), gap) * 1_000_000).cast("long")


def epoch_seconds(ts: Column) -> Column:
    return seconds_between(F.expr(EPOCH), ts)


def floor_hour(ts: Column) -> Column:
    return ts - F.make_dt_interval(F.lit(0), F.lit(0), F.minute(ts), F.extract(F.lit("SECOND"), ts))


def floor_day(ts: Column) -> Column:
    return ts - F.make_dt_interval(F.lit(0), F.hour(ts), F.minute(ts), F.extract(F.lit("SECOND"), ts))


def hours(n: Column | int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(n) if isinstance(n, int) else n)


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")
