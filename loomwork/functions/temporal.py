"""The date and time namespace, on dates and timestamps without zone."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed lengths of duration units in microseconds (a month has 30 days, a year 365).
UNITS = {"ns": 0.001, "us": 1, "ms": 1000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000, "w": 604_800_000_000, "mo": 2_592_000_000_000, "M": 2_592_000_000_000, "y": 31_536_000_000_000}


def micros(duration: str | int) -> int:
    """"1d2h30m" in microseconds; a number is itself; a leading minus negates."""
    if isinstance(duration, int):
        return duration
    if re.fullmatch(r"-?\d+", duration):
        return int(duration)
    body = duration.removeprefix("-")
    if not re.fullmatch(r"(?:\d+(?:ns|us|ms|mo|[smhdwMy]))+", body):
        raise ValueError(f"no duration: {duration!r}")
    total = sum(int(n) * UNITS[u] for n, u in re.findall(r"(\d+)(ns|us|ms|mo|[smhdwMy])", body))
    return int(-total if duration.startswith("-") else total)


def unix_micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def from_micros(c: Column) -> Column:
    return F.timestamp_micros(c).cast("timestamp_ntz")


def year(c):
    return F.year(c)


def month(c):
    return F.month(c)


def day(c):
    return F.day(c)


def hour(c):
    return F.hour(c)


def minute(c):
    return F.minute(c)


def second(c):
    return F.second(c)


def nanosecond(c: Column) -> Column:
    return F.pmod(unix_micros(c), F.lit(1_000_000)) * 1000


def weekday(c: Column) -> Column:
    """1 is Monday."""
    return F.weekday(c) + 1


def quarter(c):
    return F.quarter(c)


def ordinal_day(c):
    return F.dayofyear(c)


def offset_by(c: Column, duration: str) -> Column:
    return from_micros(unix_micros(c) + micros(duration))


def truncate(c: Column, every: str) -> Column:
    return from_micros(F.floor(unix_micros(c) / micros(every)).cast("long") * micros(every))


def round_(c: Column, every: str) -> Column:
    n = micros(every)
    return from_micros(F.floor((unix_micros(c) + n // 2) / n).cast("long") * n)


def epoch(c: Column, unit: str = "s") -> Column:
    us = unix_micros(c)
    return {"ns": us * 1000, "us": us, "ms": F.floor(us / 1000), "s": F.floor(us / 1_000_000), "d": F.floor(us / 86_400_000_000)}[unit].cast("long")


def timestamp(c: Column, unit: str = "ns") -> Column:
    return epoch(c, unit)


def cast_time_unit(c: Column, unit: str) -> Column:
    return truncate(c, f"1{unit}") if unit in ("ms", "s") else c


def month_start(c: Column) -> Column:
    return F.trunc(c, "MM")


def month_end(c: Column) -> Column:
    return F.last_day(c)


def convert_time_zone(c: Column, target: str, source: str = "UTC") -> Column:
    return F.convert_timezone(F.lit(source), F.lit(target), c)


def subtract(a: Column, b: Column) -> Column:
    return a - b


def interval_micros(c: Column) -> Column:
    """A day-time interval in microseconds."""
    days = F.extract(F.lit("DAY"), c).cast("long")
    hours, minutes = F.extract(F.lit("HOUR"), c).cast("long"), F.extract(F.lit("MINUTE"), c).cast("long")
    return ((days * 24 + hours) * 60 + minutes) * 60_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")


def subtract_duration(c: Column, duration: str) -> Column:
    return from_micros(unix_micros(c) - micros(duration))


def total(a: Column, b: Column, unit: str) -> Column:
    """a - b in days, hours or seconds."""
    return (unix_micros(a) - unix_micros(b)) / {"days": 86_400_000_000.0, "hours": 3_600_000_000.0, "seconds": 1_000_000.0}[unit]
