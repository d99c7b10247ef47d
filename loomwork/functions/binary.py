"""The binary namespace."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lengths(c: Column) -> Column:
    return F.octet_length(c)


def contains(c: Column, value: bytes) -> Column:
    return F.contains(c, F.lit(bytearray(value)))


def starts_with(c: Column, value: bytes) -> Column:
    return F.startswith(c, F.lit(bytearray(value)))


def ends_with(c: Column, value: bytes) -> Column:
    return F.endswith(c, F.lit(bytearray(value)))


def encode(c: Column, kind: str) -> Column:
    return {"hex": lambda: F.lower(F.hex(c)), "base64": lambda: F.base64(c), "utf-8": lambda: c.cast("binary")}[kind]()


def decode(c: Column, kind: str) -> Column:
    return {"hex": lambda: F.unhex(c), "base64": lambda: F.unbase64(c), "utf-8": lambda: F.decode(c, "UTF-8")}[kind]()
