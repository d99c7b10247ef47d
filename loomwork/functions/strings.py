"""The string namespace."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_lengths(c: Column) -> Column:
    return F.octet_length(c)


def contains(c: Column, literal: str) -> Column:
    return F.contains(c, F.lit(literal))


def starts_with(c: Column, literal: str) -> Column:
    return F.startswith(c, F.lit(literal))


def ends_with(c: Column, literal: str) -> Column:
    return F.endswith(c, F.lit(literal))


def regex_match(c: Column, pattern: str) -> Column:
    return c.rlike(pattern)


def upper(c: Column) -> Column:
    return F.upper(c)


def lower(c: Column) -> Column:
    return F.lower(c)


def title(c: Column) -> Column:
    return F.initcap(c)


def replace(c: Column, old: str, new: str) -> Column:
    """The first literal occurrence."""
    at = F.instr(c, old)
    return F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), F.lit(new), F.substring(c, at + len(old), F.length(c)))).otherwise(c)


def replace_all(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def strip_start(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+", "")


def strip_end(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def strip(c: Column) -> Column:
    return strip_end(strip_start(c))


def split(c: Column, sep: str) -> Column:
    return F.split(c, re.escape(sep), -1)


def slice_(c: Column, start: int, length: int | None = None) -> Column:
    """0-based; a negative start counts from the end."""
    return F.substring(c, F.lit(start + 1 if start >= 0 else start), F.lit(length) if length is not None else F.length(c))


def head(c: Column, n: int) -> Column:
    return F.left(c, F.lit(n))


def tail(c: Column, n: int) -> Column:
    return F.right(c, F.lit(n))


def pad_start(c: Column, width: int, ch: str = " ") -> Column:
    """Never truncates."""
    return F.lpad(c, F.greatest(F.lit(width), F.length(c)), F.lit(ch))


def pad_end(c: Column, width: int, ch: str = " ") -> Column:
    return F.rpad(c, F.greatest(F.lit(width), F.length(c)), F.lit(ch))


def extract(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract(c, pattern, group)


def extract_all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def reverse(c: Column) -> Column:
    return F.reverse(c)


def to_date(c: Column, fmt: str = "yyyy-MM-dd") -> Column:
    return F.try_to_timestamp(c, F.lit(fmt)).cast("date")


def to_datetime(c: Column, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.try_to_timestamp(c, F.lit(fmt)).cast("timestamp_ntz")


def json_decode(c: Column, schema: str) -> Column:
    return F.from_json(c, schema)


def json_schema(df, name: str) -> str:
    """The DDL of the union of keys in a column of JSON texts, inferred in one distributed pass."""
    return df.select(F.schema_of_variant_agg(F.try_parse_json(F.col(name))).alias("s")).first().s.replace("OBJECT<", "STRUCT<")


def json_encode(c: Column) -> Column:
    """A string as a JSON literal; null stays null."""
    whole = F.to_json(F.struct(c.alias("v")))
    return F.when(c.isNotNull(), F.substring(whole, F.lit(6), F.length(whole) - 6))
