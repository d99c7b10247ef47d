"""The list and struct namespaces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def lengths(c: Column) -> Column:
    return F.when(c.isNotNull(), F.size(c))


def _present(c: Column) -> Column:
    return F.filter(c, lambda x: x.isNotNull())


def sum_(c: Column) -> Column:
    """Double; null for a list without values."""
    own = _present(c)
    return F.when(F.size(own) > 0, F.aggregate(own, F.lit(0.0), lambda a, x: a + x.cast("double")))


def mean(c: Column) -> Column:
    return sum_(c) / F.nullif(F.size(_present(c)), F.lit(0))


def min_(c: Column) -> Column:
    return F.array_min(c)


def max_(c: Column) -> Column:
    return F.array_max(c)


def get(c: Column, i: int) -> Column:
    """0-based, negative from the end, null out of range."""
    return F.get(c, F.lit(i)) if i >= 0 else F.try_element_at(c, F.lit(i))


def contains(c: Column, value) -> Column:
    return F.exists(c, lambda x: x.eqNullSafe(F.lit(value)))


def join(c: Column, sep: str) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), sep)


def unique(c: Column) -> Column:
    return F.array_distinct(c)


def sort(c: Column, descending: bool = False) -> Column:
    return F.sort_array(c, not descending)


def reverse(c: Column) -> Column:
    return F.reverse(c)


def eval_(c: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(c, f)


def arg_min(c: Column) -> Column:
    return F.nullif(F.array_position(c, F.array_min(c)), F.lit(0)) - 1


def arg_max(c: Column) -> Column:
    return F.nullif(F.array_position(c, F.array_max(c)), F.lit(0)) - 1


def diff(c: Column, n: int = 1) -> Column:
    return F.transform(c, lambda x, i: (x - F.get(c, i - n)).cast("double"))


def shift(c: Column, n: int = 1) -> Column:
    return F.transform(c, lambda x, i: F.get(c, i - n))


def slice_(c: Column, offset: int, length: int) -> Column:
    if offset >= 0:
        return F.slice(c, F.lit(offset + 1), F.lit(length))
    start = F.greatest(F.size(c) + offset, F.lit(0)) + 1
    return F.slice(c, start, F.greatest(F.least(F.lit(length), F.size(c) - start + 1), F.lit(0)))


def fixed_width(c: Column, width: int) -> Column:
    """The list, or an error where it has not that width."""
    return F.when(c.isNull() | (F.size(c) == width), c).otherwise(F.raise_error(F.lit(f"a list is not {width} wide")))


def field(c: Column, name: str) -> Column:
    return c.getField(name)


def rename_fields(c: Column, old: list[str], new: list[str]) -> Column:
    return F.when(c.isNotNull(), F.struct(*(c.getField(a).alias(b) for a, b in zip(old, new, strict=True))))


def with_fields(c: Column, **fields: Column) -> Column:
    for k, v in fields.items():
        c = c.withField(k, v)
    return c


def struct_json(c: Column) -> Column:
    return F.to_json(c, {"ignoreNullFields": "false"})
