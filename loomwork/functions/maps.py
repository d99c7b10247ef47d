"""Maps: keys, values, look-ups and changes of entries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_lists(keys: Column, values: Column) -> Column:
    return F.map_from_arrays(keys, values)


def keys(c: Column) -> Column:
    return F.map_keys(c)


def values(c: Column) -> Column:
    return F.map_values(c)


def get(c: Column, key) -> Column:
    """Null for a key that is not there."""
    return F.try_element_at(c, key if isinstance(key, Column) else F.lit(key))


def contains(c: Column, key) -> Column:
    return F.map_contains_key(c, key)


def lengths(c: Column) -> Column:
    return F.when(c.isNotNull(), F.size(c)).cast("long")


def merge(first: Column, second: Column) -> Column:
    """Entries of both; the second's values win."""
    kept = F.map_filter(first, lambda k, _: ~F.array_contains(F.map_keys(second), k))
    return F.map_concat(kept, second)


def map_values(c: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform_values(c, lambda _, v: f(v))


def filter_(c: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.map_filter(c, f)


def entries(c: Column) -> Column:
    """A list of (key, value), in order of keys."""
    return F.sort_array(F.map_entries(c))
