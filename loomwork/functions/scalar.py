"""Arithmetic, conditionals and mathematics with the missing-value and IEEE rules of a DataFrame library."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def true_div(a: Column, b: Column) -> Column:
    """Double division; by zero gives an infinity or NaN, not an error."""
    a, b = a.cast("double"), b.cast("double")
    zero = F.when(a > 0, INF).when(a < 0, -INF).otherwise(NAN)
    return F.when(b == 0, F.when(a.isNotNull(), zero)).otherwise(a / b)


def floor_div(a: Column, b: Column) -> Column:
    return F.when(b != 0, F.floor(a / b))


def cast(c: Column, kind: str, strict: bool = False) -> Column:
    """Null where a value can't be cast, an error if strict."""
    return c.cast(kind) if strict else c.try_cast(kind)


def clip(c: Column, low=None, high=None) -> Column:
    """Within the bounds; null and NaN stay."""
    out = c
    if low is not None:
        out = F.when(out < low, F.lit(low)).otherwise(out)
    if high is not None:  # NaN is above all numbers in comparisons
        out = F.when((out > high) & ~out.cast("double").isNaN(), F.lit(high)).otherwise(out)
    return out


def sqrt(c: Column) -> Column:
    return F.sqrt(c.cast("double"))


def _log(f, c: Column) -> Column:
    c = c.cast("double")
    return F.when(c > 0, f(c)).when(c == 0, -INF).when(c.isNotNull(), NAN)


def log(c: Column) -> Column:
    return _log(F.ln, c)


def log10(c: Column) -> Column:
    return _log(F.log10, c)


def floor(c: Column) -> Column:
    return F.floor(c).cast("double")


def ceil(c: Column) -> Column:
    return F.ceil(c).cast("double")


def round_even(c: Column, decimals: int = 0) -> Column:
    return F.bround(c, decimals)


def fill_null(c: Column, value) -> Column:
    return F.coalesce(c, value if isinstance(value, Column) else F.lit(value))


def fill_nan(c: Column, value) -> Column:
    return F.when(F.isnan(c), F.lit(value)).otherwise(c)


def is_in(c: Column, values) -> Column:
    return c.isin(list(values))


def when_then(condition: Column, then, otherwise) -> Column:
    return F.when(condition, then).otherwise(otherwise)
