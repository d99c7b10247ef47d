"""Positional operators over a whole, unpartitioned order without a single-task window.

The order is cut at sampled sort keys, found once and held as literals, so every pass deals rows alike. All keys of the order
count, so a value of the first key that many rows share is cut by the others. Within a range windows run in parallel; a table
with one row per range carries what comes before it. The number of ranges follows the input's size.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frame import free, order

#: Bytes of a range, the least and the most ranges, and sampled keys of a range.
RANGE_BYTES, LEAST, MOST, SAMPLED = 128 << 20, 8, 1024, 64
NESTED, SEED = 15, 17


def _keys(df: DataFrame, order_by: list[str]) -> list[Column]:
    """Keys as values that a literal can hold: times as microseconds."""
    kinds = dict(df.dtypes)
    return [F.unix_micros(F.col(c).cast("timestamp")) if kinds[c] in ("timestamp", "timestamp_ntz", "date") else F.col(c) for c in order_by]


def range_count(df: DataFrame) -> int:
    """By the planner's estimate of the input's bytes."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(LEAST, min(MOST, size // RANGE_BYTES))


def ranged(df: DataFrame, order_by: list[str], name: str, ranges: int | None = None) -> DataFrame:
    """df with the number of each row's range; nulls come first, rows of equal keys stay together."""
    ranges = ranges or range_count(df)
    keys = df.select(*(k.alias(f"k{i}") for i, k in enumerate(_keys(df, order_by))))
    drawn = sorted_keys(keys.orderBy(F.rand(SEED)).limit(SAMPLED * ranges))
    cuts = list(dict.fromkeys(tuple(drawn[len(drawn) * k // ranges]) for k in range(1, ranges))) if drawn else []
    kinds = [f.dataType for f in keys.schema]
    x = [F.col(f"{name}_{i}") for i in range(len(kinds))]
    literal = lambda row: [F.lit(v).cast(t) for v, t in zip(row, kinds)]
    with_keys = df.withColumns({f"{name}_{i}": k for i, k in enumerate(_keys(df, order_by))})
    number = _search(x, cuts, literal)
    return with_keys.withColumn(name, number).drop(*(f"{name}_{i}" for i in range(len(kinds))))


def _after(x: list[Column], cut: tuple, literals: list[Column]) -> Column:
    """Whether keys come after a cut, nulls first; key by key, so that most rows are told by the first."""
    out = F.lit(False)
    for k, v, c in zip(reversed(x), reversed(cut), reversed(literals)):
        if v is None:
            out = k.isNotNull() | out
        else:
            out = F.coalesce((k > c) | ((k == c) & out), F.lit(False))
    return out


def _search(x: list[Column], cuts: list[tuple], literal: Callable) -> Column:
    """How many cuts keys come after: a binary search, of few cuts as nested conditions in generated code, of many in two levels of arrays, so the expression stays small."""
    if len(cuts) > NESTED:
        step = math.isqrt(len(cuts)) + 1
        row = lambda v: F.struct(*(c.alias(f"k{i}") for i, c in enumerate(v)))
        below = lambda at: F.size(F.filter(at, lambda c: c < row(x)))
        parts = [cuts[k : k + step] for k in range(0, len(cuts), step)]
        first = below(F.array(*(row(literal(p[-1])) for p in parts)))
        inner = F.array(*(F.array(*(row(literal(c)) for c in p)) for p in parts))
        return first * step + F.coalesce(below(F.get(inner, first)), F.lit(0))

    def within(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(_after(x, cuts[mid], literal(cuts[mid])), within(mid + 1, high)).otherwise(within(low, mid))

    return within(0, len(cuts))


def sorted_keys(sample: DataFrame) -> list[tuple]:
    """A bounded sample's rows in Spark's order."""
    return [tuple(r) for r in sample.orderBy(*order(sample.columns)).collect()]


@dataclass
class Running:
    """A running value: `local` within a range, `total` of a range, `carry` of the totals before it, and how to combine both."""

    name: str
    local: Callable[[Window], Column]
    total: Column
    carry: Callable[[str, Window], Column]
    combine: Callable[[Column, Column], Column]


def scan(df: DataFrame, order_by: list[str], *values: Running) -> DataFrame:
    """All running values in one pass over one dealing; columns of their names are replaced."""
    part = free("__range", df)
    own = ranged(df, order_by, part)
    names = [(free(f"__total{i}", df), free(f"__before{i}", df), free(f"__local{i}", df)) for i in range(len(values))]
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = own.groupBy(part).agg(*(v.total.alias(t) for v, (t, _, _) in zip(values, names)))
    totals = totals.select(part, *(v.carry(t, before).alias(b) for v, (t, b, _) in zip(values, names)))
    w = Window.partitionBy(part).orderBy(*order(order_by))
    # One row a range, MOST at most.
    out = own.withColumns({n: v.local(w) for v, (_, _, n) in zip(values, names)}).join(F.broadcast(totals), part, "left")
    return out.withColumns({v.name: v.combine(F.col(n), F.col(b)) for v, (_, b, n) in zip(values, names)}).drop(part, *(x for t in names for x in t))


_SO_FAR = (Window.unboundedPreceding, 0)


def index_value(name: str) -> Running:
    return Running(name, lambda w: F.row_number().over(w) - 1, F.count(F.lit(1)), lambda t, w: F.sum(t).over(w), lambda a, b: (a + F.coalesce(b, F.lit(0))).cast("long"))


def sum_value(column: str, name: str) -> Running:
    """Null where the value is."""
    return Running(name, lambda w: F.sum(column).over(w.rowsBetween(*_SO_FAR)), F.sum(column), lambda t, w: F.sum(t).over(w), lambda a, b: F.when(F.col(column).isNotNull(), F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))))


def max_value(column: str, name: str) -> Running:
    return Running(name, lambda w: F.max(column).over(w.rowsBetween(*_SO_FAR)), F.max(column), lambda t, w: F.max(t).over(w), lambda a, b: F.when(F.col(column).isNotNull(), F.greatest(a, b)))


def min_value(column: str, name: str) -> Running:
    return Running(name, lambda w: F.min(column).over(w.rowsBetween(*_SO_FAR)), F.min(column), lambda t, w: F.min(t).over(w), lambda a, b: F.when(F.col(column).isNotNull(), F.least(a, b)))


def row_index(df: DataFrame, order_by: list[str], name: str = "index") -> DataFrame:
    """0-based position in the order, first column; a column of that name is replaced, after the order is taken from it."""
    out = scan(df, order_by, index_value(own := free("__index", df))).drop(name)
    return out.select(F.col(own).alias(name), *(c for c in out.columns if c != own))


def cum_sum(df: DataFrame, column: str, order_by: list[str], name: str) -> DataFrame:
    return scan(df, order_by, sum_value(column, name))


def cum_max(df: DataFrame, column: str, order_by: list[str], name: str) -> DataFrame:
    return scan(df, order_by, max_value(column, name))


def fill_forward(df: DataFrame, column: str, order_by: list[str], name: str) -> DataFrame:
    """The last value before; leading nulls stay."""
    latest = F.max_by(F.col(column), F.when(F.col(column).isNotNull(), F.struct(*order_by)))
    return scan(df, order_by, Running(name, lambda w: F.last(column, True).over(w.rowsBetween(*_SO_FAR)), latest, lambda t, w: F.last(t, True).over(w), F.coalesce))


def shift_columns(df: DataFrame, n: int, columns: list[str], order_by: list[str]) -> DataFrame:
    """Columns moved n rows on (back, if negative); rows without such a neighbour get null. Positions are joined, so no task holds the order."""
    at = free("__at", df)
    own = row_index(df, order_by, at)
    back = own.select((F.col(at) + n).alias(at), *(F.col(c).alias(f"{at}_{i}") for i, c in enumerate(columns)))
    moved = {c: F.col(f"{at}_{i}").alias(c) for i, c in enumerate(columns)}
    return own.join(back, at, "left").select(*(moved.get(c, F.col(c)) for c in df.columns))


def gather_every(df: DataFrame, n: int, offset: int, order_by: list[str]) -> DataFrame:
    at = free("__at", df)
    return row_index(df, order_by, at).where((F.col(at) >= offset) & ((F.col(at) - offset) % n == 0)).drop(at)


def quantiles(df: DataFrame, column: str, qs: list[float]) -> list[float | None]:
    """Exact quantiles of the values that are not null, linear between the two nearest: two positions each of a distributed order, no buffer of all values."""
    own = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))
    n = own.count()
    if not n:
        return [None] * len(qs)
    spots = [(n - 1) * q for q in qs]
    wanted = sorted({int(s) for s in spots} | {min(n - 1, int(s) + 1) for s in spots})
    found = {r.i: r.x for r in row_index(own, ["x"], "i").where(F.col("i").isin(wanted)).collect()}
    return [found[int(s)] + (s - int(s)) * (found[min(n - 1, int(s) + 1)] - found[int(s)]) if s > int(s) else found[int(s)] for s in spots]
