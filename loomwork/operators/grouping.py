"""Grouping: aggregates by name, dynamic and rolling windows over an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.temporal import from_micros, micros, unix_micros
from .frame import free


def first(c: str, order_by: list[str]) -> Column:
    """First value that is not null."""
    return F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*order_by)))


def last(c: str, order_by: list[str]) -> Column:
    return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*order_by)))


def n_unique(c: str) -> Column:
    """A null counts as a value."""
    return F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))


def implode(c: str, order_by: list[str]) -> Column:
    return F.transform(F.sort_array(F.collect_list(F.struct(*order_by, F.col(c).alias("__value")))), lambda x: x["__value"])


def arg_min(c: str, index: str) -> Column:
    return F.min_by(F.col(index), F.when(F.col(c).isNotNull(), F.struct(F.col(c), F.col(index))))


def arg_max(c: str, index: str) -> Column:
    return F.max_by(F.col(index), F.when(F.col(c).isNotNull(), F.struct(F.col(c), -F.col(index))))


BY_NAME = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "mean": F.avg, "avg": F.avg, "std": F.stddev_samp, "var": F.var_samp, "median": F.median, "null_count": lambda c: F.count_if(F.col(c).isNull()), "nunique": n_unique, "approx_nunique": F.approx_count_distinct}


def agg(df: DataFrame, by: list[str], *pairs: tuple[str, str]) -> DataFrame:
    """("column", "aggregate") pairs, named column_aggregate."""
    return df.groupBy(*by).agg(*(BY_NAME[f](c).alias(f"{c}_{f}") for c, f in pairs))


def quantile(c: str, q: float, accuracy: int | None = None) -> Column:
    """Exact, linear between the two nearest, from a buffer of a group's distinct values; with an accuracy a sketch of bounded memory (rank error 1 / accuracy)."""
    return F.percentile_approx(c, q, accuracy).cast("double") if accuracy else F.percentile(c, q)


def agg_groups(df: DataFrame, by: list[str], index: str) -> DataFrame:
    return df.groupBy(*by).agg(F.sort_array(F.collect_list(index)).alias("groups"))


def _index(df: DataFrame, index: str) -> tuple[Column, bool]:
    time = dict(df.dtypes)[index] in ("timestamp", "timestamp_ntz", "date")
    return (unix_micros(F.col(index)) if time else F.col(index)), time


def dynamic(df: DataFrame, index: str, every, aggs: list[Column], period=None, offset=0, closed: str = "left", by: list[str] = (), label: str | None = None, start_by: str = "window") -> DataFrame:
    """Windows that start every `every`, `period` long, shifted by offset; closed left, right, both or none. Windows without rows are left out; the label is the window's start.

    start_by "window" counts from the epoch or zero, "datapoint" from the smallest index of the frame (a pass of its own).

    A row is put in each window it belongs to (period / every, rounded up, plus one), then it is a plain two-phase aggregation.
    """
    e, p, o = micros(every), micros(period if period is not None else every), micros(offset)
    x, time = _index(df, index)
    if start_by == "datapoint":
        o += int(df.agg(F.min(x).cast("long").alias("least")).first().least or 0)
    elif start_by != "window":
        raise ValueError(f"start_by is window or datapoint, not {start_by!r}")
    x, at = x - o, free("__start", df)
    low = F.floor((x - p) / e).cast("long")
    starts = F.transform(F.sequence(F.lit(0), F.lit(p // e + 1)), lambda k: (low + k) * e)
    after = {"left": lambda s: (x >= s) & (x < s + p), "right": lambda s: (x > s) & (x <= s + p), "both": lambda s: (x >= s) & (x <= s + p), "none": lambda s: (x > s) & (x < s + p)}[closed]
    own = df.withColumn(at, F.explode(F.filter(starts, after)))
    start = from_micros(F.col(at) + o) if time else F.col(at) + o
    return own.groupBy(*by, start.alias(label or index)).agg(*aggs)


def rolling(df: DataFrame, index: str, period, aggs: dict[str, Column], closed: str = "right", by: list[str] = (), offset=None) -> DataFrame:
    """One window per row: (t + offset, t + offset + period], offset -period unless given; closed moves the bounds."""
    p = micros(period)
    o = micros(offset) if offset is not None else -p
    x, _ = _index(df, index)
    low = o + (0 if closed in ("left", "both") else 1)
    high = o + p - (0 if closed in ("right", "both") else 1)
    at = free("__x", df)
    w = Window.partitionBy(*by).orderBy(at).rangeBetween(low, high)
    return df.withColumn(at, x.cast("long")).withColumns({k: v.over(w) for k, v in aggs.items()}).drop(at)
