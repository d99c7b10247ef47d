"""Values of a fixed list of categories as codes, categories by first appearance, and times of day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECOND = 1_000_000_000
DAY = 86_400 * SECOND


def enum_cast(c: Column, categories: list[str]) -> Column:
    """The value if it is one of the categories, else null."""
    return F.when(c.isin(list(categories)), c)


def enum_code(c: Column, categories: list[str]) -> Column:
    """0-based place in the categories, null for any other value; codes order as the categories do."""
    at = F.array_position(F.array(*map(F.lit, categories)), c)
    return F.when(at > 0, at - 1).cast("int")


def enum_value(code: Column, categories: list[str]) -> Column:
    return F.when(code >= 0, F.get(F.array(*map(F.lit, categories)), code.cast("int")))


def categorical(df: DataFrame, column: str, order_by: list[str], name: str) -> DataFrame:
    """A code for each value by first appearance in the order; null stays null. The distinct values are numbered in parallel ranges and joined back."""
    from ..operators.ranges import row_index

    firsts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("__value")).agg(F.min(F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(order_by)))).alias("k"))
    codes = row_index(firsts.select("__value", "k.*"), [f"k{i}" for i in range(len(order_by))], "__code").select("__value", F.col("__code").alias(name))
    return df.drop(name).join(codes, F.col(column) == F.col("__value"), "left").drop("__value")


def time_of_day(c: Column) -> Column:
    """Nanoseconds since midnight of a timestamp."""
    t = c.cast("timestamp_ntz")
    return (F.unix_micros(t.cast("timestamp")) - F.unix_micros(F.date_trunc("day", t).cast("timestamp"))) * 1000


def make_time(hour: Column, minute: Column, second: Column) -> Column:
    return ((hour * 60 + minute) * 60 + second).cast("long") * SECOND


def time_hour(c: Column) -> Column:
    return (F.floor(c / (3600 * SECOND)) % 24).cast("int")


def time_minute(c: Column) -> Column:
    return (F.floor(c / (60 * SECOND)) % 60).cast("int")


def time_second(c: Column) -> Column:
    return (F.floor(c / SECOND) % 60).cast("int")


def add_to_time(c: Column, nanos: Column) -> Column:
    """Around the clock."""
    return F.pmod(c + nanos, F.lit(DAY))
