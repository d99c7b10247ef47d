"""Histogram, kernel density, entropy, value counts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def entropy(df: DataFrame, column: str) -> DataFrame:
    """Shannon entropy of value frequencies, natural log."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total, weighted = F.sum("n"), F.sum(F.col("n") * F.ln("n"))
    return counts.agg((F.ln(total) - weighted / total).alias("entropy"))


def hist(df: DataFrame, column: str, bins: int) -> DataFrame:
    """bin_start, bin_end, count: equal widths, the last bin closed, empty bins kept; a constant column has one bin of width 1. Nulls, NaN and infinities are in no bin."""
    x = F.col(column).cast("double")
    own = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))).select(x.alias("x"))
    ends = own.agg(F.min("x").alias("low"), F.max("x").alias("high"))
    ends = ends.select(F.when(F.col("low") == F.col("high"), F.col("low") - 0.5).otherwise(F.col("low")).alias("low"), F.when(F.col("low") == F.col("high"), F.col("high") + 0.5).otherwise(F.col("high")).alias("high"), F.when(F.col("low") == F.col("high"), 1).otherwise(bins).alias("bins"))
    ends = ends.withColumn("width", (F.col("high") - F.col("low")) / F.col("bins"))
    put = own.join(F.broadcast(ends)).select(F.least(F.floor((F.col("x") - F.col("low")) / F.col("width")), F.col("bins") - 1).cast("int").alias("bin"))
    counts = put.groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    every = ends.where("low is not null").select("*", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    return every.join(counts, "bin", "left").select((F.col("low") + F.col("bin") * F.col("width")).alias("bin_start"), (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("bin_end"), F.coalesce("count", F.lit(0).cast("long")).alias("count"))


def kde(df: DataFrame, column: str, bandwidth: float, points: int = 100) -> DataFrame:
    """grid, density: Gaussian, on [min - 3h, max + 3h], of finite values. Equal values are counted first; the grid is a small constant array, so rows are never paired with rows."""
    x = F.col(column).cast("double")
    own = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))).groupBy(x.alias("x")).agg(F.count(F.lit(1)).alias("n"))
    ends = own.agg((F.min("x") - 3 * bandwidth).alias("low"), (F.max("x") + 3 * bandwidth).alias("high"), F.sum("n").alias("total"))
    grid = ends.where("low is not null").select("total", F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.col("low") + k * (F.col("high") - F.col("low")) / max(1, points - 1))).alias("grid"))
    near = own.join(F.broadcast(grid))
    weight = F.col("n") * F.exp(-0.5 * F.pow((F.col("grid") - F.col("x")) / bandwidth, 2))
    return near.groupBy("grid").agg((F.sum(weight) / (F.first("total") * bandwidth * math.sqrt(2 * math.pi))).alias("density"))
