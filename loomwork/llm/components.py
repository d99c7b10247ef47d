"""Connected components of a link table by alternating large-star and small-star steps, all in joins and combinable aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, written


def _large(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()


def connected(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links(u, v) of long ids -> (node, root): every node that has a link, with the smallest node id it can reach.

    Each round shortens paths at least by half, no step gathers a node's neighbours, and each round's table is written to the
    shared folder. Self links and nulls are dropped; no links give an empty table.
    """
    spark = links.sparkSession
    e = written(links.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").distinct(), "links")
    before = None
    for _ in range(max_rounds):
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before or state[0] == 0:
            break
        before = tuple(state)
        after = written(_small(_large(e)), "links")
        removed(spark, e)
        e = after
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
