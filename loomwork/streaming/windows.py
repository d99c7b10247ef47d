"""The same windowed aggregations over batch and Structured Streaming frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def event_time(df: DataFrame, column: str, late: str = "1 hour") -> DataFrame:
    """Watermarks need a timestamp with zone, so the column is cast; a batch frame gets the cast alone."""
    out = df.withColumn(column, F.col(column).cast("timestamp"))
    return out.withWatermark(column, late) if df.isStreaming else out


def tumbling(df: DataFrame, column: str, every: str, by: list[str], aggs: dict[str, Column], slide: str | None = None) -> DataFrame:
    """Windows of length every, one after the other or each `slide`; window_start, by and the aggregates."""
    w = F.window(column, every, slide) if slide else F.window(column, every)
    out = df.groupBy(w.alias("w"), *by).agg(*(v.alias(k) for k, v in aggs.items()))
    return out.select(F.col("w.start").alias("window_start"), *by, *aggs)


def sessions(df: DataFrame, column: str, gap: str, by: list[str], aggs: dict[str, Column]) -> DataFrame:
    out = df.groupBy(F.session_window(column, gap).alias("w"), *by).agg(*(v.alias(k) for k, v in aggs.items()))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, *aggs)


def deduplicated(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def run_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there now into Parquet at `path`; in complete mode a batch replaces the last one. A batch run again writes the same part."""

    def put(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={k}")

    df.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    return out.select(*df.columns)


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "append"):
    """Runs a stream over what is there now into a memory table; waits for the end."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
