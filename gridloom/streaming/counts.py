"""Tumbling windows over streams of rows, and the same plan over a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _counted(df: DataFrame, time: str, length: str, keys: Sequence[str], value: str) -> DataFrame:
    grouped = df.groupBy(F.window(F.col(time).cast("timestamp"), length).alias("w"), *keys)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("value"))


def tumbling_counts(stream: DataFrame, time: str, length: str, keys: Sequence[str], value: str, late: str = "10 minutes") -> DataFrame:
    """Rows and the sum of ``value`` for each window and key; rows later than ``late`` are dropped, closed windows are emitted once."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return _counted(timed, time, length, keys, value)


def tumbling_counts_batch(df: DataFrame, time: str, length: str, keys: Sequence[str], value: str) -> DataFrame:
    return _counted(df, time, length, keys, value).select(F.col("w.start").cast("timestamp_ntz").alias("start"), *keys, "n", "value")


def to_memory(df: DataFrame, name: str, mode: str = "append") -> StreamingQuery:
    return df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
