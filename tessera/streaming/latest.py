"""Streaming twins of batch operators: latest row by key, windowed counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.dedup import latest_wins


def latest_stream(events: DataFrame, keys: Sequence[str], time: str, tie: str) -> DataFrame:
    """The newest row of each key of a stream, as an aggregation in update or complete mode; the batch twin is latest_wins."""
    return latest_wins(events, keys, [time], tie)


def windowed_counts(events: DataFrame, time: str, keys: Sequence[str], late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Rows and sums a window and key; windows close once the watermark passes them."""
    stamped = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return stamped.groupBy(F.window("_t", width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("start"), *keys, "n", "total"
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write all available input as Parquet, exactly once, and stop."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
