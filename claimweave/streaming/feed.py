"""Assertions as a stream: an extra of this engine.

Deduplication by fingerprint within a watermark, and windowed counts; both keep bounded state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """Events of the parquet files that come into a folder, as a stream with event time ``at``."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(folder).withColumn("at", F.col("ts").cast("timestamp"))


def fresh(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each key once, as far as the watermark remembers."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(keys)


def windowed(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums per window and type, emitted when the watermark has passed the window."""
    counted = events.withWatermark("at", late).groupBy(F.window("at", width), "event_type")
    return counted.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


def run_available(out: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write what is there to parquet, exactly once, and stop."""
    query = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
