"""Incremental ingestion with Structured Streaming: files or rows in, scanned, deduplicated, written once.

``availableNow`` drains what is there and stops, so a batch schedule and a stream run the same code. Micro-batch
writes are keyed by batch id, so a repeated batch rewrites its own folder and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_rows(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def deduplicated(rows: DataFrame, key: str, time: str | None = None, delay: str = "1 day") -> DataFrame:
    """First row of each key: all history, or within a watermark where state must stay bounded."""
    if time is None:
        return rows.dropDuplicates([key])
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def drain(rows: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """Run everything available through ``each`` and stop."""
    rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def to_folders(root: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    return write


def windowed_counts(events: DataFrame, time: str, kind: str, size: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts and sums of event windows, late rows within ``delay``; works on batches and streams."""
    given = events.withWatermark(time, delay) if events.isStreaming else events
    w = F.window(time, size, slide) if slide else F.window(time, size)
    out = given.groupBy(w.alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), kind, "n", "total")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes") -> DataFrame:
    given = events.withWatermark(time, gap) if events.isStreaming else events
    out = given.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("session_start"), "n")
