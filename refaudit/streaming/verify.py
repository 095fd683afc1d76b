"""Incremental verification: new entries stream in, each micro-batch is verified on its own.

Entries are deduplicated by key within the watermark, so that a redelivered entry is verified once.
The sources are best given prepared (``Engine.prepare``, written as tables): a batch then reads their
indexes and adapts nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from refaudit.plans.engine import Engine


def dedup(stream: DataFrame, key: str = "key", at: str = "arrived_at", delay: str = "7 days") -> DataFrame:
    """The first delivery of each key within ``delay``; state older than that is dropped."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def verify_stream(stream: DataFrame, engine: Engine, tables: Callable[[], dict[str, DataFrame]], out: str, checkpoint: str, once: bool = False, at: str | None = None) -> StreamingQuery:
    """Verify a stream of entries and append the results to ``out``, exactly once per batch: each
    batch writes its own folder, and writing it again replaces it. ``at`` names the time of arrival by
    which redelivered entries are dropped; without it every row is verified."""

    def batch(df: DataFrame, number: int) -> None:
        engine.verify(df, tables()).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = (dedup(stream, at=at) if at else stream).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def status_counts(results: DataFrame, at: str = "ts", window: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Counts of statuses in tumbling windows of a result stream."""
    return results.withWatermark(at, delay).groupBy(F.window(at, window), "status").agg(F.count("*").alias("n")).select("window.start", "status", "n")
