"""Event-time windows, deduplication, ingest and bounded buffers with Structured Streaming.

Driver tables have times without zone; watermarks need a zoned type, so times are cast in the
session's zone (UTC) and cast back in results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATE = "10 minutes"


def zoned(events: DataFrame, time: str = "ts") -> DataFrame:
    return events.withColumn(time, F.col(time).cast("timestamp"))


def counted(events: DataFrame, size: str, slide: str | None = None, time: str = "ts") -> DataFrame:
    """start, event_type, n, total of tumbling or sliding windows, for batches and streams."""
    df = zoned(events, time)
    if events.isStreaming:
        df = df.withWatermark(time, LATE)
    window = F.window(time, size, slide) if slide else F.window(time, size)
    out = df.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", key: str = "user_id", time: str = "ts") -> DataFrame:
    """key, start, stop, n of runs of events with no longer gap between them."""
    df = zoned(events, time)
    if events.isStreaming:
        df = df.withWatermark(time, LATE)
    out = df.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("stop"), "n")


def unique(events: DataFrame, keys: list[str], time: str = "ts") -> DataFrame:
    """Each key's first event, as long as repeats come within the watermark; batches drop all repeats."""
    df = zoned(events, time)
    return df.withWatermark(time, LATE).dropDuplicatesWithinWatermark(keys) if events.isStreaming else df.dropDuplicates(keys)


def run(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """All there is, in one go, each batch handed to `sink` exactly once per checkpoint."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ring_buffer(events: DataFrame, most: int, key: str = "event_type", order: str = "event_id") -> DataFrame:
    """key, kept, dropped after each batch of a stream: a buffer of the latest `most` records per key, held as state."""

    def step(name: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept, dropped = list(state.get[0]) if state.exists else [], state.get[1] if state.exists else 0
        for pdf in batches:
            both = sorted(kept + pdf[order].tolist())
            dropped += max(0, len(both) - most)
            kept = both[-most:]
        state.update((kept, dropped))
        yield pd.DataFrame({key: [name[0]], "kept": [len(kept)], "dropped": [dropped]})

    return events.groupBy(key).applyInPandasWithState(step, f"{key} string, kept int, dropped long", "kept array<long>, dropped long", "update", "NoTimeout")


def ingest(spark: SparkSession, folder: str, schema: str, table, planner: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str) -> None:
    """Files dropped into a folder, planned against a registry table and merged into it batch by batch."""

    def merge(batch: DataFrame, number: int) -> None:
        new = planner(batch, table.read())
        if not new.isEmpty():
            table.upsert(new, ["source"])

    run(spark.readStream.schema(schema).parquet(folder), merge, checkpoint)
