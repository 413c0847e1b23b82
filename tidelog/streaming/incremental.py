"""Structured Streaming forms of ingest, merge, bounded deduplication and statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from tidelog.operators.dedup import with_hash
from tidelog.sources.files import ACCEPTED_GLOB, text_rows
from tidelog.sources.store import merge_batch


def stream_rows(
    spark: SparkSession, directory: str, glob: str = ACCEPTED_GLOB, max_files: int | None = None
) -> DataFrame:
    """Rows of text files as they arrive.

    A file arrives in one micro-batch, so `tidelog.sources.files.number_rows` turns each
    micro-batch into numbered lines (pass it to `merge_stream` as part of `to_records`).
    """
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return text_rows(reader, directory, glob)


def stream_table(
    spark: SparkSession, directory: str, schema: StructType, glob: str, max_files: int | None = None
) -> DataFrame:
    """New Parquet files of one table."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(directory)


def append_stream(frame: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process everything that is there, append it as Parquet exactly once, and stop."""
    return (
        frame.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def merge_stream(
    stream: DataFrame, root: str, run: str, checkpoint: str, to_records: Callable[[DataFrame], DataFrame] | None = None
) -> StreamingQuery:
    """Exact deduplication of a stream against the stored table, one partition per micro-batch.

    A micro-batch that is replayed after a failure overwrites its own partition.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        merge_batch(to_records(batch) if to_records else batch, root, run, batch_id, small=True)

    return (
        stream.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def dedup_bounded(records: DataFrame, event_time: str = "event_time", delay: str = "1 hour") -> DataFrame:
    """Deduplicate by hash with state that is dropped once the watermark has passed a record."""
    return with_hash(records).withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["log_hash"])


def stream_counts(
    records: DataFrame, event_time: str = "event_time", delay: str = "1 hour", window: str = "1 hour"
) -> DataFrame:
    """Records per level, service and time window; windows are emitted once the watermark closes them."""
    return (
        records.withWatermark(event_time, delay)
        .groupBy(F.window(event_time, window), "level", "service")
        .agg(F.count("*").alias("n"))
        .select(
            F.date_format("window.start", "yyyy-MM-dd'T'HH:mm:ss").alias("window_start"), "level", "service", "n"
        )
    )
