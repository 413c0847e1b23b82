"""Streaming runs over the test tables; each processes what is there and stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import clean
from tidelog.operators.chunking import chunk_budget
from tidelog.operators.dedup import dedup_first_wins, with_hash
from tidelog.operators.validate import valid_records
from tidelog.plans.adapters import DOCLINES, HASHED, as_event_records, document_lines, event_records, table
from tidelog.plans.cleaning_queries import _TEXT_SQL, messy_text_lines
from tidelog.plans.registry import query
from tidelog.schema import LOG_FIELDS
from tidelog.sources.files import number_rows
from tidelog.sources.scratch import scratch_path
from tidelog.sources.store import merge_batch, read_store
from tidelog.streaming import incremental as I
from tidelog.streaming.keyed import merge_keyed_stream


def _event_stream(spark: SparkSession, directory: str) -> DataFrame:
    schema = table(spark, directory, "events").schema
    return I.stream_table(spark, directory, schema, "events.parquet")


def _with_log_fields(records: DataFrame) -> DataFrame:
    typed = records.withColumn("user_id", F.col("user_id").cast("string"))
    return typed.withColumns({name: F.lit(None).cast("string") for name in ("request_id", "source_ip")})


@query("stream_ingest", f"WITH {DOCLINES} SELECT line, count(*) AS n FROM doclines GROUP BY line")
def stream_ingest(spark: SparkSession, directory: str) -> DataFrame:
    """Document lines arrive as text files, one file per micro-batch, and are appended to a table."""
    source, target = scratch_path(spark, "arriving"), scratch_path(spark, "ingested")
    document_lines(spark, directory).select("line").write.text(source)
    rows = I.stream_rows(spark, source, max_files=2)
    I.append_stream(rows.select("file", F.col("value").alias("line")), target, scratch_path(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(target).groupBy("line").agg(F.count("*").alias("n"))


@query("stream_merge", f'WITH {HASHED} SELECT log_hash, "timestamp", level, message, service, chunk_id, pos FROM survivors')
def stream_merge(spark: SparkSession, directory: str) -> DataFrame:
    root = scratch_path(spark, "stream-store")
    records = _with_log_fields(valid_records(as_event_records(_event_stream(spark, directory))))
    I.merge_stream(records, root, "stream", scratch_path(spark, "checkpoint")).awaitTermination()
    return read_store(spark, root).select("log_hash", "timestamp", "level", "message", "service", "chunk_id", "pos")


@query("stream_merge_keyed", f'WITH {HASHED} SELECT log_hash, "timestamp", level, message, service, chunk_id, pos FROM survivors WHERE event_id % 5 > 0')
def stream_merge_keyed(spark: SparkSession, directory: str) -> DataFrame:
    """The stream's new records; a fifth of the survivors is in the store before, and is its initial state."""
    root = scratch_path(spark, "keyed-store")
    before = dedup_first_wins(with_hash(valid_records(event_records(spark, directory)))).where("event_id % 5 = 0")
    merge_batch(_with_log_fields(before), root, "before", 0)
    records = _with_log_fields(valid_records(as_event_records(_event_stream(spark, directory))))
    merge_keyed_stream(records, root, "stream", scratch_path(spark, "checkpoint")).awaitTermination()
    stored = read_store(spark, root).where("run = 'stream'")
    return stored.select("log_hash", "timestamp", "level", "message", "service", "chunk_id", "pos")


@query(
    "stream_clean_merge",
    f"""WITH {_TEXT_SQL} SELECT DISTINCT "timestamp", level, message, service FROM parsed WHERE layout IS NOT NULL""",
)
def stream_clean_merge(spark: SparkSession, directory: str) -> DataFrame:
    """Text files arrive, are numbered, chunked, cleaned and merged into the stored table."""
    source, root = scratch_path(spark, "arriving"), scratch_path(spark, "stream-store")
    (
        messy_text_lines(spark, directory)
        .repartitionByRange("line_no")
        .sortWithinPartitions("line_no")
        .select("line")
        .write.text(source)
    )

    def to_records(batch: DataFrame) -> DataFrame:
        lines = number_rows(batch).withColumn("type", F.lit("text"))
        records = clean.good(clean.clean_lines(chunk_budget(lines, 50_000), default_year=2024))
        unique = clean.dedup_by_type(records)
        return unique.select("file", "chunk_id", F.col("line_no").alias("pos"), *LOG_FIELDS, F.col("raw").alias("raw_data"))

    # A micro-batch reads a file or more per core, so that none is idle, and the store is scanned less often.
    rows = I.stream_rows(spark, source, max_files=max(4, spark.sparkContext.defaultParallelism))
    I.merge_stream(rows, root, "stream", scratch_path(spark, "checkpoint"), to_records).awaitTermination()
    return read_store(spark, root).select("timestamp", "level", "message", "service")


@query("stream_dedup_bounded", f'WITH {HASHED} SELECT DISTINCT log_hash, "timestamp", level, message, service FROM hashed')
def stream_dedup_bounded(spark: SparkSession, directory: str) -> DataFrame:
    """Equal records lie within one hour here, so bounded state gives the exact answer."""
    target = scratch_path(spark, "bounded")
    records = valid_records(as_event_records(_event_stream(spark, directory))).withColumn("event_time", F.col("ts").cast("timestamp"))
    unique = I.dedup_bounded(records, delay="2 hours").select("log_hash", "timestamp", "level", "message", "service")
    I.append_stream(unique, target, scratch_path(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(target)


@query(
    "stream_stats",
    f"""WITH {HASHED} SELECT "timestamp" AS window_start, level, service, count(*) AS n FROM hashed
WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM hashed) GROUP BY ALL""",
)
def stream_stats(spark: SparkSession, directory: str) -> DataFrame:
    """Hourly counts; windows the watermark has not passed stay open and are not emitted."""
    target = scratch_path(spark, "windows")
    records = valid_records(as_event_records(_event_stream(spark, directory))).withColumn("event_time", F.col("ts").cast("timestamp"))
    counts = I.stream_counts(records)
    I.append_stream(counts, target, scratch_path(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(target)
