"""Deterministic cleaning of parsed lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions import fields as R
from tidelog.operators.ordering import last_known
from tidelog.operators.parse import parse_lines
from tidelog.operators.validate import record_problem
from tidelog.schema import LOG_FIELDS


def normalize(records: DataFrame, default_level: str | None = None, default_year: int | Column | None = None) -> DataFrame:
    """ISO UTC timestamps, canonical levels, collapsed messages, a service on every record."""
    level = R.normalize_level(F.col("level"))
    return (
        records.withColumn("timestamp", R.normalize_timestamp(F.col("timestamp"), default_year))
        .withColumn("level", F.coalesce(level, F.lit(default_level)) if default_level else level)
        .withColumn("message", R.clean_message(F.col("message")))
        .withColumn("service", F.coalesce(R.blank_to_null(F.col("service")), F.lit("unknown")))
        .withColumn("user_id", R.blank_to_null(F.col("user_id")))
        .withColumn("request_id", R.blank_to_null(F.col("request_id")))
        .withColumn("source_ip", R.blank_to_null(F.col("source_ip")))
    )


def infer_timestamps(
    records: DataFrame, group: Sequence[str] = ("file",), block: str = "block", order: Sequence[str] = ("line_no",)
) -> DataFrame:
    """Missing timestamps take the last known one before them in file order, and `time_inferred` says so.

    Where the records have `time_given`, a time that was given but fits no form is not missing: it stays NULL.
    """
    known = last_known(records, list(group), block, list(order), "timestamp", "_known")
    missing = F.col("timestamp").isNull()
    if "time_given" in records.columns:
        missing = missing & ~F.col("time_given")
    known = known.withColumn("time_inferred", missing & F.col("_known").isNotNull())
    return known.withColumn("timestamp", F.when(F.col("time_inferred"), F.col("_known")).otherwise(F.col("timestamp"))).drop("_known")


def dedup_in_chunk(records: DataFrame, keys: Sequence[str], order: Sequence[str] = ("pos",)) -> DataFrame:
    """First record of each key inside its chunk."""
    first = Window.partitionBy("file", "chunk_id", *keys).orderBy(*order)
    return records.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")


def dedup_structured(records: DataFrame, order: Sequence[str] = ("pos",)) -> DataFrame:
    return dedup_in_chunk(records, ("timestamp", "message"), order)


def dedup_text(records: DataFrame, order: Sequence[str] = ("pos",)) -> DataFrame:
    return dedup_in_chunk(records, LOG_FIELDS, order)


def clean_lines(
    lines: DataFrame, infer_time: bool = True, default_level: str | None = "INFO", default_year: int | Column | None = None
) -> DataFrame:
    """Lines with chunk ids and a `type` -> records with `reject_reason` (NULL for good ones).

    Column rules, and for missing timestamps the last known one in file order (flagged `time_inferred`). Syslog
    times carry no year: it is `default_year`, else that of a `file_time` column of the lines. Times that are given
    but fit no form are rejected, never replaced.
    """
    if default_year is None and "file_time" in lines.columns:
        default_year = F.year("file_time")
    parsed = parse_lines(lines).withColumn("time_given", F.coalesce(R.blank_to_null(F.col("timestamp")).isNotNull(), F.lit(False)))
    records = normalize(parsed, default_level, default_year)
    unread = F.col("time_given") & F.col("timestamp").isNull()
    if infer_time:
        records = infer_timestamps(records)
    reason = (
        F.when(F.col("layout").isNull(), F.lit("malformed"))
        .when(unread, F.lit("unreadable timestamp"))
        .otherwise(record_problem())
    )
    return records.withColumn("reject_reason", reason).drop("time_given")


def good(records: DataFrame) -> DataFrame:
    return records.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def dedup_by_type(records: DataFrame) -> DataFrame:
    """In-chunk deduplication: time and message for JSON records, every field for text records.

    The two rules share one window: text records add the other fields to the key.
    """
    extra = [
        F.when(F.col("type") == "text", F.col(name)) for name in LOG_FIELDS if name not in ("timestamp", "message")
    ]
    first = Window.partitionBy("file", "chunk_id", "timestamp", "message", *extra).orderBy("line_no")
    return records.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")


def emit_json(records: DataFrame, fields: Sequence[str] = LOG_FIELDS) -> DataFrame:
    """Adds `raw_data`: the record as a JSON object, NULL members included."""
    return records.withColumn(
        "raw_data", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    )
