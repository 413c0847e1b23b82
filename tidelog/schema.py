"""Record shapes shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

# The fields every stored record must have, the optional ones, and the accepted levels.
REQUIRED_FIELDS = ("timestamp", "level", "message")
OPTIONAL_FIELDS = ("service", "user_id", "request_id", "source_ip")
VALID_LEVELS = ("ERROR", "WARN", "INFO", "DEBUG", "TRACE", "FATAL")
HASH_FIELDS = ("timestamp", "level", "message", "service")

LOG_FIELDS = REQUIRED_FIELDS + OPTIONAL_FIELDS

LINEAGE = ("file", "chunk_id", "pos")

RECORD_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in LOG_FIELDS])

# What a chunk function returns: the standard fields as text, and the whole record as JSON.
MAPPED_RECORD_SCHEMA = T.StructType([*RECORD_SCHEMA.fields, T.StructField("raw_data", T.StringType())])

CHUNK_RESULT_SCHEMA = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("chunk_id", T.LongType()),
        T.StructField("cleaned", T.ArrayType(MAPPED_RECORD_SCHEMA)),
        T.StructField("original_line_count", T.LongType()),
        T.StructField("cleaned_line_count", T.LongType()),
        T.StructField("processing_time_seconds", T.DoubleType()),
        T.StructField("tokens_used", T.LongType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("error", T.StringType()),
    ]
)

# `run` and `batch_id` are the partition columns of the stored table.
STORE_SCHEMA = T.StructType(
    [
        T.StructField("log_hash", T.StringType(), False),
        T.StructField("timestamp", T.StringType(), False),
        T.StructField("level", T.StringType(), False),
        T.StructField("message", T.StringType(), False),
        T.StructField("service", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("request_id", T.StringType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("raw_data", T.StringType()),
        T.StructField("created_at", T.StringType(), False),
        T.StructField("file", T.StringType()),
        T.StructField("chunk_id", T.LongType()),
        T.StructField("pos", T.LongType()),
        T.StructField("run", T.StringType()),
        T.StructField("batch_id", T.LongType()),
    ]
)
