"""Log-shaped views of the test tables, each as a DataFrame and as SQL for the comparison engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.schema import VALID_LEVELS
from tidelog.sources.files import explode_lines


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def spread(frame: DataFrame) -> DataFrame:
    """The rows dealt to all cores where a small table has fewer splits: rules that are dear per row are then not the work of
    one task. Tables of more splits stay as they are read."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame


# --- events as cleaned records ------------------------------------------------------------------
#
# Deliberately messy: mixed-case levels, an invalid level, missing services, many repeats. A chunk
# is 500 consecutive events.

EVENTS_PER_CHUNK = 500

ELOG = """elog AS (
  SELECT event_id, event_id AS pos, 'events' AS file, event_id // 500 AS chunk_id, ts, user_id, event_type, value,
         strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%S') AS "timestamp",
         CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'info' WHEN 'view' THEN 'DEBUG'
                         WHEN 'signup' THEN 'WARN' ELSE 'NOTICE' END AS level,
         event_type || ' user ' || CAST(user_id % 20 AS VARCHAR) AS message,
         CASE WHEN user_id % 7 = 0 THEN NULL ELSE 'svc-' || CAST(user_id % 7 AS VARCHAR) END AS service
  FROM events)"""

# Records that pass validation, with their hash and their rank among equal hashes.
HASHED = (
    ELOG
    + """, hashed AS (
  SELECT *, md5(concat_ws('|', "timestamp", level, message, coalesce(service, 'None'))) AS log_hash
  FROM elog WHERE upper(level) IN ('ERROR', 'WARN', 'INFO', 'DEBUG', 'TRACE', 'FATAL')),
ranked AS (SELECT *, row_number() OVER (PARTITION BY log_hash ORDER BY file, chunk_id, pos) AS rn FROM hashed),
survivors AS (SELECT * FROM ranked WHERE rn = 1)"""
)


def event_records(spark: SparkSession, directory: str) -> DataFrame:
    return as_event_records(table(spark, directory, "events"))


def as_event_records(events: DataFrame) -> DataFrame:
    """The log view of event rows, batch or streaming."""
    user = F.col("user_id")
    kind = F.col("event_type")
    return events.select(
        "event_id",
        F.col("event_id").alias("pos"),
        F.lit("events").alias("file"),
        F.expr(f"event_id div {EVENTS_PER_CHUNK}").alias("chunk_id"),
        "ts",
        "user_id",
        "event_type",
        "value",
        F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.when(kind == "error", "ERROR")
        .when(kind == "click", "info")
        .when(kind == "view", "DEBUG")
        .when(kind == "signup", "WARN")
        .otherwise("NOTICE")
        .alias("level"),
        F.concat(kind, F.lit(" user "), (user % 20).cast("string")).alias("message"),
        F.when(user % 7 != 0, F.concat(F.lit("svc-"), (user % 7).cast("string"))).alias("service"),
    )


# --- chunk results derived from events ------------------------------------------------------------
#
# Chunks whose number ends in 3 count as failed; seconds are exact sums of cents.

RESULTS = """results AS (
  SELECT file, chunk_id, CAST(count(*) AS BIGINT) AS original_line_count,
         CAST(CASE WHEN chunk_id % 10 = 3 THEN 0 ELSE count(*) FILTER (upper(level) IN
           ('ERROR', 'WARN', 'INFO', 'DEBUG', 'TRACE', 'FATAL')) END AS BIGINT) AS cleaned_line_count,
         CAST(CASE WHEN chunk_id % 10 = 3 THEN 0 ELSE sum(length(message)) END AS BIGINT) AS tokens_used,
         CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) / 100.0::DOUBLE AS processing_time_seconds,
         chunk_id % 10 <> 3 AS success,
         CASE WHEN chunk_id % 10 = 3 THEN 'chunk ' || CAST(chunk_id AS VARCHAR) || ' failed' END AS error
  FROM elog GROUP BY file, chunk_id)"""


def chunk_results(records: DataFrame) -> DataFrame:
    ok = F.col("chunk_id") % 10 != 3
    return (
        records.groupBy("file", "chunk_id")
        .agg(
            F.count("*").alias("original_line_count"),
            F.count_if(F.upper("level").isin(*VALID_LEVELS)).alias("_valid"),
            F.sum(F.length("message")).alias("_tokens"),
            F.sum(F.round(F.col("value") * 100).cast("long")).alias("_cents"),
        )
        .select(
            "file",
            "chunk_id",
            "original_line_count",
            F.when(ok, F.col("_valid")).otherwise(0).alias("cleaned_line_count"),
            F.when(ok, F.col("_tokens")).otherwise(0).alias("tokens_used"),
            (F.col("_cents") / F.lit(100.0)).alias("processing_time_seconds"),
            ok.alias("success"),
            F.when(~ok, F.concat(F.lit("chunk "), F.col("chunk_id").cast("string"), F.lit(" failed"))).alias("error"),
        )
    )


# --- documents as files ---------------------------------------------------------------------------

DOCFILES = """docfiles AS (
  SELECT doc_id, 'docs/' || CAST(doc_id AS VARCHAR) AS path,
         CASE WHEN doc_id % 97 = 0 THEN '' ELSE 'doc-' || CAST(doc_id AS VARCHAR) ||
           CASE doc_id % 5 WHEN 0 THEN '.jsonl' WHEN 1 THEN '.JSON' WHEN 2 THEN '.log' WHEN 3 THEN '.txt' ELSE '' END
         END AS original_name,
         CAST(strlen(text) AS BIGINT) AS size_bytes,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds((doc_id * 37) % 86400) AS upload_time, text
  FROM documents)"""


def document_files(spark: SparkSession, directory: str) -> DataFrame:
    doc = F.col("doc_id")
    suffix = (
        F.when(doc % 5 == 0, ".jsonl").when(doc % 5 == 1, ".JSON").when(doc % 5 == 2, ".log").when(doc % 5 == 3, ".txt").otherwise("")
    )
    return table(spark, directory, "documents").select(
        "doc_id",
        F.concat(F.lit("docs/"), doc.cast("string")).alias("path"),
        F.when(doc % 97 == 0, "").otherwise(F.concat(F.lit("doc-"), doc.cast("string"), suffix)).alias("original_name"),
        F.octet_length("text").cast("long").alias("size_bytes"),
        F.timestamp_seconds(F.lit(1704067200) + (doc * 37) % 86400).alias("upload_time"),
        "text",
    )


# Lines of a document: a trailing newline ends the last line and does not begin another.
DOCLINES = """parts AS (
  SELECT doc_id, text, unnest(string_split(rtrim_nl, chr(10))) AS line,
         generate_subscripts(string_split(rtrim_nl, chr(10)), 1) AS line_no,
         len(string_split(rtrim_nl, chr(10))) AS n_lines
  FROM (SELECT doc_id, text, CASE WHEN text LIKE '%' || chr(10) THEN left(text, length(text) - 1) ELSE text END AS rtrim_nl
        FROM documents WHERE length(text) > 0)),
doclines AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS file, line_no, line,
         CAST(strlen(line) + CASE WHEN line_no = n_lines AND text NOT LIKE '%' || chr(10) THEN 0 ELSE 1 END AS BIGINT) AS n_bytes
  FROM parts)"""


def document_lines(spark: SparkSession, directory: str) -> DataFrame:
    return explode_lines(table(spark, directory, "documents"), "doc_id", "text")


# --- documents of one source as one long file -----------------------------------------------------
#
# A source may hold a third of all documents. Lines are ordered by document and line; a block is
# a run of 64 document ids.

DOCS_PER_BLOCK = 64

SOURCELINES = (
    DOCLINES
    + """, sourcelines AS (
  SELECT d.source AS file, l.doc_id, l.line_no AS doc_line, l.line, CAST(strlen(l.line) + 1 AS BIGINT) AS n_bytes,
         row_number() OVER (PARTITION BY d.source ORDER BY l.doc_id, l.line_no) AS line_no
  FROM doclines l JOIN documents d USING (doc_id))"""
)


def source_lines(spark: SparkSession, directory: str) -> DataFrame:
    """Line frame with one file per document source; numbered without a window over a whole source.

    Lines are counted per document before they are exploded, so documents move once.
    """
    text = F.col("text")
    ended = F.endswith("text", F.lit("\n"))
    n_lines = F.length("text") - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + F.when(ended, 0).otherwise(1)
    n_bytes = F.octet_length("text") + F.when(ended, 0).otherwise(1)
    docs = (
        table(spark, directory, "documents")
        .filter(F.length("text") > 0)
        .select(
            "doc_id", "source", F.expr(f"doc_id div {DOCS_PER_BLOCK}").alias("run_of_docs"), "text",
            n_lines.cast("long").alias("_n"), n_bytes.cast("long").alias("_b"),
        )
    )
    runs = docs.groupBy("source", "run_of_docs").agg(F.sum("_n").alias("_n"), F.sum("_b").alias("_b"))
    earlier = Window.partitionBy("source").orderBy("run_of_docs").rowsBetween(Window.unboundedPreceding, -1)
    before = runs.select(
        "source",
        "run_of_docs",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("lines_before"),
        F.coalesce(F.sum("_b").over(earlier), F.lit(0)).alias("bytes_before"),
        F.count("*").over(Window.partitionBy("source")).alias("runs"),
    )
    inside = Window.partitionBy("source", "run_of_docs").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.withColumn("_lines_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(before, ["source", "run_of_docs"])
    lines = explode_lines(
        placed, "doc_id", "text", keep=("source", "run_of_docs", "_lines_in", "lines_before", "bytes_before", "runs")
    )
    return lines.select(
        F.col("source").alias("file"),
        F.col("run_of_docs").alias("block"),
        F.col("bytes_before").alias("block_off"),
        F.col("runs").alias("blocks"),
        (F.col("lines_before") + F.col("_lines_in") + F.col("line_no")).alias("line_no"),
        "line",
        (F.octet_length("line") + 1).cast("long").alias("n_bytes"),
        F.col("file").cast("long").alias("doc_id"),
        F.col("line_no").alias("doc_line"),
    )
