"""Field rules, parsing, validation and cleaning over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import fields as R
from tidelog.functions.json_values import entry_problem, field, parse_json, truthy
from tidelog.operators import clean, validate
from tidelog.operators.chunking import chunk_budget
from tidelog.operators.ordering import last_known
from tidelog.operators.parse import parse_lines
from tidelog.plans.adapters import ELOG, as_event_records, event_records, spread, table
from tidelog.plans.registry import query

_VALID = "upper(level) IN ('ERROR', 'WARN', 'INFO', 'DEBUG', 'TRACE', 'FATAL')"
_ISO_SQL = "strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S.000000Z')"
_SECOND = "yyyy-MM-dd'T'HH:mm:ss"


def _seconds(column: str = "ts") -> Column:
    return F.date_trunc("second", column)


def _spelled(number: Column, second: Column) -> Column:
    """One instant in eight spellings, and a few that are no time at all."""
    epoch = F.unix_seconds(second.cast("timestamp"))
    return (
        F.when(number % 9 == 0, F.date_format(second, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(number % 9 == 1, F.date_format(second, "yyyy-MM-dd HH:mm:ss,'000'"))
        .when(number % 9 == 2, F.date_format(second + F.expr("interval 2 hours"), "yyyy-MM-dd'T'HH:mm:ss'+02:00'"))
        .when(number % 9 == 3, F.date_format(second, "dd/MMM/yyyy:HH:mm:ss +0000"))
        .when(number % 9 == 4, epoch.cast("string"))
        .when(number % 9 == 5, F.concat(epoch.cast("string"), F.lit("000")))
        .when(number % 9 == 6, F.concat(F.lit("  "), F.date_format(second, "yyyy-MM-dd HH:mm:ss"), F.lit(" ")))
        .when(number % 9 == 7, F.date_format(second - F.expr("interval 5 hours 30 minutes"), "yyyy-MM-dd HH:mm:ss.'000 -0530'"))
        .otherwise(F.concat(F.lit("tomorrow "), F.date_format(second, "HH:mm")))
    )


@query(
    "normalize_timestamp",
    f"SELECT event_id, CASE WHEN event_id % 9 <> 8 THEN {_ISO_SQL} END AS \"timestamp\" FROM events",
)
def normalize_timestamp(spark: SparkSession, directory: str) -> DataFrame:
    events = table(spark, directory, "events")
    return events.select("event_id", R.normalize_timestamp(_spelled(F.col("event_id"), _seconds())).alias("timestamp"))


@query(
    "normalize_timestamp_dates",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT00:00:00.000000Z') AS day, strftime(o_orderdate, '2023-%m-%dT04:05:06.000000Z') AS syslog FROM orders",
)
def normalize_timestamp_dates(spark: SparkSession, directory: str) -> DataFrame:
    """Date-only text, and syslog times that need a year."""
    day = F.col("o_orderdate")
    leap = F.date_format(day, "MM-dd") == "02-29"
    syslog = R.normalize_timestamp(F.date_format(day, "MMM d '04:05:06'"), default_year=2023)
    return table(spark, directory, "orders").select(
        "o_orderkey",
        R.normalize_timestamp(F.date_format(day, "yyyy-MM-dd")).alias("day"),
        F.when(leap, F.lit("2023-02-29T04:05:06.000000Z")).otherwise(syslog).alias("syslog"),
    )


@query(
    "normalize_timestamp_micros",
    """SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') || '.123' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') ||
      CASE WHEN event_id % 4 = 3 THEN '07' || CAST(1 + event_id % 9 AS VARCHAR) ELSE '' END || 'Z' AS "timestamp" FROM events""",
)
def normalize_timestamp_micros(spark: SparkSession, directory: str) -> DataFrame:
    """Times that share a millisecond stay apart, those that share a microsecond too."""
    number = F.col("event_id")
    fraction = F.concat(F.lit("123"), F.lpad((number % 1000).cast("string"), 3, "0"))
    finer = F.when(number % 4 == 3, F.concat(F.lit("07"), (1 + number % 9).cast("string"))).otherwise(F.lit("0"))
    stamp = F.concat(F.date_format(_seconds(), "yyyy-MM-dd HH:mm:ss"), F.lit(","), fraction, finer)
    return table(spark, directory, "events").select("event_id", R.normalize_timestamp(stamp).alias("timestamp"))


@query(
    "infer_timestamp",
    f"""WITH given AS (SELECT source AS file, doc_id, CASE WHEN doc_id % 5 = 0 THEN 'T' || CAST(doc_id AS VARCHAR) END AS stamp FROM documents)
SELECT file, doc_id, last_value(stamp IGNORE NULLS) OVER (PARTITION BY file ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS known FROM given""",
)
def infer_timestamp(spark: SparkSession, directory: str) -> DataFrame:
    """Last known stamp in file order; a source is the file and may be arbitrarily large."""
    doc = F.col("doc_id")
    given = table(spark, directory, "documents").select(
        F.col("source").alias("file"),
        "doc_id",
        F.expr("doc_id div 64").alias("block"),
        F.when(doc % 5 == 0, F.concat(F.lit("T"), doc.cast("string"))).alias("stamp"),
    )
    return last_known(given, ["file"], "block", ["doc_id"], "stamp", "known").select("file", "doc_id", "known")


@query(
    "normalize_level",
    """SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'WARN' WHEN 1 THEN 'ERROR' WHEN 2 THEN 'FATAL' WHEN 3 THEN 'INFO'
      WHEN 4 THEN 'DEBUG' WHEN 5 THEN upper(event_type) WHEN 6 THEN NULL ELSE 'TRACE' END AS level FROM events""",
)
def normalize_level(spark: SparkSession, directory: str) -> DataFrame:
    number = F.col("event_id")
    spelled = (
        F.when(number % 8 == 0, "Warning")
        .when(number % 8 == 1, " err\t")
        .when(number % 8 == 2, "critical")
        .when(number % 8 == 3, "Notice")
        .when(number % 8 == 4, "debug")
        .when(number % 8 == 5, F.col("event_type"))
        .when(number % 8 == 6, "  ")
        .otherwise("Trace")
    )
    return table(spark, directory, "events").select("event_id", R.normalize_level(spelled).alias("level"))


@query(
    "extract_source_ip",
    r"""SELECT doc_id, regexp_extract(text, '(?:^|[^0-9.])((?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]))(?:[^0-9.]|\.[^0-9]|\.$|$)', 1) AS source_ip
FROM documents WHERE regexp_matches(text, '(?:^|[^0-9.])((?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]))(?:[^0-9.]|\.[^0-9]|\.$|$)')""",
)
def extract_source_ip(spark: SparkSession, directory: str) -> DataFrame:
    found = table(spark, directory, "documents").select("doc_id", R.source_ip(F.col("text")).alias("source_ip"))
    return found.filter("source_ip is not null")


@query(
    "infer_service",
    """SELECT page_id, coalesce(CASE WHEN page_id % 4 = 0 THEN 'shop-' || CAST(page_id % 3 AS VARCHAR) END,
      CASE WHEN page_id % 4 = 1 THEN 'auth.' || CAST(page_id % 5 AS VARCHAR) END,
      CASE WHEN page_id % 4 = 2 THEN regexp_extract(url, '^https?://([A-Za-z0-9.-]+)', 1) END, 'unknown') AS service FROM pages""",
)
def infer_service(spark: SparkSession, directory: str) -> DataFrame:
    page = F.col("page_id")
    named = F.when(page % 4 == 0, F.concat(F.lit(" shop-"), (page % 3).cast("string"))).when(page % 4 == 2, F.lit(""))
    context = (
        F.when(page % 4 == 1, F.concat(F.lit("up [auth."), (page % 5).cast("string"), F.lit("] GET "), F.col("url")))
        .when(page % 4 == 2, F.concat(F.lit("GET "), F.col("url")))
        .otherwise(F.lit("no hint [12]"))
    )
    return table(spark, directory, "pages").select("page_id", R.infer_service([named], context).alias("service"))


@query(
    "extract_ids",
    """SELECT event_id, CASE WHEN event_id % 3 <> 2 THEN 'u' || CAST(user_id AS VARCHAR) END AS user_id,
      CASE WHEN event_id % 3 = 0 THEN 'r-' || CAST(event_id AS VARCHAR) END AS request_id FROM events""",
)
def extract_ids(spark: SparkSession, directory: str) -> DataFrame:
    number, user = F.col("event_id"), F.col("user_id").cast("string")
    text = (
        F.when(number % 3 == 0, F.concat(F.lit("done user_id=u"), user, F.lit(", request_id: r-"), number.cast("string"), F.lit(";")))
        .when(number % 3 == 1, F.concat(F.lit('{"uid":"u'), user, F.lit('"} fluid=9')))
        .otherwise(F.lit("superuser=root prereq_id=5"))
    )
    # The JSON text keeps its quotes, so its key is followed by a quote and not found as plain text.
    plain = F.when(number % 3 == 1, F.regexp_replace(text, r'[{}]|"(?=:)|(?<=[{ ])"', "")).otherwise(text)
    return table(spark, directory, "events").select(
        "event_id", R.user_id(plain).alias("user_id"), R.request_id(plain).alias("request_id")
    )


@query(
    "extract_message",
    """SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE event_type || ' by ' || CAST(user_id AS VARCHAR) END AS message FROM events""",
)
def extract_message(spark: SparkSession, directory: str) -> DataFrame:
    number, user = F.col("event_id"), F.col("user_id").cast("string")
    spaced = F.concat(F.lit("  "), F.col("event_type"), F.lit(" \\t by\\n  "), user)
    plain = F.concat(F.col("event_type"), F.lit(" by "), user)
    line = (
        F.when(number % 4 == 0, F.concat(F.lit('{"msg":"'), spaced, F.lit('"}')))
        .when(number % 4 == 1, F.concat(F.lit('{"message":"","event":"'), plain, F.lit('","text":"x"}')))
        .when(number % 4 == 2, F.concat(F.lit('{"message":"'), plain, F.lit('","msg":"other"}')))
        .otherwise(F.lit('{"note":"none"}'))
    )
    doc = table(spark, directory, "events").select("event_id", parse_json(line).alias("doc"))
    return doc.select("event_id", R.clean_message(R.json_field(F.col("doc"), "message")).alias("message"))


def messy_json_lines(spark: SparkSession, directory: str) -> DataFrame:
    """Events as JSON lines under varying member names, with members missing or null."""
    number = F.col("event_id")
    shape = number % 4
    stamp = F.date_format(_seconds(), "yyyy-MM-dd HH:mm:ss")
    user = F.col("user_id").cast("string")
    line = (
        F.when(
            shape == 0,
            F.concat(F.lit('{"timestamp":"'), stamp, F.lit('","level":"warning","message":"'), F.col("event_type"), F.lit('","service":null,"user_id":'), user, F.lit("}")),
        )
        .when(
            shape == 1,
            F.concat(F.lit('{"ts":"'), stamp, F.lit('","severity":"err","msg":" '), F.col("event_type"), F.lit('","app":"svc-'), user, F.lit('","ip":"10.0.0.7"}')),
        )
        .when(shape == 2, F.concat(F.lit('{"time":"'), stamp, F.lit('","event":"'), F.col("event_type"), F.lit('","req_id":"r'), user, F.lit('"}')))
        .otherwise(F.concat(F.lit('{"timestamp":"'), stamp, F.lit('", broken "message":"'), F.col("event_type"), F.lit('"}')))
    )
    return table(spark, directory, "events").select(
        F.lit("events").alias("file"),
        F.expr("event_id div 4096").alias("block"),
        number.alias("line_no"),
        line.alias("line"),
        F.lit("jsonl").alias("type"),
    )


@query(
    "fill_missing_fields",
    f"""SELECT event_id AS line_no, {_ISO_SQL} AS "timestamp",
  CASE event_id % 4 WHEN 0 THEN 'WARN' WHEN 1 THEN 'ERROR' ELSE 'INFO' END AS level, event_type AS message,
  CASE event_id % 4 WHEN 1 THEN 'svc-' || CAST(user_id AS VARCHAR) ELSE 'unknown' END AS service,
  CASE event_id % 4 WHEN 0 THEN CAST(user_id AS VARCHAR) END AS user_id,
  CASE event_id % 4 WHEN 2 THEN 'r' || CAST(user_id AS VARCHAR) END AS request_id,
  CASE event_id % 4 WHEN 1 THEN '10.0.0.7' END AS source_ip
FROM events WHERE event_id % 4 <> 3""",
)
def fill_missing_fields(spark: SparkSession, directory: str) -> DataFrame:
    records = clean.normalize(parse_lines(messy_json_lines(spark, directory)), default_level="INFO")
    return records.filter("layout is not null").select(
        "line_no", "timestamp", "level", "message", "service", "user_id", "request_id", "source_ip"
    )


def messy_text_lines(spark: SparkSession, directory: str) -> DataFrame:
    """Events as text lines in six layouts and one that fits none."""
    number = F.col("event_id")
    shape = number % 7
    second = _seconds()
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    service = F.concat(F.lit("svc-"), (F.col("user_id") % 7).cast("string"))
    line = (
        F.when(shape == 0, F.concat(F.date_format(second, "yyyy-MM-dd'T'HH:mm:ss.'000Z'"), F.lit(" ERROR ["), service, F.lit("] "), kind, F.lit(" failed user_id="), user))
        .when(shape == 1, F.concat(F.lit("["), F.date_format(second, "yyyy-MM-dd HH:mm:ss"), F.lit("] Warning "), service, F.lit(": "), kind, F.lit(" from 10.1.2.3")))
        .when(shape == 2, F.concat(F.lit("<14>"), F.date_format(second, "MMM d HH:mm:ss"), F.lit(" host "), service, F.lit("[99]: "), kind, F.lit(" request_id=r"), user))
        .when(shape == 3, F.concat(F.lit("<11>1 "), F.date_format(second, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" host "), service, F.lit(" 99 id1 - "), kind))
        .when(shape == 4, F.concat(F.lit("10.0.0.9 - u"), user, F.lit(" ["), F.date_format(second, "dd/MMM/yyyy:HH:mm:ss +0000"), F.lit('] "GET /'), kind, F.lit(' HTTP/1.1" 404 17')))
        .when(shape == 5, F.concat(F.lit("ts="), F.date_format(second, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" level=debug service="), service, F.lit(' msg="'), kind, F.lit(' done" uid='), user))
        .otherwise(F.concat(F.lit("    at com.example."), kind, F.lit("(Main.java:1)")))
    )
    return spread(table(spark, directory, "events")).select(
        F.lit("events").alias("file"),
        F.expr("event_id div 4096").alias("block"),
        number.alias("line_no"),
        line.alias("line"),
        (F.octet_length(line) + 1).cast("long").alias("n_bytes"),
        F.lit("text").alias("type"),
    )


def more_text_lines(spark: SparkSession, directory: str) -> DataFrame:
    """Events as lines of frameworks, of syslog files, without a level, with control characters and separators in the message."""
    number = F.col("event_id")
    shape = number % 6
    second = F.date_format(_seconds(), "yyyy-MM-dd HH:mm:ss")
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    line = (
        F.when(shape == 0, F.concat(second, F.lit(",250 [main] WARN com.shop.Cart - "), kind, F.lit(" [x] - "), user))
        .when(shape == 1, F.concat(second, F.lit(",250 - shop.cart - CRITICAL - "), kind, F.lit(" - "), user))
        .when(shape == 2, F.concat(F.date_format(_seconds(), "MMM d HH:mm:ss"), F.lit(" host cron[7]: "), kind, F.lit(": "), user))
        .when(shape == 3, F.concat(second, F.lit("Z Connection closed by "), kind))
        .when(shape == 4, F.concat(second, F.lit("Z INFO [fix] 8=FIX.4.2\x01"), kind, F.lit("\x0110="), user))
        .otherwise(F.concat(second, F.lit("Z error first\u2028"), kind))
    )
    return messy_text_lines(spark, directory).drop("line", "n_bytes").join(
        table(spark, directory, "events").select(number.alias("line_no"), line.alias("line")), "line_no"
    )


@query(
    "parse_text_layouts",
    f"""SELECT event_id AS line_no, CASE event_id % 6 WHEN 0 THEN 'java' WHEN 1 THEN 'python' WHEN 2 THEN 'syslog_file' ELSE 'iso' END AS layout,
  CASE WHEN event_id % 6 < 2 THEN strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S.250000Z') ELSE {_ISO_SQL} END AS "timestamp",
  CASE event_id % 6 WHEN 0 THEN 'WARN' WHEN 1 THEN 'FATAL' WHEN 4 THEN 'INFO' WHEN 5 THEN 'ERROR' END AS level,
  CASE event_id % 6 WHEN 0 THEN event_type || ' [x] - ' || CAST(user_id AS VARCHAR) WHEN 1 THEN event_type || ' - ' || CAST(user_id AS VARCHAR)
    WHEN 2 THEN event_type || ': ' || CAST(user_id AS VARCHAR) WHEN 3 THEN 'Connection closed by ' || event_type
    WHEN 4 THEN '8=FIX.4.2' || chr(1) || event_type || chr(1) || '10=' || CAST(user_id AS VARCHAR) ELSE 'first' || chr(8232) || event_type END AS message,
  CASE event_id % 6 WHEN 0 THEN 'com.shop.Cart' WHEN 1 THEN 'shop.cart' WHEN 2 THEN 'cron' WHEN 4 THEN 'fix' ELSE 'unknown' END AS service FROM events""",
)
def parse_text_layouts(spark: SparkSession, directory: str) -> DataFrame:
    records = clean.normalize(parse_lines(more_text_lines(spark, directory)), default_year=2024)
    return records.select("line_no", "layout", "timestamp", "level", "message", "service")


_TEXT_SQL = f"""parsed AS (SELECT event_id AS line_no, ts,
  CASE event_id % 7 WHEN 0 THEN 'iso' WHEN 1 THEN 'bracket' WHEN 2 THEN 'syslog' WHEN 3 THEN 'syslog5424' WHEN 4 THEN 'access' WHEN 5 THEN 'key_value' END AS layout,
  CASE WHEN event_id % 7 <> 6 THEN {_ISO_SQL} END AS "timestamp",
  CASE event_id % 7 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'WARN' WHEN 2 THEN 'INFO' WHEN 3 THEN 'ERROR' WHEN 4 THEN 'WARN' WHEN 5 THEN 'DEBUG' END AS level,
  CASE event_id % 7 WHEN 0 THEN event_type || ' failed user_id=' || CAST(user_id AS VARCHAR) WHEN 1 THEN event_type || ' from 10.1.2.3'
    WHEN 2 THEN event_type || ' request_id=r' || CAST(user_id AS VARCHAR) WHEN 3 THEN event_type
    WHEN 4 THEN 'GET /' || event_type || ' HTTP/1.1 404' WHEN 5 THEN event_type || ' done' END AS message,
  CASE WHEN event_id % 7 IN (4, 6) THEN 'unknown' ELSE 'svc-' || CAST(user_id % 7 AS VARCHAR) END AS service,
  CASE event_id % 7 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 4 THEN 'u' || CAST(user_id AS VARCHAR) WHEN 5 THEN CAST(user_id AS VARCHAR) END AS user_id,
  CASE event_id % 7 WHEN 2 THEN 'r' || CAST(user_id AS VARCHAR) END AS request_id,
  CASE event_id % 7 WHEN 1 THEN '10.1.2.3' WHEN 4 THEN '10.0.0.9' END AS source_ip FROM events)"""


@query(
    "parse_text_line",
    f"""WITH {_TEXT_SQL} SELECT line_no, layout, "timestamp", level, message, service, user_id, request_id, source_ip FROM parsed""",
)
def parse_text_line(spark: SparkSession, directory: str) -> DataFrame:
    records = clean.normalize(parse_lines(messy_text_lines(spark, directory)), default_year=2024)
    return records.select(
        "line_no", "layout", "timestamp", "level", "message", "service", "user_id", "request_id", "source_ip"
    )


@query(
    "drop_malformed",
    f"WITH {_TEXT_SQL} SELECT coalesce(CASE WHEN layout IS NULL THEN 'malformed' END, 'accepted') AS outcome, count(*) AS n FROM parsed GROUP BY 1",
)
def drop_malformed(spark: SparkSession, directory: str) -> DataFrame:
    records = clean.clean_lines(messy_text_lines(spark, directory), infer_time=False, default_year=2024)
    return records.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n"))


@query(
    "clean_log_lines",
    f"""WITH {_TEXT_SQL}, blocks AS (SELECT *, line_no // 4096 AS block FROM parsed WHERE layout IS NOT NULL)
SELECT level, service, count(*) AS n, min("timestamp") AS earliest, max("timestamp") AS latest FROM (
  SELECT DISTINCT "timestamp", level, message, service FROM blocks) GROUP BY level, service""",
)
def clean_log_lines(spark: SparkSession, directory: str) -> DataFrame:
    """Chunk, parse, normalize, validate, deduplicate in chunks and across them, then summarize."""
    from tidelog.operators.chunking import with_block_offsets
    from tidelog.operators.dedup import dedup_first_wins, with_hash

    chunked = chunk_budget(with_block_offsets(messy_text_lines(spark, directory)), 50_000)
    records = clean.good(clean.clean_lines(chunked, default_year=2024))
    unique = dedup_first_wins(with_hash(clean.dedup_by_type(records)), ["file", "chunk_id", "line_no"])
    return unique.groupBy("level", "service").agg(
        F.count("*").alias("n"), F.min("timestamp").alias("earliest"), F.max("timestamp").alias("latest")
    )


@query(
    "dedup_in_chunk",
    f"""WITH {ELOG} SELECT event_id FROM elog QUALIFY row_number() OVER (PARTITION BY chunk_id, "timestamp", message ORDER BY pos) = 1""",
)
def dedup_in_chunk(spark: SparkSession, directory: str) -> DataFrame:
    return clean.dedup_structured(event_records(spark, directory)).select("event_id")


@query(
    "dedup_in_chunk_text",
    f"""WITH {ELOG} SELECT event_id FROM elog QUALIFY row_number() OVER (PARTITION BY chunk_id, "timestamp", level, message, service, user_id ORDER BY pos) = 1""",
)
def dedup_in_chunk_text(spark: SparkSession, directory: str) -> DataFrame:
    records = event_records(spark, directory).withColumns(
        {"request_id": F.lit(None).cast("string"), "source_ip": F.lit(None).cast("string")}
    )
    return clean.dedup_text(records).select("event_id")


@query(
    "emit_json",
    f"""WITH {ELOG} SELECT event_id, '{{"timestamp":"' || "timestamp" || '","level":"' || level || '","message":"' || message || '","service":' ||
      coalesce('"' || service || '"', 'null') || '}}' AS raw_data FROM elog""",
)
def emit_json(spark: SparkSession, directory: str) -> DataFrame:
    fields = ("timestamp", "level", "message", "service")
    return clean.emit_json(event_records(spark, directory), fields).select("event_id", "raw_data")


# --- validation -------------------------------------------------------------------------------------


@query("validate_entry", f"WITH {ELOG} SELECT event_id, level, message FROM elog WHERE {_VALID}")
def validate_entry(spark: SparkSession, directory: str) -> DataFrame:
    return validate.valid_records(event_records(spark, directory)).select("event_id", "level", "message")


@query(
    "rejected_entries",
    f"WITH {ELOG} SELECT event_id, 'unknown level' AS reject_reason FROM elog WHERE NOT {_VALID}",
)
def rejected_entries(spark: SparkSession, directory: str) -> DataFrame:
    return validate.rejected_records(event_records(spark, directory)).select("event_id", "reject_reason")


# JSON spellings of a member and whether each is true.
_VALUES = (
    ("null", False), ('""', False), ("0", False), ("0.0", False), ("false", False), ("[]", False), ("{}", False),
    ('"x"', True), ('"0"', True), ('"false"', True), ('"[]"', True), ("-1.5", True), ("true", True), ("[0]", True),
    ('{"a":null}', True), ("1e-3", True),
)


@query(
    "is_falsy",
    "SELECT event_id, NOT (event_id % 17 < 7 OR event_id % 17 = 16) AS truthy FROM events",
)
def is_falsy(spark: SparkSession, directory: str) -> DataFrame:
    number = F.col("event_id")
    spelled = F.when(F.lit(False), F.lit(""))
    for index, (text, _) in enumerate(_VALUES):
        spelled = spelled.when(number % 17 == index, F.lit(f'{{"m":{text}}}'))
    docs = table(spark, directory, "events").select(
        "event_id", parse_json(spelled.otherwise(F.lit('{"other":1}'))).alias("doc")
    )
    return docs.select("event_id", truthy(field(F.col("doc"), "m")).alias("truthy"))


_ENTRY_SQL = f"""WITH {ELOG} SELECT event_id, CASE event_id % 8
  WHEN 0 THEN CASE WHEN NOT ({_VALID}) THEN 'unknown level' END
  WHEN 1 THEN 'not an object' WHEN 2 THEN 'missing timestamp' WHEN 3 THEN 'missing level' WHEN 4 THEN 'missing message'
  WHEN 5 THEN 'level is not text' WHEN 6 THEN 'unknown level' ELSE 'missing timestamp' END AS problem FROM elog"""


@query("validate_entry_json", _ENTRY_SQL)
def validate_entry_json(spark: SparkSession, directory: str) -> DataFrame:
    shape = F.col("event_id") % 8
    entry = F.to_json(F.struct("timestamp", "level", "message", "service"))
    text = (
        F.when(shape == 0, entry)
        .when(shape == 1, F.concat(F.lit("["), entry, F.lit("]")))
        .when(shape == 2, F.lit('{"level":"INFO","message":"m"}'))
        .when(shape == 3, F.lit('{"timestamp":1,"level":"","message":"m"}'))
        .when(shape == 4, F.lit('{"timestamp":"t","level":"INFO","message":[]}'))
        .when(shape == 5, F.lit('{"timestamp":"t","level":40,"message":"m"}'))
        .when(shape == 6, F.lit('{"timestamp":"t","level":" INFO ","message":"m"}'))
        .otherwise(F.lit('{"timestamp":false,"level":"INFO","message":"m"}'))
    )
    records = as_event_records(spread(table(spark, directory, "events")))
    docs = records.select("event_id", parse_json(text).alias("entry"))
    return docs.select("event_id", entry_problem(F.col("entry")).alias("problem"))
