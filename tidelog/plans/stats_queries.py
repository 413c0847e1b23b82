"""Statistics, run metrics and scalar functions over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import text as X
from tidelog.functions.fields import url_host
from tidelog.functions.json_values import is_array, is_object, kind, parse_json, scalar_text, sqlite_text
from tidelog.functions.text import elapsed_seconds
from tidelog.operators import runs as U
from tidelog.operators import stats as A
from tidelog.plans.adapters import DOCFILES, ELOG, HASHED, RESULTS, chunk_results, document_files, event_records, table
from tidelog.plans.merge_queries import indexed_store, survivors
from tidelog.plans.registry import query
from tidelog.sources.scratch import scratch_path
from tidelog.sources.sidecars import store_statistics


@query("total_count", f"WITH {HASHED} SELECT count(*) AS total_logs FROM survivors")
def total_count(spark: SparkSession, directory: str) -> DataFrame:
    return A.total_count(survivors(spark, directory))


@query("count_by_level", f"WITH {HASHED} SELECT level, count(*) AS n FROM survivors GROUP BY level")
def count_by_level(spark: SparkSession, directory: str) -> DataFrame:
    return A.count_by_level(survivors(spark, directory))


@query("count_by_service", f"WITH {HASHED} SELECT service, count(*) AS n FROM survivors GROUP BY service")
def count_by_service(spark: SparkSession, directory: str) -> DataFrame:
    return A.count_by_service(survivors(spark, directory))


@query("time_range", f'WITH {HASHED} SELECT min("timestamp") AS earliest, max("timestamp") AS latest FROM survivors')
def time_range(spark: SparkSession, directory: str) -> DataFrame:
    return A.time_range(survivors(spark, directory))


@query(
    "statistics_grouping_sets",
    f"""WITH {HASHED} SELECT CASE WHEN grouping(level) = 0 THEN 'level' WHEN grouping(service) = 0 THEN 'service' ELSE 'total' END AS dimension,
  CASE WHEN grouping(level) = 0 THEN level WHEN grouping(service) = 0 THEN service END AS key,
  count(*) AS n FROM survivors GROUP BY GROUPING SETS ((level), (service), ())""",
)
def statistics_grouping_sets(spark: SparkSession, directory: str) -> DataFrame:
    return A.statistic_rows(survivors(spark, directory))


def _statistics_sql(source: str, order: str, storage: str) -> str:
    return f"""SELECT count(*) AS total_logs,
  (SELECT string_agg(level || '=' || n, ',' ORDER BY level) FROM (SELECT coalesce(level, 'UNKNOWN') AS level, count(*) AS n FROM {source} GROUP BY 1)) AS levels,
  (SELECT string_agg(coalesce(service, '?') || '=' || n, ',' ORDER BY {order}) FROM (SELECT service, count(*) AS n FROM {source} GROUP BY service ORDER BY {order} LIMIT 10)) AS services,
  min("timestamp") AS earliest, max("timestamp") AS latest, '{storage}' AS storage_type FROM {source}"""


def _flat(row: DataFrame) -> DataFrame:
    """The statistics record with its map and list as text, for comparison."""
    pair = lambda name, n: F.concat(name, F.lit("="), n.cast("string"))
    return row.select(
        "total_logs",
        F.array_join(F.transform(F.array_sort(F.map_entries("level_distribution")), lambda x: pair(x["key"], x["value"])), ",").alias("levels"),
        F.array_join(F.transform("top_services", lambda x: pair(F.coalesce(x["service"], F.lit("?")), x["n"])), ",").alias("services"),
        "earliest",
        "latest",
        "storage_type",
    )


@query("statistics", f"WITH {HASHED} " + _statistics_sql("survivors", "n DESC, service NULLS FIRST", "table"))
def statistics(spark: SparkSession, directory: str) -> DataFrame:
    return _flat(A.statistics(survivors(spark, directory)))


@query("statistics_of_batches", f"WITH {HASHED} " + _statistics_sql("survivors", "n DESC, service NULLS FIRST", "table"))
def statistics_of_batches(spark: SparkSession, directory: str) -> DataFrame:
    """Statistics of a stored table from the partial counts beside it."""
    root, _ = indexed_store(spark, directory)
    return _flat(store_statistics(spark, root))


@query("statistics_by_name", f"WITH {HASHED} " + _statistics_sql("survivors", "service NULLS FIRST", "table"))
def statistics_by_name(spark: SparkSession, directory: str) -> DataFrame:
    return _flat(A.statistics(survivors(spark, directory), services_by_name=True))


@query(
    "memory_statistics",
    f"""WITH {ELOG}, held AS (SELECT CASE WHEN event_id % 3 = 0 THEN '' ELSE "timestamp" END AS t, CASE WHEN event_type <> 'view' THEN level END AS level,
  coalesce(service, 'unknown') AS service FROM elog), named AS (SELECT nullif(t, '') AS "timestamp", level, service FROM held) """
    + _statistics_sql("named", "n DESC, service", "memory"),
)
def memory_statistics(spark: SparkSession, directory: str) -> DataFrame:
    held = event_records(spark, directory).select(
        F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("timestamp")).alias("timestamp"),
        F.when(F.col("event_type") != "view", F.col("level")).alias("level"),
        "service",
    )
    return _flat(A.memory_statistics(held))


@query(
    "empty_statistics",
    "SELECT CAST(0 AS BIGINT) AS total_logs, CAST(NULL AS VARCHAR) AS levels, CAST(NULL AS VARCHAR) AS services, CAST(NULL AS VARCHAR) AS earliest, CAST(NULL AS VARCHAR) AS latest, 'memory' AS storage_type",
)
def empty_statistics(spark: SparkSession, directory: str) -> DataFrame:
    nothing = event_records(spark, directory).filter(F.col("message") == "no such message")
    return _flat(A.memory_statistics(nothing))


@query(
    "sum_counters",
    f"WITH {ELOG}, {RESULTS} SELECT CAST(sum(original_line_count) AS BIGINT) AS total_raw_logs, CAST(sum(cleaned_line_count) AS BIGINT) AS total_cleaned_logs FROM results WHERE success",
)
def sum_counters(spark: SparkSession, directory: str) -> DataFrame:
    results = chunk_results(event_records(spark, directory)).filter("success")
    return results.agg(
        F.sum("original_line_count").alias("total_raw_logs"), F.sum("cleaned_line_count").alias("total_cleaned_logs")
    )


@query(
    "success_rate",
    f"WITH {ELOG}, {RESULTS} SELECT count(*) AS total_chunks, count(*) FILTER (success) AS successful_chunks, count(*) FILTER (NOT success) AS failed_chunks, count(*) FILTER (success) / count(*)::DOUBLE AS success_rate FROM results",
)
def success_rate(spark: SparkSession, directory: str) -> DataFrame:
    return A.success_summary(chunk_results(event_records(spark, directory)))


@query(
    "usage_stats",
    f"""WITH {ELOG}, {RESULTS}, cents AS (SELECT success, tokens_used, processing_time_seconds FROM results)
SELECT count(*) AS total_calls, count(*) FILTER (success) AS successful_calls, count(*) FILTER (NOT success) AS failed_calls,
  CAST(sum(tokens_used) FILTER (success) AS BIGINT) AS total_tokens_used, round(sum(processing_time_seconds) FILTER (success), 6) AS total_processing_time,
  count(*) FILTER (success) / greatest(1, count(*))::DOUBLE * 100 AS success_rate,
  CAST(sum(tokens_used) FILTER (success) AS BIGINT) / greatest(1, count(*) FILTER (success))::DOUBLE AS avg_tokens_per_call,
  round(sum(processing_time_seconds) FILTER (success) / greatest(1, count(*) FILTER (success)), 6) AS avg_time_per_call FROM cents""",
)
def usage_stats(spark: SparkSession, directory: str) -> DataFrame:
    stats = A.usage_stats(chunk_results(event_records(spark, directory)))
    return stats.withColumns({name: F.round(name, 6) for name in ("total_processing_time", "avg_time_per_call")})


# --- runs -------------------------------------------------------------------------------------------
#
# One run per day and method, derived from events: half of the users ran sequentially.

_RUNS_SQL = """measured_events AS (
  SELECT strftime(ts, '%Y-%m-%d') AS day, CASE WHEN user_id % 2 = 0 THEN 'parallel' ELSE 'sequential' END AS processing_method,
    CASE WHEN user_id % 2 = 0 THEN 1 + day(ts) % 7 ELSE 1 END AS parallel_workers, event_type, CAST(round(value * 100) AS BIGINT) AS cents
  FROM events),
daily AS (
  SELECT day, processing_method, parallel_workers, count(*) AS total_chunks, count(*) FILTER (event_type <> 'error') AS successful_chunks,
    CAST(sum(cents) AS BIGINT) / (100.0::DOUBLE * parallel_workers) AS processing_time_seconds
  FROM measured_events GROUP BY day, processing_method, parallel_workers)"""


def daily_runs(spark: SparkSession, directory: str) -> DataFrame:
    even = F.col("user_id") % 2 == 0
    workers = F.when(even, 1 + F.dayofmonth("ts") % 7).otherwise(1).cast("long")
    return (
        table(spark, directory, "events")
        .groupBy(
            F.date_format("ts", "yyyy-MM-dd").alias("day"),
            F.when(even, "parallel").otherwise("sequential").alias("processing_method"),
            workers.alias("parallel_workers"),
        )
        .agg(
            F.count("*").alias("total_chunks"),
            F.count_if(F.col("event_type") != "error").alias("successful_chunks"),
            F.sum(F.round(F.col("value") * 100).cast("long")).alias("_cents"),
        )
        .select(
            "day",
            "processing_method",
            "total_chunks",
            "successful_chunks",
            (F.col("_cents") / (F.lit(100.0) * F.col("parallel_workers"))).alias("processing_time_seconds"),
            "parallel_workers",
        )
    )


@query(
    "run_rates",
    f"WITH {_RUNS_SQL} SELECT day, processing_method, total_chunks, successful_chunks, round(total_chunks / processing_time_seconds, 6) AS chunks_per_second, round(successful_chunks / total_chunks::DOUBLE, 9) AS success_rate FROM daily",
)
def run_rates(spark: SparkSession, directory: str) -> DataFrame:
    rated = U.run_rates(daily_runs(spark, directory))
    return rated.select(
        "day", "processing_method", "total_chunks", "successful_chunks",
        F.round("chunks_per_second", 6).alias("chunks_per_second"), F.round("success_rate", 9).alias("success_rate"),
    )


@query(
    "run_compare",
    f"""WITH {_RUNS_SQL}, paired AS (SELECT day, sum(processing_time_seconds) FILTER (processing_method = 'sequential') AS seq,
    sum(processing_time_seconds) FILTER (processing_method = 'parallel') AS par, max(parallel_workers) FILTER (processing_method = 'parallel') AS workers FROM daily GROUP BY day),
  measured AS (SELECT *, seq / par AS speedup FROM paired WHERE seq IS NOT NULL AND par IS NOT NULL)
SELECT day, CAST(workers AS BIGINT) AS workers, round(speedup, 6) AS speedup_factor, round(speedup / workers * 100, 6) AS efficiency_percent, round(seq - par, 6) AS time_saved_seconds,
  CASE WHEN speedup > workers * 0.7::DOUBLE THEN 'excellent' WHEN speedup > 2.0 THEN 'good' WHEN speedup > 1.2::DOUBLE THEN 'moderate' ELSE 'limited' END AS verdict FROM measured""",
)
def run_compare(spark: SparkSession, directory: str) -> DataFrame:
    compared = U.run_compare(daily_runs(spark, directory), ["day"])
    return compared.select(
        "day",
        "workers",
        F.round("speedup_factor", 6).alias("speedup_factor"),
        F.round("efficiency_percent", 6).alias("efficiency_percent"),
        F.round("time_saved_seconds", 6).alias("time_saved_seconds"),
        F.lower(F.element_at(F.split("recommendation", " "), 1)).alias("verdict"),
    )


@query(
    "run_compare_text",
    f"""WITH {_RUNS_SQL}, paired AS (SELECT day, sum(processing_time_seconds) FILTER (processing_method = 'sequential') AS seq,
    sum(processing_time_seconds) FILTER (processing_method = 'parallel') AS par, max(parallel_workers) FILTER (processing_method = 'parallel') AS workers FROM daily GROUP BY day),
  measured AS (SELECT *, seq / par AS speedup FROM paired WHERE seq IS NOT NULL AND par IS NOT NULL)
SELECT day, CASE WHEN speedup > workers * 0.7::DOUBLE THEN 'Excellent parallel performance! ' || printf('%.1f', speedup) || 'x speedup with ' || CAST(workers AS VARCHAR) || ' workers.'
  WHEN speedup > 2.0 THEN 'Good parallel performance. ' || printf('%.1f', speedup) || 'x speedup achieved.'
  WHEN speedup > 1.2::DOUBLE THEN 'Moderate parallel benefit. ' || printf('%.1f', speedup) || 'x speedup. Consider optimizing worker tasks.'
  ELSE 'Limited parallel benefit. ' || printf('%.1f', speedup) || 'x speedup. Sequential processing may be sufficient.' END AS recommendation FROM measured""",
)
def run_compare_text(spark: SparkSession, directory: str) -> DataFrame:
    """The whole sentence of the comparison."""
    return U.run_compare(daily_runs(spark, directory), ["day"]).select("day", "recommendation")


@query(
    "elapsed_seconds",
    """SELECT o_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, date_diff('microsecond', o_orderdate, l_shipdate) / 1000000.0::DOUBLE AS seconds
FROM orders JOIN lineitem ON l_orderkey = o_orderkey""",
)
def elapsed(spark: SparkSession, directory: str) -> DataFrame:
    """Seconds from an order to the shipping of each of its lines."""
    orders, lines = table(spark, directory, "orders"), table(spark, directory, "lineitem")
    joined = orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    started, ended = F.col("o_orderdate").cast("timestamp"), F.col("l_shipdate").cast("timestamp")
    return joined.select("o_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), elapsed_seconds(started, ended).alias("seconds"))


_AUDIT_SQL = (
    f"WITH {DOCFILES}, audit AS (SELECT 'proc_' || strftime(upload_time, '%Y%m%d_%H%M%S') || '_f' || CAST(doc_id AS VARCHAR) AS processing_id, "
    "'f' || CAST(doc_id AS VARCHAR) AS file_id, original_name, 1 + size_bytes // 600 AS chunk_count, "
    "CASE WHEN doc_id % 2 = 0 THEN 'parallel' ELSE 'sequential' END AS processing_method, size_bytes / 1000.0::DOUBLE AS processing_time_seconds, "
    "round(size_bytes / 1000.0::DOUBLE / 60, 9) AS estimated_time_minutes, size_bytes AS final_log_count, "
    "strftime(upload_time, '%Y-%m-%dT%H:%M:%S') AS completed_at, 'completed' AS status FROM docfiles) "
)


def audit_table(spark: SparkSession, directory: str) -> DataFrame:
    """One run per document, appended to an audit table and read back."""
    doc = F.col("doc_id")
    runs = document_files(spark, directory).select(
        F.concat(F.lit("f"), doc.cast("string")).alias("file_id"),
        "original_name",
        F.expr("1 + size_bytes div 600").alias("chunk_count"),
        (doc % 2 == 0).alias("use_parallel"),
        (F.col("size_bytes") / F.lit(1000.0)).alias("processing_time_seconds"),
        F.col("size_bytes").alias("final_log_count"),
        F.col("upload_time").alias("started_at"),
    )
    completed = F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss")
    path = scratch_path(spark, "audit")
    U.append_runs(U.run_records(runs, completed), path)
    audit = spark.read.parquet(path)
    return audit.withColumn("estimated_time_minutes", F.round("estimated_time_minutes", 9))


@query("job_append", _AUDIT_SQL + "SELECT * FROM audit")
def job_append(spark: SparkSession, directory: str) -> DataFrame:
    return audit_table(spark, directory)


@query("list_jobs", _AUDIT_SQL + "SELECT processing_id, completed_at, status FROM audit ORDER BY completed_at, processing_id")
def list_jobs(spark: SparkSession, directory: str) -> DataFrame:
    return U.list_runs(audit_table(spark, directory)).select("processing_id", "completed_at", "status")


@query("job_lookup", _AUDIT_SQL + "SELECT * FROM audit WHERE processing_id = 'proc_20240101_000647_f11'")
def job_lookup(spark: SparkSession, directory: str) -> DataFrame:
    return U.find_run(audit_table(spark, directory), "proc_20240101_000647_f11")


@query(
    "system_overview",
    f"""WITH {HASHED}, {RESULTS}, {_RUNS_SQL} SELECT (SELECT count(*) FROM documents) AS uploaded_files, (SELECT count(*) FROM daily) AS processing_jobs,
  (SELECT count(*) FROM survivors) AS total_logs, (SELECT max("timestamp") FROM survivors) AS latest,
  (SELECT count(*) FROM results) AS total_calls, (SELECT CAST(sum(tokens_used) FILTER (success) AS BIGINT) FROM results) AS total_tokens_used""",
)
def system_overview(spark: SparkSession, directory: str) -> DataFrame:
    overview = A.system_overview(
        document_files(spark, directory), daily_runs(spark, directory), survivors(spark, directory),
        chunk_results(event_records(spark, directory)),
    )
    return overview.select("uploaded_files", "processing_jobs", "total_logs", "latest", "total_calls", "total_tokens_used")


# --- scalar functions ---------------------------------------------------------------------------------


@query(
    "text_functions",
    """SELECT doc_id, lower(source) || '.log' LIKE '%.log' AS has_suffix, starts_with(text, 'The') AS starts, left(text, 1000) AS prefix,
  upper(lang) AS upper_lang, CAST(len(string_split(text, chr(10))[1:5]) AS BIGINT) AS head_lines, array_to_string(string_split(text, chr(10))[1:2], '/') AS joined,
  md5(text) AS digest, CAST(strlen(text) AS BIGINT) AS n_bytes, lang IN ('en', 'fr') AS listed,
  CASE WHEN doc_id % 4 = 0 THEN 'unknown' ELSE source END AS named, regexp_replace(source || '_a_b', '_', ' ') AS spaced, true AS utf8 FROM documents""",
)
def text_functions(spark: SparkSession, directory: str) -> DataFrame:
    text = F.col("text")
    lines = F.split(text, "\n")
    return table(spark, directory, "documents").select(
        "doc_id",
        F.endswith(F.concat(F.lower("source"), F.lit(".log")), F.lit(".log")).alias("has_suffix"),
        text.startswith("The").alias("starts"),
        F.left(text, F.lit(1000)).alias("prefix"),
        F.upper("lang").alias("upper_lang"),
        F.size(F.slice(lines, 1, 5)).cast("long").alias("head_lines"),
        F.array_join(F.slice(lines, 1, 2), "/").alias("joined"),
        F.md5(text).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.col("lang").isin("en", "fr").alias("listed"),
        X.or_unknown(F.when(F.col("doc_id") % 4 == 0, F.when(F.col("doc_id") % 8 == 0, "")).otherwise(F.col("source"))).alias("named"),
        X.first_underscore_to_space(F.concat("source", F.lit("_a_b"))).alias("spaced"),
        F.is_valid_utf8("text").alias("utf8"),
    )


@query(
    "json_functions",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'OBJECT' WHEN 1 THEN 'ARRAY' WHEN 2 THEN 'STRING' WHEN 3 THEN 'VOID' END AS kind,
  event_id % 5 = 0 AS is_object, event_id % 5 = 1 AS is_array, CAST(json_extract(props, '$.k') AS VARCHAR) AS k,
  '{"event_type":"' || event_type || '","value":null}' AS dumped, event_id % 2 = 0 AS has_key,
  CASE event_id % 5 WHEN 0 THEN 'True' WHEN 1 THEN '2.0' WHEN 2 THEN 'None' WHEN 3 THEN '' ELSE 'x' END AS printed,
  CASE event_id % 5 WHEN 0 THEN '1' WHEN 4 THEN 'x' WHEN 1 THEN '2' END AS stored FROM events""",
)
def json_functions(spark: SparkSession, directory: str) -> DataFrame:
    number = F.col("event_id")
    shaped = F.when(number % 5 == 0, F.col("props")).when(number % 5 == 1, "[1]").when(number % 5 == 2, '"s"').when(number % 5 == 3, "null").otherwise("{broken")
    scalar = (
        F.when(number % 5 == 0, '{"m":true}').when(number % 5 == 1, '{"m":2.0}').when(number % 5 == 2, '{"m":null}').when(number % 5 == 3, '{"n":1}').otherwise('{"m":"x"}')
    )
    staged = table(spark, directory, "events").select(
        "event_id", "event_type", "props", parse_json(shaped).alias("doc"), scalar.alias("raw"), parse_json(scalar).alias("scalar")
    )
    keys = F.json_object_keys(F.when(number % 2 == 0, F.col("props")).otherwise('{"other":1}'))
    return staged.select(
        "event_id",
        F.regexp_extract(kind(F.col("doc")), "^[A-Z]+", 0).alias("kind"),
        is_object(F.col("doc")).alias("is_object"),
        is_array(F.col("doc")).alias("is_array"),
        F.get_json_object("props", "$.k").alias("k"),
        F.to_json(F.struct("event_type", F.lit(None).cast("string").alias("value")), {"ignoreNullFields": "false"}).alias("dumped"),
        F.array_contains(keys, "k").alias("has_key"),
        scalar_text(F.col("raw"), F.col("scalar"), "m").alias("printed"),
        sqlite_text(F.col("scalar"), "m").alias("stored"),
    )


@query(
    "format_bytes",
    """WITH sizes AS (SELECT o_orderkey, CAST(floor(CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN o_custkey WHEN 2 THEN o_totalprice WHEN 3 THEN o_totalprice * 1000 ELSE o_totalprice * 50000 END) AS BIGINT) AS n FROM orders),
scaled AS (SELECT o_orderkey, n, CASE WHEN n < 1024 THEN 0 WHEN n < 1048576 THEN 1 WHEN n < 1073741824 THEN 2 WHEN n < 1099511627776 THEN 3 ELSE 4 END AS p FROM sizes)
SELECT o_orderkey, CASE WHEN n = 0 THEN '0 Bytes' ELSE rtrim(rtrim(CAST(CAST(n / power(1024, p) AS DECIMAL(22, 2)) AS VARCHAR), '0'), '.') || ' ' || ['Bytes', 'KB', 'MB', 'GB', 'TB'][p + 1] END AS size FROM scaled""",
)
def format_bytes(spark: SparkSession, directory: str) -> DataFrame:
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    size = (
        F.when(key % 5 == 0, F.lit(0.0))
        .when(key % 5 == 1, F.col("o_custkey").cast("double"))
        .when(key % 5 == 2, price)
        .when(key % 5 == 3, price * 1000)
        .otherwise(price * 50000)
    )
    return table(spark, directory, "orders").select("o_orderkey", X.format_bytes(F.floor(size)).alias("size"))


@query(
    "number_functions",
    """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN l_discount = 0 THEN 0.0 ELSE l_quantity / l_discount END AS guarded,
  l_quantity / greatest(1, l_linenumber - 3)::DOUBLE AS floored, greatest(1, l_orderkey * 7 // (l_partkey + 1)) AS whole,
  strftime(l_shipdate, '%Y%m%d_%H%M%S') AS stamped, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS iso FROM lineitem""",
)
def number_functions(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "lineitem").select(
        "l_orderkey",
        F.col("l_linenumber").cast("long").alias("l_linenumber"),
        X.ratio(F.col("l_quantity"), F.col("l_discount")).alias("guarded"),
        X.per_call(F.col("l_quantity"), (F.col("l_linenumber") - 3)).alias("floored"),
        F.greatest(F.lit(1).cast("long"), F.expr("l_orderkey * 7 div (l_partkey + 1)")).alias("whole"),
        F.date_format("l_shipdate", "yyyyMMdd_HHmmss").alias("stamped"),
        F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"),
    )


@query(
    "map_functions",
    "SELECT conv_id, turn, role || ':' || CAST(length(text) AS VARCHAR) || ';turn:' || CAST(turn AS VARCHAR) AS entries, CAST(2 AS BIGINT) AS n_entries, CAST(3 AS BIGINT) AS n_with_key FROM conversations",
)
def map_functions(spark: SparkSession, directory: str) -> DataFrame:
    pairs = F.array(
        F.struct(F.col("role").alias("k"), F.length("text").cast("long").alias("v")), F.struct(F.lit("turn").alias("k"), F.col("turn").alias("v"))
    )
    staged = table(spark, directory, "conversations").select("conv_id", "turn", F.map_from_entries(pairs).alias("m"))
    shown = F.transform(F.map_entries("m"), lambda x: F.concat(x["key"], F.lit(":"), x["value"].cast("string")))
    return staged.select(
        "conv_id",
        "turn",
        F.array_join(shown, ";").alias("entries"),
        F.size("m").cast("long").alias("n_entries"),
        F.size(F.map_concat("m", F.create_map(F.lit("extra"), F.lit(1).cast("long")))).cast("long").alias("n_with_key"),
    )


@query("url_host", "SELECT page_id, lower(regexp_extract(url, 'https?://([A-Za-z0-9.-]+)', 1)) AS host FROM pages")
def host_of_url(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "pages").select("page_id", url_host(F.col("url")).alias("host"))
