"""Hashing, deduplication, storing and retrieval over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.json_values import json_hash, parse_json
from tidelog.operators import dedup as D
from tidelog.operators import retrieve as R
from tidelog.operators.clean import emit_json
from tidelog.operators.validate import valid_records
from tidelog.plans.adapters import ELOG, HASHED, RESULTS, chunk_results, event_records
from tidelog.plans.registry import query
from tidelog.sources import sidecars
from tidelog.sources import store as S
from tidelog.sources.scratch import scratch_path

# The day from which records count as new; everything before it is already stored.
CUTOVER = "2024-01-15T00:00:00"

_STORED_SQL = f"""stored AS (SELECT log_hash FROM ranked WHERE "timestamp" < '{CUTOVER}' GROUP BY log_hash)"""


def hashed_events(spark: SparkSession, directory: str) -> DataFrame:
    """Validated event records with their hash."""
    return D.with_hash(valid_records(event_records(spark, directory)))


def survivors(spark: SparkSession, directory: str) -> DataFrame:
    return D.dedup_first_wins(hashed_events(spark, directory))


@query("log_hash", f"WITH {HASHED} SELECT event_id, log_hash FROM hashed")
def log_hash(spark: SparkSession, directory: str) -> DataFrame:
    return hashed_events(spark, directory).select("event_id", "log_hash")


@query(
    "log_hash_json",
    f"""WITH {ELOG} SELECT event_id, md5(concat_ws('|', "timestamp",
      CASE event_id % 4 WHEN 0 THEN 'True' WHEN 1 THEN '1.5' WHEN 2 THEN '7' ELSE level END, message,
      CASE WHEN service IS NOT NULL THEN service WHEN event_id % 2 = 0 THEN '' ELSE 'None' END)) AS log_hash FROM elog""",
)
def log_hash_json(spark: SparkSession, directory: str) -> DataFrame:
    """Hash of raw JSON records: missing and null services differ, scalars keep their printed form."""
    number = F.col("event_id")
    level = (
        F.when(number % 4 == 0, "true").when(number % 4 == 1, "1.5").when(number % 4 == 2, "7").otherwise(F.concat(F.lit('"'), "level", F.lit('"')))
    )
    service = (
        F.when(F.col("service").isNotNull(), F.concat(F.lit(',"service":"'), "service", F.lit('"')))
        .when(number % 2 == 0, "")
        .otherwise(',"service":null')
    )
    raw = F.concat(
        F.lit('{"timestamp":"'), "timestamp", F.lit('","level":'), level, F.lit(',"message":"'), "message", F.lit('"'), service, F.lit("}")
    )
    docs = event_records(spark, directory).select("event_id", raw.alias("raw")).withColumn("doc", parse_json(F.col("raw")))
    return docs.select("event_id", json_hash(F.col("raw"), F.col("doc")).alias("log_hash"))


@query(
    "union_chunks",
    f"""WITH {ELOG} SELECT event_id, message, CASE WHEN "timestamp" < '{CUTOVER}' THEN 'early' END AS origin FROM elog""",
)
def union_chunks(spark: SparkSession, directory: str) -> DataFrame:
    records = event_records(spark, directory)
    early = records.filter(F.col("timestamp") < CUTOVER).select("event_id", "message", F.lit("early").alias("origin"))
    late = records.filter(F.col("timestamp") >= CUTOVER).select("message", "event_id")
    return D.union_chunks([early, late])


@query("dedup_first_wins", f'WITH {HASHED} SELECT event_id, log_hash, "timestamp", level, message, service FROM survivors')
def dedup_first_wins(spark: SparkSession, directory: str) -> DataFrame:
    return survivors(spark, directory).select("event_id", "log_hash", "timestamp", "level", "message", "service")


@query("skip_failed_chunks", f"WITH {ELOG}, {RESULTS} SELECT file, chunk_id, error FROM results WHERE NOT success")
def skip_failed_chunks(spark: SparkSession, directory: str) -> DataFrame:
    return D.processing_errors(chunk_results(event_records(spark, directory)))


@query(
    "dedup_vs_store",
    f"WITH {HASHED}, {_STORED_SQL} SELECT event_id, log_hash FROM survivors WHERE log_hash NOT IN (SELECT log_hash FROM stored)",
)
def dedup_vs_store(spark: SparkSession, directory: str) -> DataFrame:
    unique = survivors(spark, directory)
    stored = unique.filter(F.col("timestamp") < CUTOVER)
    return D.dedup_vs_store(unique, stored).select("event_id", "log_hash")


@query(
    "dedup_small_vs_store",
    f"WITH {HASHED}, {_STORED_SQL} SELECT event_id, log_hash FROM survivors WHERE log_hash NOT IN (SELECT log_hash FROM stored)",
)
def dedup_small_vs_store(spark: SparkSession, directory: str) -> DataFrame:
    unique = survivors(spark, directory)
    stored = unique.filter(F.col("timestamp") < CUTOVER)
    return D.dedup_small_vs_store(unique, stored).select("event_id", "log_hash")


@query(
    "records_of_good_chunks",
    f"WITH {HASHED}, {RESULTS} SELECT event_id FROM hashed WHERE chunk_id IN (SELECT chunk_id FROM results WHERE success)",
)
def records_of_good_chunks(spark: SparkSession, directory: str) -> DataFrame:
    results = chunk_results(event_records(spark, directory))
    return D.skip_failed(hashed_events(spark, directory), results).select("event_id")


@query(
    "reject_unstorable",
    f"""WITH {ELOG} SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'timestamp is null' WHEN 1 THEN 'level is null' ELSE 'message is null' END AS reject_reason
FROM elog WHERE event_id % 6 < 3""",
)
def reject_unstorable(spark: SparkSession, directory: str) -> DataFrame:
    return D.unstorable_records(_with_gaps(event_records(spark, directory))).select("event_id", "reject_reason")


@query("storable_records", f"WITH {ELOG} SELECT event_id FROM elog WHERE event_id % 6 >= 3")
def storable_records(spark: SparkSession, directory: str) -> DataFrame:
    return D.storable_records(_with_gaps(event_records(spark, directory))).select("event_id")


def _with_gaps(records: DataFrame) -> DataFrame:
    shape = F.col("event_id") % 6
    return records.withColumns(
        {
            name: F.when(shape != index, F.col(name))
            for index, name in enumerate(("timestamp", "level", "message"))
        }
    )


_STATS_SQL = f"""WITH {HASHED}, {RESULTS}, {_STORED_SQL},
kept AS (SELECT h.log_hash FROM hashed h WHERE h.chunk_id % 10 <> 3),
per_hash AS (SELECT log_hash, count(*) AS copies, log_hash IN (SELECT log_hash FROM stored) AS known FROM kept GROUP BY log_hash)
SELECT (SELECT count(*) FROM results) AS total_chunks_processed,
  (SELECT CAST(sum(original_line_count) FILTER (success) AS BIGINT) FROM results) AS total_raw_logs,
  (SELECT CAST(sum(cleaned_line_count) FILTER (success) AS BIGINT) FROM results) AS total_cleaned_logs,
  (SELECT CAST(sum(original_line_count) AS BIGINT) FROM results) AS total_input_lines,
  (SELECT count(*) FROM results WHERE NOT success) AS failed_chunks,
  CAST(sum(copies - 1) AS BIGINT) AS duplicates_removed,
  count(*) FILTER (known) AS duplicates_in_store, CAST(0 AS BIGINT) AS unstorable_logs,
  count(*) FILTER (known) AS invalid_logs_filtered, count(*) FILTER (NOT known) AS final_log_count FROM per_hash"""


@query("merge_stats", _STATS_SQL)
def merge_stats(spark: SparkSession, directory: str) -> DataFrame:
    hashed = hashed_events(spark, directory)
    results = chunk_results(event_records(spark, directory))
    stored = D.distinct_hashes(hashed.filter(F.col("timestamp") < CUTOVER))
    return D.merge_stats(results, D.skip_failed(hashed, results), stored)


@query(
    "hash_fates",
    f"WITH {HASHED}, {_STORED_SQL} SELECT log_hash, count(*) AS copies, CASE WHEN log_hash IN (SELECT log_hash FROM stored) THEN 'dup_in_store' ELSE 'stored' END AS fate FROM hashed GROUP BY log_hash",
)
def hash_fates(spark: SparkSession, directory: str) -> DataFrame:
    hashed = hashed_events(spark, directory)
    return D.hash_fates(hashed, D.distinct_hashes(hashed.filter(F.col("timestamp") < CUTOVER)))


@query(
    "chunk_details",
    f"WITH {ELOG}, {RESULTS} SELECT file, chunk_id, original_line_count AS original_count, cleaned_line_count AS cleaned_count, tokens_used, processing_time_seconds AS processing_time FROM results WHERE success",
)
def chunk_details(spark: SparkSession, directory: str) -> DataFrame:
    return D.chunk_details(chunk_results(event_records(spark, directory)))


@query("tag_lineage", f"WITH {ELOG} SELECT event_id, chunk_id, 'r1' AS run, CAST(4 AS BIGINT) AS batch_id, true AS stamped FROM elog")
def tag_lineage(spark: SparkSession, directory: str) -> DataFrame:
    tagged = D.tag_lineage(event_records(spark, directory), "r1", 4)
    stamped = F.col("created_at").try_cast("timestamp").isNotNull().alias("stamped")
    return tagged.select("event_id", "chunk_id", "run", "batch_id", stamped)


@query("distinct_hashes", f"WITH {HASHED} SELECT DISTINCT log_hash FROM hashed")
def distinct_hashes(spark: SparkSession, directory: str) -> DataFrame:
    return D.distinct_hashes(hashed_events(spark, directory))


@query("approx_distinct_hashes", f"WITH {HASHED} SELECT true AS within_ten_percent FROM hashed LIMIT 1")
def approx_distinct_hashes(spark: SparkSession, directory: str) -> DataFrame:
    hashed = hashed_events(spark, directory)
    both = D.one_row(D.approx_distinct_hashes(hashed), D.distinct_hashes(hashed).agg(F.count("*").alias("exact")))
    return both.select((F.abs(F.col("approx_hashes") - F.col("exact")) <= 0.1 * F.col("exact")).alias("within_ten_percent"))


# --- stored table ---------------------------------------------------------------------------------


@query(
    "store_append",
    f"""WITH {HASHED}, early AS (SELECT *, row_number() OVER (PARTITION BY log_hash ORDER BY file, chunk_id, pos) AS place FROM hashed WHERE "timestamp" < '{CUTOVER}')
SELECT log_hash, "timestamp", level, message, service, chunk_id, pos, CAST(0 AS BIGINT) AS batch_id FROM early WHERE place = 1
UNION ALL SELECT log_hash, "timestamp", level, message, service, chunk_id, pos, 1 FROM survivors WHERE log_hash NOT IN (SELECT log_hash FROM early)""",
)
def store_append(spark: SparkSession, directory: str) -> DataFrame:
    """Two batches, the second a superset of the first, and the second repeated."""
    root = scratch_path(spark, "store")
    records = valid_records(event_records(spark, directory)).withColumns(
        {name: F.lit(None).cast("string") for name in ("request_id", "source_ip")}
    ).withColumn("user_id", F.col("user_id").cast("string"))
    S.merge_batch(records.filter(F.col("timestamp") < CUTOVER), root, "daily", 0)
    S.merge_batch(records, root, "daily", 1)
    S.merge_batch(records, root, "daily", 1)
    return S.read_store(spark, root).select(
        "log_hash", "timestamp", "level", "message", "service", "chunk_id", "pos", "batch_id"
    )


@query(
    "store_append_memory",
    f"""WITH {HASHED} SELECT log_hash AS _log_hash, chunk_id AS _chunk_id, event_id FROM hashed
UNION ALL SELECT log_hash, chunk_id, event_id FROM hashed WHERE "timestamp" >= '{CUTOVER}'""",
)
def store_append_memory(spark: SparkSession, directory: str) -> DataFrame:
    records = valid_records(event_records(spark, directory))
    held = S.append_session_store(None, records)
    held = S.append_session_store(held, records.filter(F.col("timestamp") >= CUTOVER))
    return held.select("_log_hash", "_chunk_id", "event_id")


@query(
    "store_raw_data",
    f"""WITH {HASHED} SELECT event_id, CAST(event_id % 97 AS VARCHAR) AS shard, 'e' || CAST(event_id AS VARCHAR) AS tag FROM survivors""",
)
def store_raw_data(spark: SparkSession, directory: str) -> DataFrame:
    """Source lines with members of their own: the stored record gives them back. The run's name is no plain path."""
    root = scratch_path(spark, "raw-store")
    whole = F.to_json(F.struct("message", F.col("event_id"), (F.col("event_id") % 97).alias("shard"), F.struct(F.concat(F.lit("e"), F.col("event_id")).alias("tag")).alias("more")))
    records = valid_records(event_records(spark, directory)).withColumn("raw", whole).withColumns(
        {name: F.lit(None).cast("string") for name in ("request_id", "source_ip")}
    ).withColumn("user_id", F.col("user_id").cast("string"))
    S.merge_batch(records, root, "a/b=c: 7%", 0)
    stored = S.read_store(spark, root).where("run = 'a/b=c: 7%'")
    return stored.select(
        F.get_json_object("raw_data", "$.event_id").cast("long").alias("event_id"),
        F.get_json_object("raw_data", "$.shard").alias("shard"),
        F.get_json_object("raw_data", "$.more.tag").alias("tag"),
    )


def _stored_records(spark: SparkSession, directory: str) -> DataFrame:
    records = valid_records(event_records(spark, directory)).withColumn("user_id", F.col("user_id").cast("string"))
    return records.withColumns({name: F.lit(None).cast("string") for name in ("request_id", "source_ip")})


# First and last days of the batches of `indexed_store`, which overlap.
_DAYS = (("2024-01-01", "2024-01-11"), ("2024-01-05", "2024-01-21"), ("2024-01-05", "2024-02-09"))


def indexed_store(spark: SparkSession, directory: str, merges: tuple[int, ...] = (0, 1, 2)) -> tuple[str, list[tuple[int, dict[str, int]]]]:
    """(root of a store of three overlapping batches with sidecars; the counters of each merge)."""
    root, records = scratch_path(spark, "indexed-store"), _stored_records(spark, directory)
    counters = []
    for number in merges:
        first, last = _DAYS[number]
        batch = records.filter((F.col("timestamp") >= first) & (F.col("timestamp") < last))
        counters.append((number, S.merge_indexed(batch, root, "daily", number)))
    return root, counters


_BATCH_SQL = f"""batches(batch_id, first_day, last_day) AS (VALUES {", ".join(str((n, *days)) for n, days in enumerate(_DAYS))}),
held AS (SELECT b.batch_id, h.*, row_number() OVER (PARTITION BY b.batch_id, log_hash ORDER BY file, chunk_id, pos) AS place
  FROM hashed h JOIN batches b ON "timestamp" >= first_day AND "timestamp" < last_day),
kept AS (SELECT * FROM held WHERE place = 1 QUALIFY batch_id = min(batch_id) OVER (PARTITION BY log_hash))"""


@query(
    "store_indexed",
    f"""WITH {HASHED}, {_BATCH_SQL} SELECT log_hash, "timestamp", level, message, service, chunk_id, pos, CAST(batch_id AS BIGINT) AS batch_id FROM kept""",
)
def store_indexed(spark: SparkSession, directory: str) -> DataFrame:
    """The second batch is merged once more before the third."""
    root, _ = indexed_store(spark, directory, (0, 1, 1, 2))
    return S.read_store(spark, root).select("log_hash", "timestamp", "level", "message", "service", "chunk_id", "pos", "batch_id")


@query(
    "merge_counters",
    f"""WITH {HASHED}, {_BATCH_SQL} SELECT CAST(h.batch_id AS BIGINT) AS batch_id, CAST(count(*) - count(DISTINCT h.log_hash) AS BIGINT) AS duplicates_removed,
  CAST(count(DISTINCT h.log_hash) - any_value(n) AS BIGINT) AS duplicates_in_store, CAST(0 AS BIGINT) AS unstorable_logs,
  CAST(count(DISTINCT h.log_hash) - any_value(n) AS BIGINT) AS invalid_logs_filtered, CAST(any_value(n) AS BIGINT) AS final_log_count
FROM held h JOIN (SELECT b.batch_id, count(log_hash) AS n FROM batches b LEFT JOIN kept USING (batch_id) GROUP BY b.batch_id) USING (batch_id)
GROUP BY h.batch_id""",
)
def merge_counters(spark: SparkSession, directory: str) -> DataFrame:
    """What each merge counted while it wrote; a repeated merge counts the same."""
    _, counters = indexed_store(spark, directory, (0, 1, 2, 2))
    names = list(counters[0][1])
    rows = [(number, *map(counted.get, names)) for number, counted in counters]
    return spark.createDataFrame(rows, "batch_id long, " + ", ".join(f"{name} long" for name in names)).distinct()


@query(
    "distinct_hash_sketches",
    f"WITH {HASHED} SELECT true AS within_three_percent, CAST(count(*) * 0 + 3 AS BIGINT) AS n_sketches FROM survivors",
)
def distinct_hash_sketches(spark: SparkSession, directory: str) -> DataFrame:
    """Distinct hashes of all batches from the union of their sketches."""
    root, _ = indexed_store(spark, directory)
    sketches = sidecars.sidecar(spark, root, "sketches")
    exact = D.distinct_hashes(S.read_store(spark, root)).agg(F.count("*").alias("exact"))
    both = D.one_row(sidecars.distinct_estimate(sketches), exact, sketches.agg(F.count("*").alias("n_sketches")))
    return both.select((F.abs(F.col("approx_hashes") - F.col("exact")) <= 0.03 * F.col("exact")).alias("within_three_percent"), "n_sketches")


@query("store_reset", "SELECT CAST(0 AS BIGINT) AS total_logs")
def store_reset(spark: SparkSession, directory: str) -> DataFrame:
    """A filled table is emptied and stays readable."""
    root = scratch_path(spark, "reset")
    records = valid_records(event_records(spark, directory)).withColumns(
        {name: F.lit(None).cast("string") for name in ("request_id", "source_ip")}
    ).withColumn("user_id", F.col("user_id").cast("string"))
    S.merge_batch(records, root, "daily", 0)
    S.reset_store(spark, root)
    return S.read_store(spark, root).agg(F.count("*").alias("total_logs"))


# --- retrieval --------------------------------------------------------------------------------------

_COLUMNS = 'event_id, "timestamp", level, message, service'
_SHOWN = ("event_id", "timestamp", "level", "message", "service")


@query("level_filter", f"WITH {HASHED} SELECT {_COLUMNS} FROM survivors WHERE upper(level) = 'INFO'")
def level_filter(spark: SparkSession, directory: str) -> DataFrame:
    return R.matching(survivors(spark, directory), R.level_is("Info")).select(*_SHOWN)


@query("level_filter_as_stored", f"WITH {HASHED} SELECT {_COLUMNS} FROM survivors WHERE level = 'INFO'")
def level_filter_as_stored(spark: SparkSession, directory: str) -> DataFrame:
    return R.matching(survivors(spark, directory), R.level_is("info", stored_as_is=True)).select(*_SHOWN)


@query("service_filter", f"WITH {HASHED} SELECT {_COLUMNS} FROM survivors WHERE service = 'svc-3'")
def service_filter(spark: SparkSession, directory: str) -> DataFrame:
    return R.matching(survivors(spark, directory), R.service_is("svc-3"), R.level_is("")).select(*_SHOWN)


@query("conjunctive_filter", f"WITH {HASHED} SELECT {_COLUMNS} FROM survivors WHERE level = 'ERROR' AND service = 'svc-2'")
def conjunctive_filter(spark: SparkSession, directory: str) -> DataFrame:
    return R.matching(survivors(spark, directory), R.level_is("error"), R.service_is("svc-2")).select(*_SHOWN)


@query(
    "project_raw",
    f"""WITH {HASHED} SELECT log_hash, "timestamp", message FROM survivors WHERE event_id % 9 <> 0""",
)
def project_raw(spark: SparkSession, directory: str) -> DataFrame:
    stored = emit_json(survivors(spark, directory), ("timestamp", "level", "message", "service"))
    broken = stored.withColumn(
        "raw_data", F.when(F.col("event_id") % 9 == 0, F.left("raw_data", F.lit(12))).otherwise(F.col("raw_data"))
    )
    docs = R.raw_documents(broken)
    return docs.select(
        "log_hash",
        F.variant_get("doc", "$.timestamp", "string").alias("timestamp"),
        F.variant_get("doc", "$.message", "string").alias("message"),
    )


@query(
    "display_columns",
    f"""WITH {HASHED} SELECT replace("timestamp", 'T', ' ') AS "timestamp", level, coalesce(service, 'unknown') AS service, message FROM survivors""",
)
def display_columns(spark: SparkSession, directory: str) -> DataFrame:
    return R.display_columns(survivors(spark, directory))


_NEWEST = 'ORDER BY "timestamp" DESC, file, chunk_id, pos'


@query("newest_first", f"WITH {HASHED} SELECT {_COLUMNS} FROM survivors {_NEWEST}")
def newest_first(spark: SparkSession, directory: str) -> DataFrame:
    return R.newest_first(survivors(spark, directory)).select(*_SHOWN)


@query("newest_first_topk", f"WITH {HASHED} SELECT {_COLUMNS} FROM survivors {_NEWEST} LIMIT 25")
def newest_first_topk(spark: SparkSession, directory: str) -> DataFrame:
    return R.limited(R.newest_first(survivors(spark, directory)), 25).select(*_SHOWN)


@query("retrieve", f"WITH {HASHED} SELECT {_COLUMNS} FROM survivors {_NEWEST} LIMIT 1000")
def retrieve(spark: SparkSession, directory: str) -> DataFrame:
    return R.retrieve(survivors(spark, directory)).select(*_SHOWN)


@query(
    "retrieve_filtered",
    f"WITH {HASHED} SELECT {_COLUMNS} FROM survivors WHERE upper(level) = 'WARN' AND service = 'svc-1' {_NEWEST} LIMIT 50",
)
def retrieve_filtered(spark: SparkSession, directory: str) -> DataFrame:
    return R.retrieve(survivors(spark, directory), 50, "warn", "svc-1").select(*_SHOWN)


@query(
    "retrieve_newest",
    f"""WITH {HASHED} SELECT "timestamp", level, message, service, pos FROM survivors WHERE upper(level) = 'WARN' AND service = 'svc-1' {_NEWEST} LIMIT 50""",
)
def retrieve_newest(spark: SparkSession, directory: str) -> DataFrame:
    """The newest rows of a store, from the files that can hold them."""
    root, _ = indexed_store(spark, directory)
    return sidecars.retrieve_newest(spark, root, 50, "warn", "svc-1").select("timestamp", "level", "message", "service", "pos")


@query(
    "retrieval_counts",
    f"WITH {HASHED} SELECT count(*) AS total_matching, least(count(*), 1000) AS total_count FROM survivors WHERE upper(level) = 'DEBUG'",
)
def retrieval_counts(spark: SparkSession, directory: str) -> DataFrame:
    return R.retrieval_counts(survivors(spark, directory), level="debug")


@query("top_services", f"WITH {HASHED} SELECT service, count(*) AS n FROM survivors GROUP BY service ORDER BY n DESC, service NULLS FIRST LIMIT 10")
def top_services(spark: SparkSession, directory: str) -> DataFrame:
    return R.top_services(survivors(spark, directory))


@query("first_services", f"WITH {HASHED} SELECT service, count(*) AS n FROM survivors GROUP BY service ORDER BY service NULLS FIRST LIMIT 10")
def first_services(spark: SparkSession, directory: str) -> DataFrame:
    return R.first_services(survivors(spark, directory))


@query(
    "display_services",
    f"WITH {HASHED} SELECT service, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM survivors GROUP BY service ORDER BY n DESC, service NULLS FIRST LIMIT 5",
)
def display_services(spark: SparkSession, directory: str) -> DataFrame:
    return R.display_services(survivors(spark, directory))


@query(
    "display_rows",
    f"""WITH {HASHED} SELECT replace("timestamp", 'T', ' ') AS "timestamp", level, coalesce(service, 'unknown') AS service, message
FROM (SELECT * FROM survivors {_NEWEST} LIMIT 50)""",
)
def display_rows(spark: SparkSession, directory: str) -> DataFrame:
    return R.display_rows(survivors(spark, directory))
