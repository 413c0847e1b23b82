"""Line numbering, chunking and per-chunk functions over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import chunking as C
from tidelog.operators import chunkmap as M
from tidelog.operators import scoring
from tidelog.operators.validate import record_problem
from tidelog.plans.adapters import (
    DOCLINES,
    ELOG,
    SOURCELINES,
    document_lines,
    event_records,
    source_lines,
    table,
)
from tidelog.plans.files_queries import json_documents
from tidelog.plans.registry import query
from tidelog.sources.files import explode_json_files, explode_lines
from tidelog.sources.scratch import scratch_path

LIMIT = 600
SOURCE_LIMIT = 20_000

_VALID = "upper(level) IN ('ERROR', 'WARN', 'INFO', 'DEBUG', 'TRACE', 'FATAL')"


def _walk_sql(lines: str, source: str, limit: int) -> str:
    """Sequential chunking as a recursive query over (file, line_no, n_bytes)."""
    return f"""WITH RECURSIVE {lines}, sized AS MATERIALIZED (SELECT file, line_no, n_bytes FROM {source}),
walk AS (
  SELECT file, line_no, n_bytes, n_bytes AS used, CAST(0 AS BIGINT) AS chunk_id FROM sized WHERE line_no = 1
  UNION ALL
  SELECT s.file, s.line_no, s.n_bytes, CASE WHEN w.used + s.n_bytes > {limit} THEN s.n_bytes ELSE w.used + s.n_bytes END,
         w.chunk_id + CASE WHEN w.used + s.n_bytes > {limit} THEN 1 ELSE 0 END
  FROM walk w JOIN sized s ON s.file = w.file AND s.line_no = w.line_no + 1)"""


@query("line_number", f"WITH {SOURCELINES} SELECT file, line_no, doc_id, doc_line FROM sourcelines")
def line_number(spark: SparkSession, directory: str) -> DataFrame:
    return source_lines(spark, directory).select("file", "line_no", "doc_id", "doc_line")


@query(
    "line_bytes",
    f"WITH {SOURCELINES} SELECT file, line_no, n_bytes, CAST(sum(n_bytes) OVER (PARTITION BY file ORDER BY line_no) AS BIGINT) AS running_bytes FROM sourcelines",
)
def line_bytes(spark: SparkSession, directory: str) -> DataFrame:
    return C.running_bytes(source_lines(spark, directory)).select("file", "line_no", "n_bytes", "running_bytes")


@query("chunk_next_fit", _walk_sql(DOCLINES, "doclines", LIMIT) + " SELECT file, line_no, chunk_id FROM walk")
def chunk_next_fit(spark: SparkSession, directory: str) -> DataFrame:
    return C.chunk_next_fit(document_lines(spark, directory), LIMIT).select("file", "line_no", "chunk_id")


@query(
    "chunk_next_fit_long_files",
    _walk_sql(SOURCELINES, "sourcelines", SOURCE_LIMIT) + " SELECT file, line_no, chunk_id FROM walk",
)
def chunk_next_fit_long_files(spark: SparkSession, directory: str) -> DataFrame:
    """Whole sources as files: many blocks per file, chunks that cross blocks."""
    lines = source_lines(spark, directory)
    return C.chunk_next_fit(lines, SOURCE_LIMIT, scratch_path(spark, "sizes")).select("file", "line_no", "chunk_id")


@query(
    "chunk_budget",
    f"WITH {SOURCELINES} SELECT file, line_no, CAST((sum(n_bytes) OVER (PARTITION BY file ORDER BY line_no) - n_bytes) AS BIGINT) // {SOURCE_LIMIT} AS chunk_id FROM sourcelines",
)
def chunk_budget(spark: SparkSession, directory: str) -> DataFrame:
    return C.chunk_budget(source_lines(spark, directory), SOURCE_LIMIT).select("file", "line_no", "chunk_id")


@query(
    "chunk_metadata",
    _walk_sql(DOCLINES, "doclines", LIMIT)
    + " SELECT file, chunk_id, CAST(sum(n_bytes) AS BIGINT) AS size_bytes, count(*) AS line_count, min(line_no) AS first_line, 'text' AS type FROM walk GROUP BY file, chunk_id",
)
def chunk_metadata(spark: SparkSession, directory: str) -> DataFrame:
    return C.chunk_metadata(C.chunk_spans(document_lines(spark, directory), LIMIT))


@query(
    "chunk_metadata_budget",
    f"WITH {DOCLINES}, placed AS (SELECT *, CAST(sum(n_bytes) OVER (PARTITION BY file ORDER BY line_no) - n_bytes AS BIGINT) // {LIMIT} AS chunk_id FROM doclines) "
    "SELECT file, chunk_id, CAST(sum(n_bytes) AS BIGINT) AS size_bytes, count(*) AS line_count, min(line_no) AS first_line, 'text' AS type FROM placed GROUP BY file, chunk_id",
)
def chunk_metadata_budget(spark: SparkSession, directory: str) -> DataFrame:
    return C.metadata_of_lines(C.chunk_budget(document_lines(spark, directory), LIMIT))


# Size of a line as a JSON string with ASCII escapes: quotes, backslashes and tabs take two bytes, other
# characters outside printable ASCII six.
_DUMP_SIZE = (
    "2 + length(regexp_replace(regexp_replace(line, '[\"\\\\\\t]', '__', 'g'), '[^ -~]', '______', 'g'))"
)
_ITEMS_SQL = f"""items AS (
  SELECT CAST(doc_id AS VARCHAR) AS file, i - 1 AS pos, CAST({_DUMP_SIZE} AS BIGINT) AS size FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
    FROM documents WHERE doc_id % 10 < 8 AND length(text) > 0)
  UNION ALL SELECT CAST(doc_id AS VARCHAR), 0, strlen('{{"id": ' || CAST(doc_id AS VARCHAR) || '}}') FROM documents WHERE doc_id % 10 = 8),
per_file AS (SELECT file, greatest(1, CAST(count(*) * {LIMIT} AS BIGINT) // CAST(sum(size) + 2 * count(*) AS BIGINT)) AS per_chunk FROM items GROUP BY file),
sliced AS (SELECT file, pos, size, pos // per_chunk AS chunk_id FROM items JOIN per_file USING (file))"""


def _json_items(spark: SparkSession, directory: str) -> DataFrame:
    return explode_json_files(json_documents(spark, directory), "file", "content", dumped=True).filter("problem is null")


@query(
    "chunk_json_items",
    f"WITH {_ITEMS_SQL} SELECT file, chunk_id, CAST(sum(size) + 2 * count(*) AS BIGINT) AS size_bytes, count(*) AS line_count, 'json' AS type FROM sliced GROUP BY file, chunk_id",
)
def chunk_json_items(spark: SparkSession, directory: str) -> DataFrame:
    return C.json_chunk_metadata(C.chunk_json_items(_json_items(spark, directory), LIMIT))


@query(
    "chunk_by_type",
    _walk_sql(DOCLINES + ", " + _ITEMS_SQL, "doclines", LIMIT)
    + """, formats AS (SELECT CAST(doc_id AS VARCHAR) AS file, CASE doc_id % 3 WHEN 0 THEN 'json' WHEN 1 THEN 'jsonl' ELSE 'plain_text' END AS file_type FROM documents)
SELECT w.file, chunk_id, count(*) AS line_count, CASE file_type WHEN 'jsonl' THEN 'jsonl' ELSE 'text' END AS type
  FROM walk w JOIN formats USING (file) WHERE file_type <> 'json' GROUP BY w.file, chunk_id, file_type
UNION ALL SELECT s.file, chunk_id, count(*), 'json' FROM sliced s JOIN formats USING (file) WHERE file_type = 'json' GROUP BY s.file, chunk_id""",
)
def chunk_by_type(spark: SparkSession, directory: str) -> DataFrame:
    doc = F.col("doc_id")
    formats = table(spark, directory, "documents").select(
        doc.cast("string").alias("file"),
        F.when(doc % 3 == 0, "json").when(doc % 3 == 1, "jsonl").otherwise("plain_text").alias("file_type"),
    )
    # Each format's files are read by its own reader only.
    json_files = json_documents(spark, directory).join(formats.filter("file_type = 'json'"), "file", "left_semi")
    items = explode_json_files(json_files, "file", "content", dumped=True).filter("problem is null")
    lines = document_lines(spark, directory).join(formats.filter("file_type <> 'json'"), "file", "left_semi")
    chunked = C.chunk_by_type(lines, items, formats, LIMIT, scratch_path(spark, "sizes"))
    return chunked.groupBy("file", "chunk_id", "type").agg(F.count("*").alias("line_count"))


@query(
    "reject_empty",
    "SELECT CAST(doc_id AS VARCHAR) AS file, 'no chunks' AS reject_reason FROM documents WHERE lang = 'es' OR length(text) = 0",
)
def reject_empty(spark: SparkSession, directory: str) -> DataFrame:
    """Documents of one language are emptied first, so that they yield no line."""
    docs = table(spark, directory, "documents").withColumn("text", F.when(F.col("lang") == "es", "").otherwise(F.col("text")))
    files = docs.select(F.col("doc_id").cast("string").alias("file"))
    return C.without_chunks(files, C.chunk_spans(explode_lines(docs, "doc_id", "text"), LIMIT))


# --- functions on chunks ----------------------------------------------------------------------------


def event_chunks(spark: SparkSession, directory: str) -> DataFrame:
    """Events as lines of 500-line chunks."""
    return event_records(spark, directory).select(
        "file",
        "chunk_id",
        F.col("pos").alias("line_no"),
        F.concat_ws("|", "timestamp", "level", "message").alias("line"),
        (F.octet_length(F.concat_ws("|", "timestamp", "level", "message")) + 1).cast("long").alias("n_bytes"),
        F.lit("text").alias("type"),
    )


_LINES_SQL = ELOG + """, lines AS (SELECT file, chunk_id, pos, level, "timestamp" || '|' || level || '|' || message AS line FROM elog)"""


def split_fields(chunk: dict) -> dict:
    """Chunk function of the `map_chunks` query: keeps ERROR lines, fails for some chunks."""
    if chunk["chunk_id"] % 7 == 3:
        raise ValueError(f"cannot read chunk {chunk['chunk_id']}")
    kept = [dict(zip(("timestamp", "level", "message"), line.split("|"))) for line in chunk["content"]]
    return {
        "cleaned_logs": [record for record in kept if record["level"] == "ERROR"],
        "tokens_used": chunk["size_bytes"] - chunk["line_count"],
    }


_MAPPED_SQL = f"""WITH {_LINES_SQL}, mapped AS (
  SELECT file, chunk_id, count(*) AS original_line_count,
    CASE WHEN chunk_id % 7 = 3 THEN 0 ELSE count(*) FILTER (level = 'ERROR') END AS cleaned_line_count,
    CASE WHEN chunk_id % 7 = 3 THEN 0 ELSE CAST(sum(strlen(line)) AS BIGINT) END AS tokens_used,
    chunk_id % 7 <> 3 AS success,
    CASE WHEN chunk_id % 7 = 3 THEN 'cannot read chunk ' || CAST(chunk_id AS VARCHAR) END AS error
  FROM lines GROUP BY file, chunk_id)"""


def _mapped(spark: SparkSession, directory: str) -> DataFrame:
    return M.map_chunks(event_chunks(spark, directory), split_fields)


@query("map_chunks", _MAPPED_SQL + " SELECT * FROM mapped")
def map_chunks(spark: SparkSession, directory: str) -> DataFrame:
    return _mapped(spark, directory).drop("cleaned", "processing_time_seconds")


@query("map_chunks_records", f"WITH {ELOG} SELECT file, chunk_id, \"timestamp\", level, message FROM elog WHERE level = 'ERROR' AND chunk_id % 7 <> 3")
def map_chunks_records(spark: SparkSession, directory: str) -> DataFrame:
    return M.result_records(_mapped(spark, directory)).select("file", "chunk_id", "timestamp", "level", "message")


def keep_members(chunk: dict) -> dict:
    """Chunk function with members beyond the standard fields, and results of a wrong shape for some chunks."""
    if chunk["chunk_id"] % 5 == 1:
        return None
    if chunk["chunk_id"] % 5 == 2:
        return {"cleaned_logs": ["no record"]}
    kept = [dict(zip(("timestamp", "level", "message"), line.split("|"))) for line in chunk["content"]]
    return {"cleaned_logs": [{**record, "size": {"chars": len(record["message"])}, "error": True} for record in kept], "tokens_used": None}


@query(
    "map_chunks_extra_keys",
    f"""WITH {ELOG} SELECT chunk_id, message, CAST(length(message) AS VARCHAR) AS chars, 'true' AS error, NULL::VARCHAR AS reason FROM elog WHERE chunk_id % 5 NOT IN (1, 2)
UNION ALL SELECT DISTINCT chunk_id, NULL, NULL, NULL, CASE WHEN chunk_id % 5 = 1 THEN 'a chunk function must return a dict, not NoneType' ELSE 'an entry must be a dict, not str' END FROM elog WHERE chunk_id % 5 IN (1, 2)""",
)
def map_chunks_extra_keys(spark: SparkSession, directory: str) -> DataFrame:
    """Members beyond the standard fields are read back from the whole record; malformed results are failed rows."""
    results = M.map_chunks(event_chunks(spark, directory), keep_members)
    whole = M.result_records(results).select(
        "chunk_id",
        "message",
        F.get_json_object("raw_data", "$.size.chars").alias("chars"),
        F.get_json_object("raw_data", "$.error").alias("error"),
        F.lit(None).cast("string").alias("reason"),
    )
    nothing = F.lit(None).cast("string")
    failed = M.split_results(results)[1]
    return whole.union(failed.select("chunk_id", nothing, nothing, nothing, "error"))


@query("capture_errors", _MAPPED_SQL + " SELECT file, chunk_id, error FROM mapped WHERE NOT success")
def capture_errors(spark: SparkSession, directory: str) -> DataFrame:
    return M.split_results(_mapped(spark, directory))[1].select("file", "chunk_id", "error")


@query(
    "split_ok_failed",
    _MAPPED_SQL + " SELECT count(*) FILTER (success) AS completed, count(*) FILTER (NOT success) AS failed FROM mapped",
)
def split_ok_failed(spark: SparkSession, directory: str) -> DataFrame:
    completed, failed = M.split_results(_mapped(spark, directory))
    return completed.unionByName(failed).agg(
        F.count_if("success").alias("completed"), F.count_if(~F.col("success")).alias("failed")
    )


@query(
    "chunk_payload",
    f"WITH {_LINES_SQL} SELECT file, chunk_id, 'text' AS type, count(*) AS line_count, md5(string_agg(line, chr(10) ORDER BY pos)) AS payload_md5 FROM lines GROUP BY file, chunk_id",
)
def chunk_payload(spark: SparkSession, directory: str) -> DataFrame:
    payloads = M.chunk_payloads(event_chunks(spark, directory))
    return payloads.select("file", "chunk_id", "type", "line_count", F.md5("payload").alias("payload_md5"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(
    "render_prompt",
    f"WITH {_LINES_SQL} SELECT file, chunk_id, md5(CASE WHEN chunk_id % 2 = 0 THEN {_quoted(M.STRUCTURED_INSTRUCTION)} ELSE {_quoted(M.TEXT_INSTRUCTION)} END "
    "|| string_agg(line, chr(10) ORDER BY pos)) AS prompt_md5 FROM lines GROUP BY file, chunk_id",
)
def render_prompt(spark: SparkSession, directory: str) -> DataFrame:
    typed = event_chunks(spark, directory).withColumn("type", F.when(F.col("chunk_id") % 2 == 0, "jsonl").otherwise("text"))
    prompts = M.render_prompts(M.chunk_payloads(typed))
    return prompts.select("file", "chunk_id", F.md5("prompt").alias("prompt_md5"))


def stub_scorer():
    """Deterministic stand-in for a model: answers the chunk's lines as JSON, refuses some chunks."""
    import json

    def score(prompt: str) -> tuple[str, int]:
        lines = prompt.split("\n\n", 1)[1].split("\n")
        if "|WARN|" in lines[0]:
            raise RuntimeError("refused")
        answer = json.dumps([dict(zip(("timestamp", "level", "message"), line.split("|"))) for line in lines])
        return f"```json\n{answer}\n```", len(lines)

    return score


def _answers(spark: SparkSession, directory: str) -> DataFrame:
    return M.infer_chunks(M.render_prompts(M.chunk_payloads(event_chunks(spark, directory))), stub_scorer)


_OUTCOME_SQL = f"""WITH {_LINES_SQL}, outcome AS (SELECT file, chunk_id, arg_min(level, pos) <> 'WARN' AS success, count(*) AS n,
      count(*) FILTER ({_VALID}) AS valid FROM lines GROUP BY file, chunk_id)
SELECT file, chunk_id, n AS original_line_count, CASE WHEN success THEN valid ELSE 0 END AS cleaned_line_count,
  CASE WHEN success THEN n ELSE 0 END AS tokens_used, success, CASE WHEN NOT success THEN 'refused' END AS error FROM outcome"""


@query("infer_resumable", _OUTCOME_SQL)
def infer_resumable(spark: SparkSession, directory: str) -> DataFrame:
    """Answers kept by prompt: a first run over the chunks of even number, then one over all."""
    path = scratch_path(spark, "answers")
    prompts = M.render_prompts(M.chunk_payloads(event_chunks(spark, directory)))
    scoring.infer_resumable(prompts.where("chunk_id % 2 = 0"), stub_scorer, path, attempts=1)
    answers = scoring.infer_resumable(prompts, stub_scorer, path, attempts=1)
    return M.answers_to_results(answers).drop("processing_time_seconds")


@query("infer_chunks", _OUTCOME_SQL)
def infer_chunks(spark: SparkSession, directory: str) -> DataFrame:
    return M.answers_to_results(_answers(spark, directory)).drop("processing_time_seconds")


# Answers assembled per chunk: fenced, plain, one object only, or not JSON at all.
@query(
    "parse_model_json",
    f"""WITH {ELOG}, shaped AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY pos) - 1 AS entry_pos FROM elog)
SELECT file, chunk_id, entry_pos AS pos, "timestamp", level, message, service FROM shaped
WHERE {_VALID} AND chunk_id % 4 <> 3 AND (chunk_id % 4 <> 2 OR entry_pos = 0)""",
)
def parse_model_json(spark: SparkSession, directory: str) -> DataFrame:
    records = event_records(spark, directory)
    entry = F.to_json(F.struct("timestamp", "level", "message", "service"))
    grouped = records.groupBy("file", "chunk_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", entry.alias("entry")))).alias("_entries")
    )
    listed = F.array_join(F.transform("_entries", lambda x: x["entry"]), ",")
    shape = F.col("chunk_id") % 4
    response = (
        F.when(shape == 0, F.concat(F.lit("```json\n["), listed, F.lit("]\n```\n")))
        .when(shape == 1, F.concat(F.lit("\n [7, "), listed, F.lit(", null] ")))
        .when(shape == 2, F.get("_entries", 0)["entry"])
        .otherwise(F.concat(F.lit("Here are the logs: ["), listed, F.lit("]")))
    )
    answers = grouped.select("file", "chunk_id", response.alias("response"), F.lit(True).alias("success"))
    entries = M.answers_to_entries(answers)
    place = F.when(F.col("chunk_id") % 4 == 1, F.col("pos") - 1).otherwise(F.col("pos"))
    return entries.select("file", "chunk_id", place.alias("pos"), "timestamp", "level", "message", "service")


@query(
    "count_in_out",
    f"WITH {ELOG} SELECT file, chunk_id, count(*) AS original_line_count, count(*) FILTER ({_VALID}) AS cleaned_line_count FROM elog GROUP BY file, chunk_id",
)
def count_in_out(spark: SparkSession, directory: str) -> DataFrame:
    return M.count_in_out(event_records(spark, directory), record_problem().isNull())
