"""Manifest, admission, format detection and readers over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions.json_values import field_text
from tidelog.plans.adapters import DOCFILES, DOCLINES, document_files, document_lines, table
from tidelog.plans.registry import query
from tidelog.sources import files as S
from tidelog.sources import json_splits
from tidelog.sources.scratch import scratch_path

MAX_BYTES = 4000

_SUFFIX_SQL = """CASE WHEN lower(original_name) LIKE '%.jsonl' THEN 'jsonl' WHEN lower(original_name) LIKE '%.json' THEN 'json'
       WHEN lower(original_name) LIKE '%.log' THEN 'plain_text' END"""
_PLAIN_ID_SQL = "strftime(upload_time, '%Y%m%d_%H%M%S') || '_' || original_name"

_MANIFEST_SQL = (
    f"WITH {DOCFILES}, manifest AS (SELECT {_PLAIN_ID_SQL} || '_' || left(md5(path), 8) AS file_id, original_name, "
    f"coalesce({_SUFFIX_SQL}, 'plain_text') AS file_type, size_bytes, path, "
    "strftime(upload_time, '%Y-%m-%d %H:%M:%S') AS upload_time, 'uploaded' AS status FROM docfiles) "
)


def _shown(files: DataFrame) -> DataFrame:
    return files.withColumn("upload_time", F.date_format("upload_time", "yyyy-MM-dd HH:mm:ss"))


@query("manifest", _MANIFEST_SQL + "SELECT * FROM manifest")
def manifest(spark: SparkSession, directory: str) -> DataFrame:
    return _shown(S.manifest(document_files(spark, directory)))


_GATE_SQL = (
    f"WITH {DOCFILES} SELECT path, original_name, size_bytes, CASE WHEN original_name = '' THEN 'no file name' "
    f"WHEN size_bytes > {MAX_BYTES} THEN 'file too large' END AS reject_reason FROM docfiles"
)


@query("size_gate", _GATE_SQL)
def size_gate(spark: SparkSession, directory: str) -> DataFrame:
    files = S.with_admission(document_files(spark, directory), MAX_BYTES)
    return files.select("path", "original_name", "size_bytes", "reject_reason")


@query("name_gate", f"WITH {DOCFILES} SELECT path FROM docfiles WHERE original_name = ''")
def name_gate(spark: SparkSession, directory: str) -> DataFrame:
    return S.quarantined(document_files(spark, directory)).filter("reject_reason = 'no file name'").select("path")


@query(
    "accept_glob",
    f"WITH {DOCFILES} SELECT path, original_name FROM docfiles WHERE regexp_matches(lower(original_name), '[.](json|jsonl|log|txt)$')",
)
def accept_glob(spark: SparkSession, directory: str) -> DataFrame:
    files = document_files(spark, directory)
    return files.filter(S.accepts_name(F.col("original_name"))).select("path", "original_name")


_KNOWN_FILE = "20240101_000647_doc-11.JSON_3cdc2e36"


@query("manifest_lookup", _MANIFEST_SQL + f"SELECT * FROM manifest WHERE file_id = '{_KNOWN_FILE}'")
def manifest_lookup(spark: SparkSession, directory: str) -> DataFrame:
    return _shown(S.find_file(S.manifest(document_files(spark, directory)), _KNOWN_FILE))


@query("list_files", _MANIFEST_SQL + "SELECT file_id, upload_time FROM manifest ORDER BY upload_time, file_id")
def list_files(spark: SparkSession, directory: str) -> DataFrame:
    return _shown(S.list_files(S.manifest(document_files(spark, directory)))).select("file_id", "upload_time")


@query("latest_file", _MANIFEST_SQL + "SELECT * FROM manifest ORDER BY upload_time DESC, file_id LIMIT 1")
def latest_file(spark: SparkSession, directory: str) -> DataFrame:
    return _shown(S.latest_file(S.manifest(document_files(spark, directory))))


@query(
    "make_file_id",
    f"WITH {DOCFILES}, named AS (SELECT doc_id, path, upload_time, strftime(date_trunc('hour', upload_time), '%Y%m%d_%H%M%S') "
    "|| '_' || CAST(doc_id % 50 AS VARCHAR) || '.log' AS file_id FROM docfiles) "
    "SELECT file_id, path FROM named QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY upload_time DESC, path) = 1",
)
def make_file_id(spark: SparkSession, directory: str) -> DataFrame:
    name = F.concat((F.col("doc_id") % 50).cast("string"), F.lit(".log"))
    files = document_files(spark, directory).withColumn(
        "file_id", S.make_file_id(F.date_trunc("hour", "upload_time"), name)
    )
    return S.last_upload_wins(files).select("file_id", "path")


# Contents that exercise each detection rule: prose, JSON lines, a bracket, one JSON line only, numbers.
_HEAD_SQL = """heads AS (
  SELECT doc_id, 'docs/' || CAST(doc_id AS VARCHAR) AS path,
         CASE WHEN doc_id % 13 = 0 THEN 'x.Log' WHEN doc_id % 13 = 1 THEN 'x.JSONL' ELSE 'x.txt' END AS original_name,
         CASE doc_id % 7
           WHEN 0 THEN text
           WHEN 1 THEN '{"a": 1}' || chr(10) || chr(10) || ' {"b": [2]} ' || chr(10) || text
           WHEN 2 THEN '  [2024-01-01] ' || text
           WHEN 3 THEN '{"a": 1}' || chr(10) || text
           WHEN 4 THEN '1' || chr(10) || '2' || chr(10) || text
           WHEN 5 THEN chr(10) || '[{"a": 1}]' || text
           ELSE '{"a": "' || repeat('x', 990) || '"}' || chr(10) || '{"b": 1}' || chr(10) || '{"c": 1}' END AS head
  FROM documents),
lines AS (
  SELECT path, trim(u.line, ' ' || chr(9) || chr(13)) AS line, u.i
  FROM (SELECT path, string_split({prefix}, chr(10))[1:5] AS parts FROM heads) p,
       LATERAL (SELECT unnest(parts) AS line, generate_subscripts(parts, 1) AS i) u),
tested AS (
  SELECT path, i, CASE WHEN json_valid(line) {strict} THEN 1 ELSE 0 END AS ok FROM lines WHERE line <> ''),
runs AS (SELECT path, count(*) FILTER (bad = 0) AS n_json FROM (
  SELECT path, sum(1 - ok) OVER (PARTITION BY path ORDER BY i) AS bad FROM tested) GROUP BY path)
SELECT h.path, CASE WHEN lower(original_name) LIKE '%.jsonl' THEN 'jsonl' WHEN lower(original_name) LIKE '%.json' THEN 'json'
    WHEN lower(original_name) LIKE '%.log' THEN 'plain_text'
    WHEN regexp_matches(head, '{bracket}') THEN 'json'
    WHEN coalesce(n_json, 0) >= 2 THEN 'jsonl' ELSE 'plain_text' END AS file_type
FROM heads h LEFT JOIN runs r USING (path)"""


def _heads(spark: SparkSession, directory: str) -> DataFrame:
    doc, text = F.col("doc_id"), F.col("text")
    kind = doc % 7
    return table(spark, directory, "documents").select(
        F.concat(F.lit("docs/"), doc.cast("string")).alias("path"),
        F.when(doc % 13 == 0, "x.Log").when(doc % 13 == 1, "x.JSONL").otherwise("x.txt").alias("original_name"),
        F.when(kind == 0, text)
        .when(kind == 1, F.concat(F.lit('{"a": 1}\n\n {"b": [2]} \n'), text))
        .when(kind == 2, F.concat(F.lit("  [2024-01-01] "), text))
        .when(kind == 3, F.concat(F.lit('{"a": 1}\n'), text))
        .when(kind == 4, F.concat(F.lit("1\n2\n"), text))
        .when(kind == 5, F.concat(F.lit('\n[{"a": 1}]'), text))
        .otherwise(F.lit('{"a": "' + "x" * 990 + '"}\n{"b": 1}\n{"c": 1}'))
        .alias("head"),
        F.lit(True).alias("valid_utf8"),
    )


def _detection_sql(compat: bool) -> str:
    values = {
        "{prefix}": "left(head, 1000)" if compat else "head",
        "{strict}": "" if compat else "AND line LIKE '{%'",
        "{bracket}": r"^\s*\[" if compat else r'^\s*\[\s*[\[\]{"]',
    }
    sql = "WITH " + _HEAD_SQL
    for name, value in values.items():
        sql = sql.replace(name, value)
    return sql


@query("detect_format", _detection_sql(False))
def detect_format(spark: SparkSession, directory: str) -> DataFrame:
    return S.sniff_formats(_heads(spark, directory))


@query("detect_format_compat", _detection_sql(True))
def detect_format_compat(spark: SparkSession, directory: str) -> DataFrame:
    return S.sniff_formats(_heads(spark, directory), compat=True)


@query(
    "read_whole_file",
    "SELECT CAST(sum(strlen(text) + 1) AS BIGINT) AS n_bytes, CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS n_newlines "
    "FROM documents",
)
def read_whole_file(spark: SparkSession, directory: str) -> DataFrame:
    """Documents written as text files and read back one row per file."""
    path = scratch_path(spark, "whole")
    table(spark, directory, "documents").select("text").write.text(path)
    content = F.col("content")
    whole = S.read_whole_files(spark, path)
    return whole.agg(
        F.sum(F.octet_length(content).cast("long")).alias("n_bytes"),
        F.sum((F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))).cast("long")).alias("n_newlines"),
    )


@query(
    "scan_lines",
    f"WITH {DOCLINES} SELECT doc_id, line_no AS doc_line, line, CAST(strlen(line) + strlen(CAST(doc_id AS VARCHAR)) "
    "+ strlen(CAST(line_no AS VARCHAR)) + 3 AS BIGINT) AS n_bytes, true AS in_order FROM doclines",
)
def scan_lines(spark: SparkSession, directory: str) -> DataFrame:
    """Document lines written as text files, read back and numbered.

    Each written line names its document and place, so the numbering can be checked: within a
    document numbers rise by one from line to line.
    """
    path = scratch_path(spark, "lines")
    lines = document_lines(spark, directory).select(F.col("file").cast("long").alias("doc_id"), "line_no", "line")
    (
        lines.repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "line_no")
        .select(F.concat_ws("\t", "doc_id", "line_no", "line").alias("value"))
        .write.option("compression", "none")
        .text(path)
    )
    scanned = S.scan_lines(spark, path)
    parts = F.split("line", "\t", 3)
    placed = scanned.select(
        "line_no",
        "n_bytes",
        F.get(parts, 0).cast("long").alias("doc_id"),
        F.get(parts, 1).cast("long").alias("doc_line"),
        F.get(parts, 2).alias("line"),
    )
    document = Window.partitionBy("doc_id")
    return placed.select(
        "doc_id",
        "doc_line",
        "line",
        "n_bytes",
        (F.col("line_no") - F.min("line_no").over(document) + 1 == F.col("doc_line")).alias("in_order"),
    )


@query("explode_lines", f"WITH {DOCLINES} SELECT file, line_no, line FROM doclines")
def explode_lines(spark: SparkSession, directory: str) -> DataFrame:
    return document_lines(spark, directory).select("file", "line_no", "line")


@query(
    "strip_lines",
    f"WITH {DOCLINES} SELECT file, line_no, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line FROM doclines",
)
def strip_lines(spark: SparkSession, directory: str) -> DataFrame:
    """Every line gets outer whitespace of several kinds first."""
    padded = document_lines(spark, directory).withColumn(
        "line",
        F.when(F.col("line_no") % 3 == 0, F.concat(F.lit(" \t"), "line", F.lit("　\r")))
        .when(F.col("line_no") % 3 == 1, F.concat(F.lit("\x1c\xa0"), "line", F.lit(" \x85")))
        .otherwise(F.col("line")),
    )
    return S.stripped(padded).select("file", "line_no", "line")


_JSON_LINE_SQL = """SELECT event_id AS line_no, event_id % 11 <> 0 AS is_json,
  CASE WHEN event_id % 11 <> 0 THEN CAST(json_extract(props, '$.k') AS VARCHAR) END AS k,
  CASE WHEN event_id % 11 <> 0 THEN event_type END AS kind FROM events"""


@query("scan_jsonl", _JSON_LINE_SQL)
def scan_jsonl(spark: SparkSession, directory: str) -> DataFrame:
    """Event lines as JSON; one in eleven is broken in one of several ways."""
    number = F.col("event_id")
    good = F.concat(F.lit(' {"kind":"'), F.col("event_type"), F.lit('",'), F.substring("props", F.lit(2), F.length("props")))
    bad = (
        F.when(number % 3 == 0, F.concat(good, F.lit(" x")))
        .when(number % 3 == 1, F.concat(good, F.lit(" {}")))
        .otherwise(F.lit("{'kind':'view'}"))
    )
    lines = table(spark, directory, "events").select(
        number.alias("line_no"), F.when(number % 11 == 0, bad).otherwise(good).alias("line")
    )
    parsed = S.parse_jsonl(lines)
    return parsed.select(
        "line_no",
        F.col("doc").isNotNull().alias("is_json"),
        field_text(F.col("doc"), "k").alias("k"),
        field_text(F.col("doc"), "kind").alias("kind"),
    )


def json_documents(spark: SparkSession, directory: str) -> DataFrame:
    """Documents as JSON files: arrays of their lines, some single objects, some broken."""
    doc = F.col("doc_id")
    return table(spark, directory, "documents").select(
        doc.cast("string").alias("file"),
        F.when(doc % 10 == 9, '[{"a":1},')
        .when(doc % 10 == 8, F.concat(F.lit('{"id":'), doc.cast("string"), F.lit("}")))
        .when(F.length("text") == 0, "[]")
        .otherwise(F.to_json(F.split("text", "\n")))
        .alias("content"),
    )


_JSON_FILE_SQL = """SELECT CAST(doc_id AS VARCHAR) AS file, CAST(NULL AS BIGINT) AS pos, NULL AS raw, 'Invalid JSON file' AS problem
  FROM documents WHERE doc_id % 10 = 9
UNION ALL SELECT CAST(doc_id AS VARCHAR), 0, '{"id":' || CAST(doc_id AS VARCHAR) || '}', NULL FROM documents WHERE doc_id % 10 = 8
UNION ALL SELECT CAST(doc_id AS VARCHAR), i - 1, line, NULL FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE doc_id % 10 < 8 AND length(text) > 0)"""


@query("scan_json_array", _JSON_FILE_SQL)
def scan_json_array(spark: SparkSession, directory: str) -> DataFrame:
    rows = S.explode_json_files(json_documents(spark, directory), "file", "content")
    return rows.select("file", "pos", "raw", "problem")


_ARRAY_FILES = 8
_ARRAY_SQL = f"""SELECT doc_id % {_ARRAY_FILES} AS bucket, CAST(row_number() OVER (PARTITION BY doc_id % {_ARRAY_FILES} ORDER BY doc_id) - 1 AS BIGINT) AS pos,
  doc_id, text, len(string_split(text, ',')) AS n_parts, CAST(NULL AS VARCHAR) AS problem FROM documents WHERE doc_id % {_ARRAY_FILES} < {_ARRAY_FILES - 1}
UNION ALL SELECT {_ARRAY_FILES - 1}, NULL, NULL, NULL, NULL, 'Invalid JSON file'"""


# A task writes about this much text of an array; larger arrays lie in several part files of a folder.
_PART_BYTES = 64 << 20


def write_json_arrays(documents: DataFrame, path: str, files: int, part_bytes: int = _PART_BYTES) -> None:
    """All documents as a few large arrays, each in the part files of a folder; the last array lacks its closing bracket."""
    bucket = (F.col("doc_id") % files).alias("bucket")
    element = F.to_json(F.struct("doc_id", "text", F.split("text", ",").alias("parts")))
    rows = documents.select("doc_id", bucket, element.alias("element"))
    ends = documents.groupBy(bucket).agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.sum(F.coalesce(2 * F.octet_length("text"), F.lit(0)).cast("long")).alias("bytes")
    ).collect()
    tasks = sum(max(1, -(-end["bytes"] // part_bytes)) for end in ends)
    marks = documents.sparkSession.createDataFrame([(e["bucket"], e["first"], e["last"]) for e in ends], "bucket long, first long, last long")
    opening = F.when(F.col("doc_id") == F.col("first"), "[").otherwise("")
    closing = F.when(F.col("doc_id") < F.col("last"), ",").when(F.col("bucket") < files - 1, "]").otherwise("")
    marked = rows.join(F.broadcast(marks), "bucket").select("bucket", "doc_id", F.concat(opening, "element", closing).alias("value"))
    # Ranges follow each other as the names of the part files do.
    marked.repartitionByRange(tasks, "bucket", "doc_id").sortWithinPartitions("bucket", "doc_id").drop("doc_id").write.partitionBy("bucket").text(path)


@query("scan_json_splits", _ARRAY_SQL)
def scan_json_splits(spark: SparkSession, directory: str) -> DataFrame:
    """All documents in a few array files, read back in chunks of a few KB."""
    path = scratch_path(spark, "json-arrays")
    write_json_arrays(table(spark, directory, "documents"), path, _ARRAY_FILES)
    rows = json_splits.scan_json_splits(spark, path, "*.txt", chunk_bytes=16 << 10, folders=True)
    doc = F.variant_get("doc", "$", "struct<doc_id:bigint,text:string,parts:array<string>>")
    bucket = F.regexp_extract("file", "bucket=([0-9]+)", 1).cast("long").alias("bucket")
    shown = rows.select(bucket, "pos", doc.alias("d"), "problem")
    return shown.select("bucket", "pos", "d.doc_id", "d.text", F.when(F.col("d").isNotNull(), F.size("d.parts")).cast("long").alias("n_parts"), "problem")


@query(
    "valid_utf8",
    f"WITH {DOCLINES} SELECT file, count(*) AS good_lines, CAST(0 AS BIGINT) AS bad_lines FROM doclines GROUP BY file",
)
def valid_utf8(spark: SparkSession, directory: str) -> DataFrame:
    good, bad = S.valid_text(document_lines(spark, directory))
    return good.groupBy("file").agg(F.count("*").alias("good_lines")).join(
        bad.groupBy("file").agg(F.count("*").alias("bad_lines")), "file", "left"
    ).fillna(0, ["bad_lines"])


@query(
    "list_directory",
)
def list_directory(spark: SparkSession, directory: str) -> DataFrame:
    """Manifest of the table files themselves, from the directory listing."""
    return S.manifest(S.list_directory(spark, directory, "*.parquet")).select("original_name", "file_type", "size_bytes")
