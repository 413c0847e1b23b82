"""File manifest, admission rules, format detection and line / JSON readers.

Manifest operators work on any frame with `original_name` and `size_bytes`, so they serve a
directory listing as well as a table in which every row is a file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions.json_values import as_list, dumps, loads_ok, parse_json, parse_json_array
from tidelog.functions.text import strip, unix_newlines

# Accepted extensions, size limit, sniffing window.
EXTENSIONS = ("json", "jsonl", "log", "txt")
MAX_FILE_BYTES = 500 * 1024 * 1024
SNIFF_CHARS = 1000
SNIFF_LINES = 5
MIN_JSON_LINES = 2

# Suffix -> format.
SUFFIX_FORMATS = {".jsonl": "jsonl", ".json": "json", ".log": "plain_text"}


# The accepted names as a path filter, in any letter case.
ACCEPTED_GLOB = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in name) for name in EXTENSIONS) + "}"


# --- manifest -----------------------------------------------------------------------------------


def list_directory(spark: SparkSession, path: str, glob: str = ACCEPTED_GLOB, include_empty: bool = False) -> DataFrame:
    """One row per accepted file, from the listing alone (file contents are not read).

    Spark leaves files of zero bytes out of a scan; include_empty=True adds them from the names the
    driver has listed anyway, with no upload time.
    """
    found = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    listing = found.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("upload_time"))
    if include_empty:
        every = spark.createDataFrame([(name,) for name in found.inputFiles()], "path string")
        # Listed names are URIs ("file:///a"), scanned paths are not ("file:/a").
        every = every.select(F.regexp_replace("path", "^file:/+", "file:/").alias("path"))
        empty = every.join(listing, "path", "left_anti")
        listing = listing.unionByName(empty.withColumn("size_bytes", F.lit(0).cast("long")), allowMissingColumns=True)
    return listing.select("path", F.element_at(F.split("path", "/"), -1).alias("original_name"), "size_bytes", "upload_time")


def refused_files(spark: SparkSession, path: str, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Files below `path` that the readers leave out, with the reason: another extension, no name, or too large.

    From the listing alone; together with the admitted ones these are all files that hold anything.
    """
    every = with_admission(list_directory(spark, path, "*"), max_bytes)
    reason = F.coalesce("reject_reason", F.when(~accepts_name(F.col("original_name")), F.lit("extension not accepted")))
    return every.withColumn("reject_reason", reason).filter("reject_reason is not null")


def make_file_id(upload_time: Column, name: Column) -> Column:
    return F.concat_ws("_", F.date_format(upload_time, "yyyyMMdd_HHmmss"), name)


def manifest(files: DataFrame, formats: DataFrame | None = None, unique_ids: bool = True) -> DataFrame:
    """File rows with id, format and status. `formats` is the output of `detect_formats`.

    Ids carry a path hash by default, because second resolution alone lets two uploads of one name
    collide; `unique_ids=False` gives the plain time-and-name id.
    """
    if formats is None:
        typed = files.withColumn("file_type", suffix_format(F.col("original_name")))
    else:
        typed = files.join(formats.select("path", "file_type"), "path", "left")
    plain = make_file_id(F.col("upload_time"), F.col("original_name"))
    file_id = F.concat_ws("_", plain, F.substring(F.md5("path"), 1, 8)) if unique_ids else plain
    return typed.select(
        file_id.alias("file_id"),
        "original_name",
        F.coalesce("file_type", F.lit("plain_text")).alias("file_type"),
        "size_bytes",
        "path",
        "upload_time",
        F.lit("uploaded").alias("status"),
    )


def with_admission(files: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Adds `reject_reason`: empty name or size above the limit; NULL means admitted."""
    return files.withColumn(
        "reject_reason",
        F.when(F.length(F.coalesce("original_name", F.lit(""))) == 0, F.lit("no file name")).when(
            F.col("size_bytes") > max_bytes, F.lit("file too large")
        ),
    )


def admitted(files: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    return with_admission(files, max_bytes).filter(F.col("reject_reason").isNull()).drop("reject_reason")


def quarantined(files: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    return with_admission(files, max_bytes).filter(F.col("reject_reason").isNotNull())


def accepts_name(name: Column) -> Column:
    """Column form of the accept glob."""
    return F.lower(name).rlike(rf"\.({'|'.join(EXTENSIONS)})$")


def last_upload_wins(files: DataFrame) -> DataFrame:
    """Of several uploads with one id only the latest stays."""
    newest_first = Window.partitionBy("file_id").orderBy(F.desc("upload_time"), F.asc("path"))
    return files.withColumn("_rank", F.row_number().over(newest_first)).filter("_rank = 1").drop("_rank")


def list_files(files: DataFrame) -> DataFrame:
    return files.orderBy("upload_time", "file_id")


def find_file(files: DataFrame, file_id: str) -> DataFrame:
    """The manifest row of one file (lazy; an unknown id gives no row)."""
    return files.filter(F.col("file_id") == F.lit(file_id))


def file_info(files: DataFrame, file_id: str) -> dict:
    """Driver-side lookup of one manifest row; unknown ids raise KeyError."""
    found = find_file(files, file_id).head(1)
    if not found:
        raise KeyError(f"unknown file: {file_id}")
    return found[0].asDict()


def latest_file(files: DataFrame) -> DataFrame:
    """The most recent upload; ties go to the smallest id."""
    return files.orderBy(F.desc("upload_time"), F.asc("file_id")).limit(1)


def read_whole_files(spark: SparkSession, path: str | list[str], glob: str = ACCEPTED_GLOB) -> DataFrame:
    """One row per file with its full text. Meant for files inside the admission limit."""
    return (
        spark.read.option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    )


# --- format detection ---------------------------------------------------------------------------


def suffix_format(name: Column) -> Column:
    """Format by case-insensitive suffix; NULL when the suffix decides nothing."""
    lowered = F.lower(name)
    result = F.when(F.lit(False), F.lit(""))
    for suffix, label in SUFFIX_FORMATS.items():
        result = result.when(F.endswith(lowered, F.lit(suffix)), F.lit(label))
    return result




def sniff_formats(heads: DataFrame, compat: bool = False) -> DataFrame:
    """`file_type` for rows of (path, original_name, head, valid_utf8).

    `head` is the start of the file split at LF only. compat=True looks at the first 1000
    characters: a leading '[' means json, and two or more JSON lines before the first bad one mean
    jsonl. The default looks at the first five whole lines, asks for objects, and takes '[' as json
    only when JSON can follow it, so '[2024-..] text' stays plain text.
    """
    prefix = F.left("head", F.lit(SNIFF_CHARS)) if compat else F.col("head")
    body = strip(prefix)
    lines = F.slice(F.split(prefix, "\n"), 1, SNIFF_LINES)
    bracket = body.startswith("[")
    if not compat:
        bracket = bracket & body.rlike(r'^\[\s*[\[\]{"]')
    staged = heads.select(
        "path",
        suffix_format(F.col("original_name")).alias("_by_suffix"),
        F.coalesce("valid_utf8", F.lit(True)).alias("_valid"),
        F.coalesce(bracket, F.lit(False)).alias("_bracket"),
        F.filter(F.transform(lines, strip), lambda line: line != "").alias("_lines"),
    )
    # Up to five short columns, so that one Arrow round trip tests all head lines of a file.
    accepted = []
    for index in range(SNIFF_LINES):
        line = F.get("_lines", index)
        ok = loads_ok(line)
        accepted.append(ok if compat else ok & F.coalesce(line.startswith("{"), F.lit(False)))
    tested = staged.select("*", *[ok.alias(f"_ok{index}") for index, ok in enumerate(accepted)])
    run, unbroken = F.lit(0), F.lit(True)
    for index in range(SNIFF_LINES):
        unbroken = unbroken & F.col(f"_ok{index}")
        run = run + unbroken.cast("int")
    return tested.select(
        "path",
        F.coalesce(
            "_by_suffix",
            F.when(~F.col("_valid"), F.lit("plain_text"))
            .when(F.col("_bracket"), F.lit("json"))
            .when(run >= MIN_JSON_LINES, F.lit("jsonl"))
            .otherwise(F.lit("plain_text")),
        ).alias("file_type"),
    )


def detect_formats(spark: SparkSession, path: str, compat: bool = False, glob: str = ACCEPTED_GLOB) -> DataFrame:
    """(path, file_type) for every accepted file below `path`.

    Files with a known suffix are decided from the listing. The others are scanned once for UTF-8
    validity; only their first lines are kept, and those are cut, so a group stays small.
    """
    listing = list_directory(spark, path, glob)
    known = listing.select("path", suffix_format(F.col("original_name")).alias("file_type")).filter("file_type is not null")
    undecided = suffix_format(F.col("_metadata.file_name")).isNull()
    rows = (
        spark.read.option("lineSep", "\n")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .text(path)
        .filter(undecided)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_seq"),
            "value",
        )
    )
    first = rows.filter("_block = 0").groupBy("path").agg(F.min("_seq").alias("_first"))
    keep = SNIFF_CHARS if compat else SNIFF_LINES - 1
    text = F.left("value", F.lit(SNIFF_CHARS)) if compat else F.col("value")
    head_lines = (
        rows.filter("_block = 0")
        .join(first, "path")
        .filter(F.col("_seq") - F.col("_first") <= keep)
        .groupBy("path")
        .agg(F.array_sort(F.collect_list(F.struct("_seq", text.alias("value")))).alias("_head"))
        .select("path", F.array_join(F.transform("_head", lambda x: x["value"]), "\n").alias("head"))
    )
    validity = rows.groupBy("path").agg(F.bool_and(F.is_valid_utf8("value")).alias("valid_utf8"))
    heads = (
        listing.filter(suffix_format(F.col("original_name")).isNull())
        .select("path", "original_name")
        .join(validity, "path", "left")
        .join(head_lines, "path", "left")
        .withColumn("head", F.coalesce("head", F.lit("")))
    )
    return known.unionByName(sniff_formats(heads, compat))


# --- lines --------------------------------------------------------------------------------------
#
# Line frames have (file, block, block_off, blocks, line_no, line, n_bytes): `block` cuts a file into
# contiguous bounded pieces, `block_off` is the number of bytes before the piece, `blocks` the number
# of pieces of the file.


def text_rows(reader, path: str | list[str], glob: str = ACCEPTED_GLOB) -> DataFrame:
    """Rows of text files split at LF only, with file, split offset and file size.

    `reader` is `spark.read` or `spark.readStream`.
    """
    return (
        reader.option("lineSep", "\n")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.col("_metadata.file_size").alias("file_size"),
            "value",
        )
    )


def number_rows(rows: DataFrame) -> DataFrame:
    """Line frame of `text_rows`: CRLF and CR are resolved, lines numbered, bytes counted.

    A block is one file split. The position inside a split is the scan order, so the text is not
    shuffled to be numbered; one small row per split is aggregated and joined back (the scan
    assigns the same order each time it runs over one listing).
    """
    value = F.col("value")
    pieces = F.when(~F.contains(value, F.lit("\r")), F.array(value)).otherwise(
        F.split(F.regexp_replace(value, r"\r\z", ""), "\r")
    )
    raw = (
        rows.select("file", "block", "file_size", value.endswith("\r").alias("_carriage"), pieces.alias("_pieces"))
        .withColumn("_n", F.size("_pieces"))
        .select("file", "block", "file_size", "_carriage", "_n", F.posexplode("_pieces").alias("_at", "line"))
        .select(
            "file",
            "block",
            "file_size",
            ((F.col("_at") == F.col("_n") - 1) & F.col("_carriage")).alias("_tail_cr"),
            "line",
            F.monotonically_increasing_id().alias("_seq"),
        )
    )
    size = F.octet_length("line").cast("long") + 1
    splits = raw.groupBy("file", "block").agg(
        F.min("_seq").alias("_first_seq"),
        F.count("*").alias("_lines"),
        F.sum(size).alias("_bytes"),
        F.sum(size + F.col("_tail_cr").cast("long")).alias("_raw_bytes"),
        F.max_by("_tail_cr", "_seq").alias("_ends_cr"),
        F.first("file_size").alias("file_size"),
    )
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    # The excess over the file size is 1 when no newline ends the file (a dropped UTF-8 mark shifts it by 3).
    unterminated = (F.pmod(F.sum("_raw_bytes").over(whole) - F.col("file_size"), F.lit(3)) == 1) & ~F.col("_ends_cr")
    is_last = F.col("block") == F.max("block").over(whole)
    offsets = splits.select(
        "file",
        "block",
        "_first_seq",
        F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_lines_before"),
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("block_off"),
        F.count("*").over(whole).alias("blocks"),
        F.when(is_last & unterminated, F.col("_first_seq") + F.col("_lines") - 1).alias("_open_seq"),
    )
    return raw.join(offsets, ["file", "block"]).select(
        "file",
        "block",
        "block_off",
        "blocks",
        (F.col("_seq") - F.col("_first_seq") + F.col("_lines_before") + 1).alias("line_no"),
        "line",
        (size - F.coalesce((F.col("_seq") == F.col("_open_seq")).cast("long"), F.lit(0))).alias("n_bytes"),
    )


def scan_lines(spark: SparkSession, path: str | list[str], glob: str = ACCEPTED_GLOB) -> DataFrame:
    """Lines of text files with 1-based numbers; LF, CRLF and CR all end a line.

    `n_bytes` is the UTF-8 length with a one-byte newline, which a last unterminated line lacks.
    """
    return number_rows(text_rows(spark.read, path, glob))


def explode_lines(files: DataFrame, file: str, content: str, keep: Sequence[str] = ()) -> DataFrame:
    """Lines of a table in which each row is a whole file (`file` column: id, `content`: text).

    `keep` names further columns to carry along.
    """
    staged = files.select(F.col(file).cast("string").alias("file"), *keep, unix_newlines(F.col(content)).alias("_text"))
    ended = F.endswith("_text", F.lit("\n"))
    body = F.when(ended, F.left("_text", F.length("_text") - 1)).otherwise(F.col("_text"))
    unterminated = (F.col("_at") == F.col("_n") - 1) & ~F.col("_ended")
    return (
        staged.filter(F.length("_text") > 0)
        .select("file", *keep, ended.alias("_ended"), F.split(body, "\n").alias("_parts"))
        .withColumn("_n", F.size("_parts"))
        .select("file", *keep, "_ended", "_n", F.posexplode("_parts").alias("_at", "line"))
        .select(
            "file",
            *keep,
            F.lit(0).cast("long").alias("block"),
            F.lit(0).cast("long").alias("block_off"),
            F.lit(1).cast("long").alias("blocks"),
            (F.col("_at") + 1).cast("long").alias("line_no"),
            "line",
            (F.octet_length("line") + F.when(unterminated, 0).otherwise(1)).cast("long").alias("n_bytes"),
        )
    )


def stripped(lines: DataFrame) -> DataFrame:
    """Lines without outer whitespace; blank lines stay as ''."""
    return lines.withColumn("line", strip(F.col("line")))


def valid_text(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines that are UTF-8, quarantined lines)."""
    ok = F.is_valid_utf8("line")
    return lines.filter(ok), lines.filter(~ok).withColumn("reject_reason", F.lit("invalid UTF-8"))


def parse_jsonl(lines: DataFrame) -> DataFrame:
    """Adds the VARIANT `doc` of each line and keeps the line as `raw`; blank and bad lines get NULL."""
    return lines.withColumnRenamed("line", "raw").withColumn("doc", parse_json(strip(F.col("raw"))))


def explode_json_files(files: DataFrame, file: str, content: str, dumped: bool = False) -> DataFrame:
    """Elements of JSON files held one per row: arrays element by element, other values as one.

    `problem` is set (and `doc` NULL) for a file that is not JSON. Elements are parsed one by one,
    so the size of a file is not limited by the size of a single VARIANT. dumped=True adds the
    element text with ', ' and ': ' separators and ASCII escapes, the number of elements and the
    size of the whole re-serialized array (two bytes per separator and for the brackets), all
    computed before the array is exploded.
    """
    body = F.col(content)
    parsed = files.select(
        F.col(file).cast("string").alias("file"),
        F.coalesce(parse_json_array(body), as_list(parse_json(strip(body)))).alias("_docs"),
    )
    extra = []
    if dumped:
        sizes = F.transform("_dumped", lambda item: F.octet_length(item).cast("long"))
        parsed = parsed.withColumn("_dumped", dumps(F.transform("_docs", lambda doc: F.to_json(doc)))).select(
            "file",
            F.arrays_zip(F.col("_docs").alias("doc"), F.col("_dumped").alias("dumped")).alias("_items"),
            F.size("_docs").cast("long").alias("n_items"),
            F.aggregate(sizes, F.lit(0).cast("long"), lambda total, size: total + size + 2).alias("total_bytes"),
        )
        extra = [F.col("_item.dumped").alias("dumped"), "n_items", "total_bytes"]
    else:
        parsed = parsed.select("file", F.transform("_docs", lambda doc: F.struct(doc.alias("doc"))).alias("_items"))
    staged = parsed.withColumn("_bad", F.col("_items").isNull())
    # Only scalars are carried along when an array is exploded.
    carried = [c for c in staged.columns if c != "_items"]
    items = staged.select(*carried, F.posexplode_outer("_items").alias("_at", "_item"))
    return items.filter(F.col("_bad") | F.col("_at").isNotNull()).select(
        "file",
        F.col("_at").cast("long").alias("pos"),
        F.col("_item.doc").alias("doc"),
        F.variant_get("_item.doc", "$", "string").alias("raw"),
        F.when(F.col("_bad"), F.lit("Invalid JSON file")).alias("problem"),
        *extra,
    )


def scan_json_files(spark: SparkSession, path: str | list[str], glob: str = "*.json", dumped: bool = False) -> DataFrame:
    return explode_json_files(read_whole_files(spark, path, glob), "path", "content", dumped)
