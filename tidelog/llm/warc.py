"""WARC archives: written by Spark's text writer, read back by boundary-chain verification.

Writing: one record per page, an HTTP response whose payload is the page; pages with the payload of a page of smaller id
become revisit records without a payload. A record is one row of the text writer, which commits files like any other
output, and the two line ends after a record are the writer's line separator.

Reading: archives are split anywhere. Every task cuts its part of a file at the version line and emits, for each place that
parses as a record head, the offset of the record and that of its successor by Content-Length. Only places that are
reachable from the beginning of the file are records; version lines inside payloads are not. Inside a part the pointers
are followed locally to the part's exits; exits are then jumped along by doubling, so a file of n parts takes log2(n)
joins of a few rows per part; at last each part follows its true entry. Records with a version line in their payload are put
together from their pieces, everything else never leaves the task that read it.

Nulls: a null payload is an empty one; a null id is written as `null` and read as null; a null URL has no header. Repeated
rows stay: rows that share the smallest id and the payload are all responses. Extra columns are ignored. No pages give an
empty result. Payloads are any UTF-8 text, of any length below 2 GB.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.common import saved, shared_path

MAGIC = "WARC/1.1\r\n"
# Responses with a payload below this stay whole, whatever repeats.
LEAST_SHARED = 0
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# The tables hold no crawl times.
DATE = "1970-01-01T00:00:00Z"
BASE32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 SHA-1, by groups of five hex digits."""
    hexed = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), *BASE32)


def deduplicated(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """page_id, url, html and digest, bytes, refers_to (null for responses)."""
    known = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    known = known.withColumn("digest", base32_sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html").cast("long"))
    shared = known.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
    # As a written table its size is known, so that few repeated payloads are joined without shuffling the pages.
    shared = saved(shared.where("n > 1").select("digest", "bytes", "first"), "warc-shared")
    found = known.join(shared, ["digest", "bytes"], "left")
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return found.withColumn("refers_to", F.when(other, F.col("first"))).drop("first")


def record_text(url: str = "url") -> Column:
    """A whole record but for the two line ends after it."""
    head = F.lit(HTTP_HEAD)
    revisit = F.col("refers_to").isNotNull()
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    place = F.replace(F.replace(F.col(url), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    length = F.lit(len(HTTP_HEAD)) + F.when(revisit, 0).otherwise(F.col("bytes"))
    return F.concat(
        F.lit(MAGIC + "WARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"),
        name,
        F.lit(f">\r\nWARC-Date: {DATE}\r\n"),
        F.when(F.col(url).isNull(), "").otherwise(F.concat(F.lit("WARC-Target-URI: "), place, F.lit("\r\n"))),
        F.lit("WARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to"), F.lit(f">\r\nWARC-Profile: {PROFILE}"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
        length.cast("string"),
        F.lit("\r\n\r\n"),
        head,
        F.when(revisit, "").otherwise(F.col("html")),
    )


def write(pages: DataFrame, path: str, least: int = LEAST_SHARED) -> None:
    """Archives below `path`, one per task."""
    deduplicated(pages, least).select(record_text()).write.option("lineSep", "\r\n\r\n").text(path)


FIELD = re.compile(rb"([!-9;-~]+):[ \t]*([^\r\n]*)")
PIECES = "file string, part long, at long, size long, head long, length long, fields map<string,string>, digest string, payload_bytes long"


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """What the archives below `path` hold between version lines: file, part, value (bytes after the line)."""
    read = spark.read.option("lineSep", MAGIC).text(path)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.col("value").cast("binary").alias("value"))


def placed(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, int, bytes]]:
    """(file, part, bytes of the part before this piece, piece) in reading order."""
    now, at = None, 0
    for frame in frames:
        for file, part, value in zip(frame["file"], frame["part"], frame["value"], strict=True):
            if (file, part) != now:
                now, at = (file, part), 0
            yield file, part, at, value
            at += len(value) + len(MAGIC)


def head_of(piece: bytes) -> tuple[int, int, dict[str, str]] | None:
    """(bytes of the head, Content-Length, fields) of a piece that begins with a record head."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in piece[:end].split(b"\r\n"):
        match = FIELD.fullmatch(line)
        if not match:
            return None
        fields[match.group(1).decode("ascii").lower()] = match.group(2).decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()) or len(length) > 18 or "warc-type" not in fields:
        return None
    return end + 4, int(length), fields


def payload_of(block: bytes) -> bytes:
    """What follows the HTTP head."""
    return block[block.find(b"\r\n\r\n") + 4 :]


def base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every piece with its place; for record heads also their fields and, if the piece holds the whole block, its payload's digest."""
    rows = []
    for file, part, at, piece in placed(frames):
        row = [file, part, at, len(piece), None, None, None, None, None]
        head = head_of(piece)
        if head:
            row[4:7] = head
            if head[0] + head[1] <= len(piece):
                payload = payload_of(piece[head[0] : head[0] + head[1]])
                row[7:] = base32(payload), len(payload)
        rows.append(row)
        if len(rows) >= 2000:
            yield _frame(rows)
            rows = []
    yield _frame(rows)


def _frame(rows: list) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.replace("map<string,string>", "m").split(", ")])
    return frame.astype({c: "Int64" for c in ("part", "at", "size", "head", "length", "payload_bytes")})


def with_offsets(found: DataFrame) -> DataFrame:
    """Adds `start` (of the version line in its file; the bytes before the first one have start < 0) and `next`."""
    line = len(MAGIC)
    parts = found.groupBy("file", "part").agg(F.sum(F.col("size") + line).alias("bytes"))
    before = F.sum("bytes").over(Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("file", "part", F.coalesce(before, F.lit(0)).alias("before"))
    start = F.col("before") + F.col("at") - line
    out = found.join(parts, ["file", "part"]).withColumn("start", start).drop("before")
    return out.withColumn("next", F.col("start") + line + F.col("head") + F.col("length") + 4)


def part_exits(frame: pd.DataFrame) -> pd.DataFrame:
    """Where each record head of a part leaves the part, following successors inside it."""
    frame = frame.sort_values("start", ascending=False)
    leave: dict[int, int] = {}
    for start, after in zip(frame["start"].tolist(), frame["next"].tolist(), strict=True):
        leave[start] = leave.get(after, after)
    return frame[["file", "part", "start"]].assign(leave=list(map(leave.__getitem__, frame["start"].tolist())))


def entries(heads: DataFrame) -> DataFrame:
    """(file, part, entry): the first record of every part that the chain from offset 0 of its file enters."""
    exits = saved(heads.select("file", "part", "start", "next").groupBy("file", "part").applyInPandas(part_exits, "file string, part long, start long, leave long"), "warc-exits")
    doors = exits.select("file", F.col("leave").alias("start")).union(exits.select("file", F.lit(0).cast("long"))).distinct()
    jumps = saved(exits.join(doors, ["file", "start"]), "warc-doors")
    reached = jumps.where("start = 0").select("file", "part", "start", "leave")
    parts = jumps.groupBy("file").agg(F.count_distinct("part").alias("n")).agg(F.max("n")).first()[0] or 0
    step = jumps.select("file", F.col("start").alias("from"), F.col("leave").alias("to"))
    for _ in range(max(0, parts - 1).bit_length()):
        # `step` leads over 2^k parts; what is reached within 2^k parts leads to all within 2^(k + 1).
        more = reached.join(step, (step["file"] == reached["file"]) & (step["from"] == reached["start"])).select(reached["file"], step["to"].alias("start"))
        reached = saved(reached.select("file", "start").union(more).distinct().join(jumps, ["file", "start"]).select("file", "part", "start", "leave"), "warc-reached")
        again = step.select("file", F.col("from").alias("to"), F.col("to").alias("end"))
        step = saved(step.join(again, ["file", "to"]).select("file", "from", F.col("end").alias("to")), "warc-steps")
    return reached.select("file", "part", F.col("start").alias("entry"))


def follow(frame: pd.DataFrame) -> pd.DataFrame:
    """The records of a part: the heads on the chain from its entry."""
    after = dict(zip(frame["start"].tolist(), frame["next"].tolist(), strict=True))
    at, met = int(frame["entry"].iloc[0]), []
    while at in after:
        met.append(at)
        at = after[at]
    return pd.DataFrame({"file": frame["file"].iloc[0], "part": frame["part"].iloc[0], "start": met})


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, next, fields, digest, payload_bytes) of every record of the archives below `path`."""
    found = saved(with_offsets(saved(pieces(spark, path).mapInPandas(parsed, PIECES), "warc-pieces")), "warc-places")
    heads = found.where("next is not null and start >= 0")
    entered = heads.select("file", "part", "start", "next").join(entries(heads), ["file", "part"])
    real = entered.groupBy("file", "part").applyInPandas(follow, "file string, part long, start long")
    real = saved(heads.join(real, ["file", "part", "start"]), "warc-records")
    whole = real.where("payload_bytes is not null").select("file", "start", "next", "fields", "digest", "payload_bytes")
    opened = real.where("payload_bytes is null")
    return whole if opened.isEmpty() else whole.union(_joined(spark, path, found, opened))


def _joined(spark: SparkSession, path: str, found: DataFrame, opened: DataFrame) -> DataFrame:
    """Records with a version line in their payload, put together from their pieces in a second reading of only those."""
    own = opened.select("file", F.col("start").alias("owner"), "next", "head", "length", "fields")
    inside = found.join(own.select("file", "owner", F.col("next").alias("end")), "file").where("start >= owner and start < end")
    inside = inside.select("file", "part", "at", "start", "owner")

    def again(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in placed(frames):
            yield pd.DataFrame([row], columns=["file", "part", "at", "value"])

    wanted = saved(inside.select("file", "part").distinct(), "warc-wanted")
    values = pieces(spark, path).join(wanted, ["file", "part"], "left_semi").mapInPandas(again, "file string, part long, at long, value binary")
    values = values.join(inside, ["file", "part", "at"])
    blocks = values.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("start", "value"))).alias("values"))

    @F.pandas_udf("digest string, payload_bytes long")
    def payload(values: pd.Series, head: pd.Series, length: pd.Series) -> pd.DataFrame:
        out = []
        for parts, first, size in zip(values, head, length, strict=True):
            whole = MAGIC.encode().join(part["value"] for part in parts)
            read = payload_of(whole[first : first + size])
            out.append((base32(read), len(read)))
        return pd.DataFrame(out, columns=["digest", "payload_bytes"])

    met = blocks.join(own, ["file", "owner"]).withColumn("read", payload("values", "head", "length"))
    return met.select("file", F.col("owner").alias("start"), "next", "fields", "read.digest", "read.payload_bytes")


def page_of(field: str) -> Column:
    return F.regexp_extract(F.col("fields")[field], "^<urn:page:(-?[0-9]+)>$", 1)


def op4(pages: DataFrame) -> DataFrame:
    """Writes the pages, reads the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to, verified."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write(pages, path)
    read = records(spark, path)
    number = lambda field: F.when(page_of(field) != "", page_of(field).cast("long"))
    told = F.substring_index(F.col("fields")["warc-payload-digest"], ":", -1)
    read = read.select(
        number("warc-record-id").alias("page_id"), F.col("fields")["warc-type"].alias("record_type"), number("warc-refers-to").alias("refers_to"), told.alias("told"), "digest", "payload_bytes"
    )
    read = saved(read, "warc-read")
    revisit = read.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to", "told")
    response = read.where("record_type <> 'revisit'")
    first = response.groupBy(F.col("page_id").alias("refers_to"), "told").agg(F.first("payload_bytes").alias("payload_bytes"))
    met = revisit.join(first, ["refers_to", "told"], "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified"]
    met = met.select("page_id", "payload_bytes", F.col("told").alias("payload_digest"), "record_type", "refers_to", F.col("payload_bytes").isNotNull().alias("verified"))
    response = response.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to", (F.col("digest") == F.col("told")).alias("verified"))
    return response.select(*columns).union(met.select(*columns))


def _sql() -> str:
    groups = " || ".join(f"to_base(('0x' || substr(h, {1 + 5 * i}, 5))::BIGINT, 32, 4)" for i in range(8))
    return f"""
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), based AS (
  SELECT page_id, payload_bytes, translate({groups}, '{BASE32[0]}', '{BASE32[1]}') AS payload_digest,
         min(page_id) OVER (PARTITION BY h, payload_bytes) AS first FROM hashed
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to, true AS verified
FROM based"""


OP4_SQL = _sql()
