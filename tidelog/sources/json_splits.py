"""Large JSON array files read by many tasks, with the result of strict parsing of whole files.

The files are read as text in ordinary splits, ended at commas, and gathered to chunks. Whether a comma separates elements depends on
what stands before it in the file, so every chunk is first summarized as a function of its entry state: the quotes it
holds, and, for an entry outside and an entry inside a string, the change of depth and the separators at each depth.
Running sums over these small rows compose the functions and give every chunk its true entry state. Then all chunks are cut into
elements at once; elements cut by a border are put together from their parts.

A text may also lie in the part files of a folder, as Spark writes one: with `folders` a folder is one file, its parts in the
order of their names. Elements cut by the border of a part are put together; a border may lie anywhere but behind a backslash.

A file is rejected as a whole if it is not one JSON value: unbalanced, anything before or after the value, an element
that does not parse. A value that is no array is a single element, as are all values that files of other kinds hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions.json_values import dumps, parse_json
from tidelog.sources.scratch import saved

CHUNK_BYTES = 4 << 20
BLANKS = b" \t\n\r"
SUMMARY = "quotes long, blank boolean, array boolean, delta0 long, delta1 long, levels0 map<long,long>, levels1 map<long,long>"
KEY = [("file", pa.string()), ("part", pa.string()), ("block", pa.int64()), ("number", pa.int64())]
PART = "pos long, text binary, whole boolean"


class Structure:
    """Where a piece of JSON text has quotes, brackets and commas."""

    def __init__(self, data: bytes):
        signs = np.frombuffer(data, np.uint8)
        quotes = np.flatnonzero(signs == ord('"'))
        slashes = np.flatnonzero(signs == ord("\\"))
        if len(slashes) and len(quotes):
            # A quote is escaped if the run of backslashes that ends before it is odd.
            first = np.concatenate(([True], np.diff(slashes) > 1))
            length = np.arange(len(slashes)) - np.maximum.accumulate(np.where(first, np.arange(len(slashes)), 0)) + 1
            at = np.searchsorted(slashes, quotes) - 1
            behind = (at >= 0) & (slashes[at] == quotes - 1)
            quotes = quotes[~(behind & (length[at] % 2 == 1))]
        self.quotes = len(quotes)
        opening = (signs == ord("[")) | (signs == ord("{"))
        closing = (signs == ord("]")) | (signs == ord("}"))
        places = np.flatnonzero(opening | closing | (signs == ord(",")))
        self._places, self._odd = places, np.searchsorted(quotes, places) % 2
        self._step = opening[places].astype(np.int64) - closing[places]

    def outside(self, inside: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, step, depth after it relative to the entry) of the signs outside strings, if the entry is inside one or not."""
        real = self._odd == inside
        step = self._step[real]
        return self._places[real], step, np.cumsum(step)


def gathered(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[tuple[tuple, int, bytes]]:
    """((file, part, block, part_size), number, bytes) of the chunks of the splits of a task; the comma that ended a row belongs to it."""
    last, key, number, parts, size = None, (), 0, [], 0
    for batch in batches:
        splits = batch.column("split").to_numpy()
        ends = np.append(np.flatnonzero(splits[1:] != splits[:-1]) + 1, len(splits))
        start = 0
        for end in ends.tolist():
            if end == start:
                continue
            if splits[start] != last:
                if parts:
                    yield key, number, b"".join(parts)
                last, key = splits[start], tuple(batch.column(name)[start].as_py() for name in ("file", "part", "block", "part_size"))
                number, parts, size = 0, [], 0
            values = batch.column("value").slice(start, end - start)
            # Rows are joined up to about a chunk at a time.
            total = np.cumsum(pc.binary_length(values).to_numpy() + 1)
            at = 0
            while at < len(values):
                upto = int(np.searchsorted(total, (total[at - 1] if at else 0) + max(1, chunk_bytes - size))) + 1
                upto = min(upto, len(values))
                rows = values.slice(at, upto - at)
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows), b",")[0].as_py()
                parts.append(joined + b",")
                size += len(joined) + 1
                at = upto
                if size >= chunk_bytes:
                    yield key, number, b"".join(parts)
                    number, parts, size = number + 1, [], 0
            start = end
    if parts:
        yield key, number, b"".join(parts)


def summary(data: bytes) -> dict:
    """The chunk as a function of its entry state."""
    structure, body = Structure(data), data.lstrip(BLANKS)
    out = {"quotes": structure.quotes, "blank": not body, "array": body[:1] == b"["}
    for inside in (0, 1):
        _, step, depth = structure.outside(inside)
        levels, counts = np.unique(depth[step == 0], return_counts=True)
        out[f"delta{inside}"] = int(step.sum())
        out[f"levels{inside}"] = list(zip(levels.tolist(), counts.tolist(), strict=True))
    return out


def cut(data: bytes, inside: int, depth: int, pos: int, opened: bool) -> Iterator[tuple[int, bytes, bool]]:
    """(element, text, whether it begins and ends here) for a chunk of an array file; element -1 tells of text that no array has."""
    places, step, level = Structure(data).outside(inside)
    level = level + depth
    start, begun = 0, False
    if not opened:
        start = len(data) - len(data.lstrip(BLANKS)) + 1  # behind the bracket
        if start > len(data):
            return
        begun = True
    elif depth <= 0:
        if data.strip(BLANKS):
            yield -1, b"", True
        return
    closed = np.flatnonzero((level <= 0) & (step < 0))
    stop = int(closed[0]) if len(closed) else len(level)
    for place in places[:stop][(level[:stop] == 1) & (step[:stop] == 0)].tolist():
        yield pos, data[start:place], begun
        start, begun, pos = place + 1, True, pos + 1
    if stop == len(level):
        yield pos, data[start:], False
        return
    end = int(places[stop])
    if pos or data[start:end].strip(BLANKS):  # `[]` has no element; without a comma it lies in one chunk
        yield pos, data[start:end], begun
    if data[end] != ord("]") or data[end + 1 :].strip(BLANKS):
        yield -1, b"", True


def json_chunks(spark: SparkSession, path: str | list[str], glob: str, chunk_bytes: int, folders: bool = False) -> DataFrame:
    """(file, part, block, number, content and the summary) of all chunks, written to the scratch folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, part, block, part_size), number, data in gathered(batches, chunk_bytes):
            row = {"file": file, "part": part, "block": block, "part_size": part_size, "number": number, "content": data, **summary(data)}
            yield pa.RecordBatch.from_pylist([row], schema=kinds)

    kinds = pa.schema(
        [("file", pa.string()), ("part", pa.string()), ("block", pa.int64()), ("part_size", pa.int64()), ("number", pa.int64()), ("content", pa.binary()), ("quotes", pa.int64()), ("blank", pa.bool_()), ("array", pa.bool_())]
        + [(f"delta{i}", pa.int64()) for i in (0, 1)]
        + [(f"levels{i}", pa.map_(pa.int64(), pa.int64())) for i in (0, 1)]
    )
    name = F.col("_metadata.file_path")
    rows = (
        spark.read.option("lineSep", ",")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .text(path)
        .select(
            (F.regexp_replace(name, "/[^/]*$", "") if folders else name).alias("file"),
            (F.substring_index(name, "/", -1) if folders else F.lit("")).alias("part"),
            F.col("_metadata.file_block_start").alias("block"),
            F.col("_metadata.file_size").alias("part_size"),
            F.col("value").cast("binary").alias("value"),
        )
        .withColumn("split", F.xxhash64("file", "part", "block"))
    )
    return saved(rows.mapInArrow(run, f"file string, part string, block long, part_size long, number long, content binary, {SUMMARY}"), "json-chunks")


def entry_states(chunks: DataFrame) -> DataFrame:
    """Entry state of each chunk: inside a string or not, depth, element number, whether the value has begun; whether the comma
    at its end is not in the file; and of the file whether it is an array, balanced, and ends with a comma.

    The comma behind the last row of a part is not in it unless the part ends with one: then the rows with their commas are as
    long as the part, else longer by one (a dropped UTF-8 mark shifts both by three).
    """
    file, part = Window.partitionBy("file"), Window.partitionBy("file", "part")
    order = file.orderBy("part", "block", "number")
    before = order.rowsBetween(Window.unboundedPreceding, -1)

    def running(value: Column | str) -> Column:
        return F.coalesce(F.sum(value).over(before), F.lit(0))

    small = chunks.withColumn("bytes", F.octet_length("content").cast("long")).drop("content").withColumn("inside", F.pmod(running("quotes"), F.lit(2)))
    at = F.col("inside") == 0
    small = small.withColumn("delta", F.when(at, F.col("delta0")).otherwise(F.col("delta1")))
    small = small.withColumn("levels", F.when(at, F.col("levels0")).otherwise(F.col("levels1"))).withColumn("depth", running("delta"))
    ends = F.lead("file").over(part.orderBy("block", "number")).isNull()
    small = small.withColumn("added", ends & (F.pmod(F.sum("bytes").over(part) - F.col("part_size"), F.lit(3)) != 0))
    # A comma that is not in the file separates nothing.
    counted = F.col("added") & (F.col("depth") + F.col("delta") == 1) & (F.pmod(F.col("inside") + F.col("quotes"), F.lit(2)) == 0)
    small = small.withColumn("separators", F.coalesce(F.try_element_at("levels", 1 - F.col("depth")), F.lit(0)) - counted.cast("long"))
    begun = F.when(~F.col("blank"), F.col("array"))
    return small.select(
        "file",
        "part",
        "block",
        "number",
        "inside",
        "depth",
        running("separators").alias("pos"),
        (running((~F.col("blank")).cast("long")) > 0).alias("opened"),
        F.coalesce(F.first(begun, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(False)).alias("is_array"),
        "added",
        (F.lead("file").over(order).isNull() & ~F.col("added")).alias("comma_behind"),
        ((F.pmod(F.sum("quotes").over(file), F.lit(2)) == 0) & (F.sum("delta").over(file) == 0)).alias("balanced"),
    )


def json_elements(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((file, pos, text) of all elements, files that are unbalanced or hold text where no array has any)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = row["content"][:-1] if row["added"] else row["content"]
                if row["is_array"]:
                    found = list(cut(data, row["inside"], row["depth"], row["pos"], row["opened"]))
                else:
                    found = [(0, data, False)]
                if found:
                    pos, text, whole = zip(*found, strict=True)
                    arrays = [pa.array(pos, pa.int64()), pa.array(text, pa.binary()), pa.array(whole, pa.bool_())]
                    same = [pa.array([row[name]] * len(found), kind) for name, kind in KEY]
                    yield pa.RecordBatch.from_arrays(same + arrays, names=[name for name, _ in KEY] + ["pos", "text", "whole"])

    states = entry_states(chunks)
    held = chunks.select("file", "part", "block", "number", "content").join(states, ["file", "part", "block", "number"])
    parts = saved(held.mapInArrow(run, f"file string, part string, block long, number long, {PART}"), "json-parts")
    whole = parts.where("whole and pos >= 0").select("file", "pos", F.col("text").cast("string"))
    pieces = F.array_sort(F.collect_list(F.struct("part", "block", "number", F.col("text").cast("string").alias("text"))))
    joined = parts.where("not whole").groupBy("file", "pos").agg(F.array_join(F.transform(pieces, lambda piece: piece["text"]), "").alias("text"))
    bad = states.where("not balanced or comma_behind").select("file").union(parts.where("pos < 0").select("file"))
    return whole.union(joined), bad


def scan_json_splits(spark: SparkSession, path: str | list[str], glob: str = "*.json", dumped: bool = False, chunk_bytes: int = CHUNK_BYTES, folders: bool = False) -> DataFrame:
    """The rows of `scan_json_files`, whatever the size of a file: no task holds more than a split or an element.

    With `folders` the files of a folder are the parts of one, in the order of their names.
    """
    elements, bad = json_elements(json_chunks(spark, path, glob, chunk_bytes, folders))
    parsed = elements.withColumn("doc", parse_json(F.col("text")))
    bad = saved(bad.union(parsed.where("doc is null").select("file")).distinct(), "json-rejected")
    good = parsed.join(bad, "file", "left_anti").select("file", "pos", "doc", F.variant_get("doc", "$", "string").alias("raw"), F.lit(None).cast("string").alias("problem"))
    rejected = bad.select("file", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("variant").alias("doc"), F.lit(None).cast("string").alias("raw"), F.lit("Invalid JSON file").alias("problem"))
    if not dumped:
        return good.unionByName(rejected)
    good = good.withColumn("dumped", dumps(F.array(F.to_json("doc")))[0])
    sizes = good.groupBy("file").agg(F.count("*").alias("n_items"), F.sum(F.octet_length("dumped").cast("long") + 2).alias("total_bytes"))
    return good.join(sizes, "file").unionByName(rejected, allowMissingColumns=True)
