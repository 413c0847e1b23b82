"""Cut files into byte-limited chunks.

Input is a line frame of `tidelog.sources.files` (file, block, block_off, line_no, line, n_bytes).

`chunk_spans` gives the sequential rule (fill a chunk while the next line fits, an oversized line
sits alone) without sending a file to one task. Within a block the rule is a walk over cumulative
sizes; between blocks only the offset of the open chunk matters. Blocks of multi-block files are
first summarized, in parallel, as a table "open offset at entry -> open offset at exit, chunks
closed"; the tables of many blocks are composed, in parallel, to one per part of a file; a short pass
per file follows the parts, and all parts are then followed at once. Finally every block is walked
from its true entry state. Only line numbers and sizes reach Python, never text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.ordering import running_sum, together

# Fixed value: default chunk limit.
CHUNK_BYTES = 50 * 1024 * 1024

# Blocks whose offsets lie in one stretch of this many chunk limits form a part.
PART_CHUNKS = 64
# Parts that a task takes together, and how often at most.
FAN = 64
LEVELS = 2

_TABLE = "file string, part long, block long, upto long, exit_open long, closed long"
_PART_TABLE = "file string, part long, upto long, exit_open long, closed long"
_ENTRY = "file string, part long, block long, entry_open long, entry_id long"
_SPANS = "file string, block long, chunk_id long, first_line long, last_line long, line_count long, size_bytes long"


def with_block_offsets(lines: DataFrame) -> DataFrame:
    """Adds `block_off` and `blocks` to lines whose blocks were assigned by hand."""
    per_block = lines.groupBy("file", "block").agg(F.sum("n_bytes").alias("_bytes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select(
        "file",
        "block",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("block_off"),
        F.count("*").over(Window.partitionBy("file")).alias("blocks"),
    )
    return lines.drop("block_off", "blocks").join(offsets, ["file", "block"])


def _steps(sizes: np.ndarray, offset: int, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block as a step function of the open chunk's offset at entry.

    Returns (upto, exit_open, closed): a chunk opened at offset o before the block ends at the first
    line whose end exceeds o + limit; the first step with upto > o + limit tells where the open chunk
    begins at the end of the block and how many chunks were closed on the way.
    """
    ends = offset + np.cumsum(sizes)
    starts = ends - sizes
    count = len(sizes)
    # For a chunk opened at each line, the line that opens the following one (`count`: none).
    jump = np.maximum(np.searchsorted(ends, starts + limit, side="right"), np.arange(1, count + 1))
    last = np.where(jump < count, jump, np.arange(count))
    hops = (jump < count).astype(np.int64)
    # Pointer doubling: after k rounds `last` is 2^k openings further on and `hops` counts them.
    while True:
        further = last[last]
        if np.array_equal(further, last):
            break
        hops = hops + hops[last]
        last = further
    # A chunk open at entry began before this block, so it closes within `limit` bytes of it.
    reachable = min(int(np.searchsorted(ends, starts[0] + limit, side="right")) + 1, count)
    exits, closed = starts[last[:reachable]], hops[:reachable] + 1
    # Neighbouring lines with one outcome are one step.
    final = np.append((exits[1:] != exits[:-1]) | (closed[1:] != closed[:-1]), True)
    return ends[:reachable][final], exits[final], closed[final]


def _runs(pdf: pd.DataFrame, *keys: str) -> Iterator[tuple[tuple, int, int]]:
    """(key values, begin, end) of each run of rows with equal keys."""
    columns = [pdf[name].to_numpy() for name in keys]
    differs = np.zeros(max(len(pdf) - 1, 0), dtype=bool)
    for values in columns:
        differs |= values[1:] != values[:-1]
    cuts = np.flatnonzero(differs) + 1
    for begin, end in zip([0, *cuts], [*cuts, len(pdf)]):
        if end > begin:
            yield tuple(values[begin] for values in columns), int(begin), int(end)


def _summarize(limit: int):
    """Step table of each block; rows sorted by file, block, line_no, one block's sizes held at a time."""

    def table(key: tuple, offset: int, held: list[np.ndarray]) -> pd.DataFrame:
        upto, exit_open, closed = _steps(np.concatenate(held), offset, limit)
        part = offset // (PART_CHUNKS * limit)
        return pd.DataFrame(
            {"file": key[0], "part": part, "block": key[1], "upto": upto, "exit_open": exit_open, "closed": closed}
        )

    def summarize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, offset, held = None, 0, []
        for pdf in batches:
            done = []
            for run, begin, end in _runs(pdf, "file", "block"):
                if run != key:
                    if held:
                        done.append(table(key, offset, held))
                    key, offset, held = run, int(pdf["block_off"].iloc[begin]), []
                held.append(pdf["n_bytes"].to_numpy(dtype=np.int64)[begin:end])
            if done:
                yield pd.concat(done)
        if held:
            yield table(key, offset, held)

    return summarize


def _chain(blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]], limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Step table of consecutive blocks taken as one."""
    upto, exit_open, closed = blocks[-1]
    for first_upto, first_exit, first_closed in reversed(blocks[:-1]):
        # Where the chunk left open by the first block goes in the rest.
        at = np.searchsorted(upto, first_exit + limit, side="right")
        goes_on = at < len(upto)
        at = np.minimum(at, len(upto) - 1)
        through_exit = np.where(goes_on, exit_open[at], first_exit)
        through_closed = first_closed + np.where(goes_on, closed[at], 0)
        # Chunks that outlast the first block meet the steps of the rest directly.
        later = upto > first_upto[-1]
        upto = np.append(first_upto, upto[later])
        exit_open, closed = np.append(through_exit, exit_open[later]), np.append(through_closed, closed[later])
    return upto, exit_open, closed


def _compose(limit: int):
    """Step table of each part; rows sorted by file, part, block, upto, one part's tables held at a time."""

    def table(key: tuple, blocks: dict) -> pd.DataFrame:
        tables = [tuple(np.concatenate(pieces) for pieces in zip(*held)) for held in blocks.values()]
        upto, exit_open, closed = _chain(tables, limit)
        return pd.DataFrame({"file": key[0], "part": key[1], "upto": upto, "exit_open": exit_open, "closed": closed})

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, blocks = None, {}
        for pdf in batches:
            done = []
            for (file, part, block), begin, end in _runs(pdf, "file", "part", "block"):
                if (file, part) != key:
                    if blocks:
                        done.append(table(key, blocks))
                    key, blocks = (file, part), {}
                steps = tuple(pdf[name].to_numpy()[begin:end] for name in ("upto", "exit_open", "closed"))
                blocks.setdefault(block, []).append(steps)
            if done:
                yield pd.concat(done)
        if blocks:
            yield table(key, blocks)

    return compose


def _follow(limit: int):
    """Entry state of each block, given that of its part; rows sorted by file, part, block, upto."""
    names = ["file", "part", "block", "upto", "exit_open", "closed", "part_open", "part_id"]
    columns = ["file", "part", "block", "entry_open", "entry_id"]

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = block = None
        open_at = chunk_id = 0
        settled = opening = False
        for pdf in batches:
            entries = []
            for file, part, row_block, upto, exit_open, closed, part_open, part_id in zip(*(pdf[n].tolist() for n in names)):
                if (file, part) != key:
                    key, block = (file, part), None
                    open_at, chunk_id, opening = part_open, part_id, part == 0
                if row_block != block:
                    block, settled = row_block, False
                    entries.append((file, part, block, open_at, chunk_id))
                    if opening:
                        # The first block of a file opens its first chunk itself: its first step applies as it is.
                        open_at, chunk_id, settled, opening = exit_open, closed - 1, True, False
                if not settled and upto > open_at + limit:
                    open_at, chunk_id, settled = exit_open, chunk_id + closed, True
            yield pd.DataFrame(entries, columns=columns)

    return follow


def _levels(sizes: DataFrame, limit: int) -> int:
    """How often parts have to be taken together, FAN at a time, until a file has FAN of them at most."""
    parts = (sizes.agg(F.max("block_off")).first()[0] or 0) // (PART_CHUNKS * limit) + 1
    levels = 1
    while parts > FAN:
        parts, levels = -(-parts // FAN), levels + 1
    return levels


def _entries(tables: DataFrame, limit: int, levels: int) -> DataFrame:
    """Open chunk and its id at the entry of each block.

    Up: the tables of the blocks of a part are composed to one, those of FAN parts to one of a larger part, and so on.
    Down: from the file's beginning, the entry of each of the largest parts is found, then that of the parts in each of
    them at once, and so on to the blocks. Composition is associative and a table holds no more than the lines of one
    chunk limit, so no task reads more than a constant number of parts' tables, however long a file is.
    """
    sweep = [tables]
    for _ in range(levels):
        larger = (
            together(sweep[-1], "file", "part")
            .sortWithinPartitions("file", "part", "block", "upto")
            .mapInPandas(_compose(limit), _PART_TABLE)
        )
        sweep.append(
            larger.select("file", F.expr(f"part div {FAN}").alias("part"), F.col("part").alias("block"), "upto", "exit_open", "closed")
        )
    none = F.lit(0).cast("long")
    opened = sweep.pop().withColumns({"part": none, "part_open": none, "part_id": none})
    while True:
        rows = opened.select("file", "part", "block", "upto", "exit_open", "closed", "part_open", "part_id")
        entries = (
            together(rows, "file", "part")
            .sortWithinPartitions("file", "part", "block", "upto")
            .mapInPandas(_follow(limit), _ENTRY)
        )
        if not sweep:
            return entries.drop("part")
        known = entries.select(
            "file", F.col("block").alias("part"), F.col("entry_open").alias("part_open"), F.col("entry_id").alias("part_id")
        )
        opened = sweep.pop().join(known, ["file", "part"])


def _walk(limit: int):
    columns = ["file", "block", "chunk_id", "first_line", "last_line", "line_count", "size_bytes"]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by file, block, line_no; constant state, batches may cut a block anywhere.

        Goes from chunk to chunk: the lines that still fit are found by binary search in the running sums.
        """
        key = piece = None  # piece: [chunk_id, first_line, last_line, line_count, size_bytes]
        filled = chunk_id = 0  # bytes of the open chunk, pieces in earlier blocks included
        for pdf in batches:
            done = []
            for run, begin, end in _runs(pdf, "file", "block"):
                if run != key:
                    if piece:
                        done.append((*key, *piece))
                    key, piece = run, None
                    filled, chunk_id = int(pdf["carried"].iloc[begin]), int(pdf["entry_id"].iloc[begin])
                numbers = pdf["line_no"].to_numpy(np.int64)[begin:end]
                ends = np.cumsum(pdf["n_bytes"].to_numpy(np.int64)[begin:end])
                at = base = 0
                while at < len(ends):
                    fit = int(np.searchsorted(ends, base + limit - filled, side="right"))
                    if fit <= at and filled:
                        if piece:
                            done.append((*key, *piece))
                        piece, filled, chunk_id = None, 0, chunk_id + 1
                        continue
                    fit = max(fit, at + 1)
                    size, last = int(ends[fit - 1]) - base, int(numbers[fit - 1])
                    if piece:
                        piece[2], piece[3], piece[4] = last, piece[3] + fit - at, piece[4] + size
                    else:
                        piece = [chunk_id, int(numbers[at]), last, fit - at, size]
                    filled, base, at = filled + size, int(ends[fit - 1]), fit
            yield pd.DataFrame(done, columns=columns)
        if piece:
            yield pd.DataFrame([(*key, *piece)], columns=columns)

    return walk


def chunk_spans(lines: DataFrame, limit: int = CHUNK_BYTES, sizes_path: str | None = None) -> DataFrame:
    """Pieces of chunks: (file, block, chunk_id, first_line, last_line, line_count, size_bytes).

    A chunk that crosses a block boundary has one piece per block. Ids count from 0 in each file.
    Line sizes are needed twice when files have several blocks; `sizes_path` names a place to write
    them to (a few bytes per line), so that the text is read once.
    """
    sizes = lines.select("file", "block", "block_off", "blocks", "line_no", "n_bytes")
    if sizes_path:
        sizes.write.mode("overwrite").parquet(sizes_path)
        sizes = lines.sparkSession.read.schema(sizes.schema).parquet(sizes_path)
    tables = (
        together(sizes.filter("blocks > 1"), "file", "block")
        .sortWithinPartitions("file", "block", "line_no")
        .mapInPandas(_summarize(limit), _TABLE)
    )
    # Sizes that are not written are not read for the number of levels: enough for some hundred TB at the default limit.
    entries = _entries(tables, limit, _levels(sizes, limit) if sizes_path else LEVELS)
    carried = F.col("block_off") - F.coalesce("entry_open", "block_off")
    entered = sizes.join(entries, ["file", "block"], "left").select(
        "file", "block", "line_no", "n_bytes", carried.alias("carried"), F.coalesce("entry_id", F.lit(0)).alias("entry_id")
    )
    return (
        together(entered, "file", "block")
        .sortWithinPartitions("file", "block", "line_no")
        .mapInPandas(_walk(limit), _SPANS)
    )


def assign_chunks(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """Adds `chunk_id` to lines: each line takes the id of the last piece that begins at or before it."""
    marks = spans.select("file", "block", F.col("first_line").alias("line_no"), "chunk_id", F.lit(0).alias("_is_line"))
    rows = lines.withColumn("_is_line", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    inside = (
        Window.partitionBy("file", "block")
        .orderBy("line_no", "_is_line")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        rows.withColumn("chunk_id", F.last("chunk_id", ignorenulls=True).over(inside))
        .filter("_is_line = 1")
        .drop("_is_line")
    )


def chunk_next_fit(lines: DataFrame, limit: int = CHUNK_BYTES, sizes_path: str | None = None) -> DataFrame:
    """Lines with the `chunk_id` of the sequential rule."""
    return assign_chunks(lines, chunk_spans(lines, limit, sizes_path))


def chunk_budget(lines: DataFrame, limit: int = CHUNK_BYTES) -> DataFrame:
    """Lines with `chunk_id` = start offset / limit: no state between chunks, JVM only.

    Ids differ from `chunk_next_fit`; a chunk may exceed the limit by its last line.
    """
    inside = Window.partitionBy("file", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("block_off") + F.coalesce(F.sum("n_bytes").over(inside), F.lit(0))
    return lines.withColumn("start_off", start).withColumn("chunk_id", F.floor(F.col("start_off") / F.lit(limit)))


def chunk_metadata(spans: DataFrame, chunk_type: Column | str = "text") -> DataFrame:
    """One row per chunk: size, line count (blank lines count), type. Needs no text."""
    label = F.lit(chunk_type) if isinstance(chunk_type, str) else chunk_type
    return (
        spans.groupBy("file", "chunk_id")
        .agg(
            F.sum("size_bytes").alias("size_bytes"),
            F.sum("line_count").alias("line_count"),
            F.min("first_line").alias("first_line"),
        )
        .withColumn("type", label)
    )


def metadata_of_lines(chunked: DataFrame, chunk_type: Column | str = "text") -> DataFrame:
    """The same record from lines that already carry a chunk id."""
    label = F.lit(chunk_type) if isinstance(chunk_type, str) else chunk_type
    return (
        chunked.groupBy("file", "chunk_id")
        .agg(F.sum("n_bytes").alias("size_bytes"), F.count("*").alias("line_count"), F.min("line_no").alias("first_line"))
        .withColumn("type", label)
    )


def chunk_type_of(file_type: Column) -> Column:
    """Manifest format -> chunk type: everything that is not JSON is 'text'."""
    return F.when(file_type.isin("jsonl", "json"), file_type).otherwise(F.lit("text"))


def chunk_json_items(items: DataFrame, limit: int = CHUNK_BYTES) -> DataFrame:
    """Fixed-count slices of JSON array elements.

    `items` is the output of `explode_json_files(dumped=True)`. A chunk holds
    max(1, n * limit // total) elements, total being the size of the re-serialized array.
    """
    per_chunk = F.greatest(F.lit(1).cast("long"), F.expr(f"n_items * {int(limit)}L div total_bytes"))
    return items.withColumn("items_per_chunk", per_chunk).withColumn("chunk_id", F.expr("pos div items_per_chunk"))


def json_chunk_metadata(chunked: DataFrame) -> DataFrame:
    """Chunk records of `chunk_json_items`; `size_bytes` is the size of the re-serialized slice."""
    return (
        chunked.groupBy("file", "chunk_id")
        .agg(
            (F.sum(F.octet_length("dumped").cast("long")) + 2 * F.count("*")).alias("size_bytes"),
            F.count("*").alias("line_count"),
        )
        .withColumn("type", F.lit("json"))
    )


def chunk_by_type(
    text_lines: DataFrame, json_items: DataFrame, formats: DataFrame, limit: int = CHUNK_BYTES, sizes_path: str | None = None
) -> DataFrame:
    """Chunked content of all files by format: (file, chunk_id, line_no, line, n_bytes, type).

    `formats` is (file, file_type). Files without a format are treated as text. `sizes_path` as for `chunk_spans`.
    """
    typed = text_lines.join(formats, "file", "left")
    lines = typed.filter(F.coalesce("file_type", F.lit("plain_text")) != "json")
    by_line = chunk_next_fit(lines, limit, sizes_path).select(
        "file", "chunk_id", "line_no", "line", "n_bytes", chunk_type_of(F.coalesce("file_type", F.lit("plain_text"))).alias("type")
    )
    elements = json_items.join(formats.filter("file_type = 'json'"), "file", "left_semi")
    by_item = chunk_json_items(elements, limit).select(
        "file",
        "chunk_id",
        (F.col("pos") + 1).alias("line_no"),
        F.col("dumped").alias("line"),
        F.octet_length("dumped").cast("long").alias("n_bytes"),
        F.lit("json").alias("type"),
    )
    return by_line.unionByName(by_item)


def without_chunks(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files that yielded no chunk, with the reason."""
    return files.join(chunks.select("file").distinct(), "file", "left_anti").withColumn(
        "reject_reason", F.lit("no chunks")
    )


def running_bytes(lines: DataFrame) -> DataFrame:
    """Adds `running_bytes`, the bytes of the file up to and including the line."""
    return running_sum(lines, ["file"], "block", ["line_no"], F.col("n_bytes"), "running_bytes")
