"""Chunk rules against a direct loop, across block boundaries and for one dominant file."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.operators import chunking as C
from tidelog.operators.ordering import last_known, row_numbers, running_sum

LINE = "file string, block long, line_no long, line string, n_bytes long"


def sequential(sizes, limit):
    chunk, used, ids = 0, 0, []
    for size in sizes:
        if used and used + size > limit:
            chunk, used = chunk + 1, 0
        used += size
        ids.append(chunk)
    return ids


def frame(spark, files, block_lines):
    rows = [
        (name, n // block_lines, n + 1, f"{name}:{n}", size)
        for name, sizes in files.items()
        for n, size in enumerate(sizes)
    ]
    return C.with_block_offsets(spark.createDataFrame(rows, LINE))


def check(spark, files, block_lines, limit):
    lines = frame(spark, files, block_lines)
    expected = {(name, n + 1): chunk for name, sizes in files.items() for n, chunk in enumerate(sequential(sizes, limit))}
    found = {(r.file, r.line_no): r.chunk_id for r in C.chunk_next_fit(lines, limit).collect()}
    assert found == expected
    metadata = {
        (r.file, r.chunk_id): (r.size_bytes, r.line_count) for r in C.chunk_metadata(C.chunk_spans(lines, limit)).collect()
    }
    totals = {}
    for name, sizes in files.items():
        for size, chunk in zip(sizes, sequential(sizes, limit)):
            bytes_, count = totals.get((name, chunk), (0, 0))
            totals[name, chunk] = (bytes_ + size, count + 1)
    assert metadata == totals


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(st.lists(st.integers(1, 130), min_size=1, max_size=60), min_size=1, max_size=6),
    st.integers(1, 20),
    st.integers(20, 120),
)
def test_next_fit_equals_the_loop(spark, sizes, block_lines, limit):
    check(spark, {f"f{n}": part for n, part in enumerate(sizes)}, block_lines, limit)


def test_exact_fit_one_over_and_oversized(spark):
    check(spark, {"exact": [50, 50, 100, 1], "over": [50, 51, 100], "alone": [10, 500, 10], "same": [10] * 95}, 3, 100)


def test_one_file_holds_most_lines(spark):
    check(spark, {"hot": [1 + (n * 7919) % 97 for n in range(20_000)], "small": [5, 5]}, 250, 2_000)


def test_budget_and_running_bytes(spark):
    sizes = [1 + (n * 31) % 17 for n in range(500)]
    lines = frame(spark, {"f": sizes}, 37)
    ends = {r.line_no: r.running_bytes for r in C.running_bytes(lines).collect()}
    chunks = {r.line_no: r.chunk_id for r in C.chunk_budget(lines, 64).collect()}
    total = 0
    for number, size in enumerate(sizes, 1):
        assert chunks[number] == total // 64
        total += size
        assert ends[number] == total


def test_two_level_scans_equal_one_window(spark):
    from pyspark.sql import Window

    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"),
        F.expr("id div 100").alias("block"),
        "id",
        F.when(F.col("id") % 41 == 7, F.col("id").cast("string")).alias("v"),
    )
    whole = Window.partitionBy("g").orderBy("id")
    expected = rows.select(
        "g", "id",
        F.row_number().over(whole).cast("long").alias("n"),
        F.sum("id").over(whole).alias("s"),
        F.last("v", ignorenulls=True).over(whole).alias("k"),
    )
    found = last_known(
        running_sum(row_numbers(rows, ["g"], "block", ["id"], "n"), ["g"], "block", ["id"], F.col("id"), "s"),
        ["g"], "block", ["id"], "v", "k",
    ).select("g", "id", "n", "s", "k")
    assert found.exceptAll(expected).count() == 0 and expected.exceptAll(found).count() == 0


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.one_of(st.integers(1, 12), st.integers(1, 200)), min_size=1, max_size=400),
    st.lists(st.integers(1, 30), min_size=1, max_size=5),
    st.integers(1, 90),
    st.integers(1, 4),
)
def test_entry_states_without_spark(sizes, block_lengths, limit, part_chunks):
    """Block tables, their composition and both follow passes against the loop, on any cut into blocks."""
    import pandas as pd

    rows, at, block, offset = [], 0, 0, 0
    while at < len(sizes):
        length = block_lengths[block % len(block_lengths)]
        rows += [("f", block, offset, at + n + 1, size) for n, size in enumerate(sizes[at : at + length])]
        offset += sum(sizes[at : at + length])
        at, block = at + length, block + 1
    lines = pd.DataFrame(rows, columns=["file", "block", "block_off", "line_no", "n_bytes"])
    before, C.PART_CHUNKS = C.PART_CHUNKS, part_chunks
    try:
        tables = pd.concat(C._summarize(limit)(iter([lines[:7], lines[7:]])))
    finally:
        C.PART_CHUNKS = before
    parts = pd.concat(C._compose(limit)(iter([tables[:3], tables[3:]])))
    parts = parts.rename(columns={"part": "block"}).assign(part=0, part_open=0, part_id=0)
    between = pd.concat(C._follow(limit)(iter([parts]))).drop(columns="part")
    between = between.rename(columns={"block": "part", "entry_open": "part_open", "entry_id": "part_id"})
    entries = pd.concat(C._follow(limit)(iter([tables.merge(between, on=["file", "part"])])))
    expected, starts, total = sequential(sizes, limit), {}, 0
    for size, chunk in zip(sizes, expected):
        starts.setdefault(chunk, total)
        total += size
    for row in entries.itertuples():
        first = lines[lines.block == row.block].line_no.iloc[0]
        chunk = expected[first - 2] if first > 1 else 0
        assert (row.entry_id, row.entry_open) == (chunk, starts[chunk])
    assert len(entries) == block


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_parts_of_parts(spark, monkeypatch, tmp_path, levels):
    """However often parts are taken together, the result is that of the loop; no task sees more than FAN tables of a level."""
    monkeypatch.setattr(C, "PART_CHUNKS", 2)
    monkeypatch.setattr(C, "FAN", 3)
    monkeypatch.setattr(C, "LEVELS", levels)
    files = {"long": [1 + (n * 7919) % 97 for n in range(3_000)], "short": [5, 5], "large": [300] * 40, "even": [25] * 400}
    check(spark, files, 4, 100)
    lines = frame(spark, files, 4)
    assert C._levels(lines, 100) == 7
    found = {(r.file, r.line_no): r.chunk_id for r in C.chunk_next_fit(lines, 100, str(tmp_path / "sizes")).collect()}
    assert found == {(name, n + 1): chunk for name, sizes in files.items() for n, chunk in enumerate(sequential(sizes, 100))}


def test_blocks_are_dealt_anew_behind_joins(spark, tmp_path):
    """A sorted join found small at run time reads rows where they lie, so each function over partitions has its own exchange."""
    frame(spark, {"f": [10] * 40}, 3).write.parquet(f"{tmp_path}/lines")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        spans = C.chunk_spans(spark.read.parquet(f"{tmp_path}/lines"), 100)
        plan = spans._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan
    assert plan.count("REPARTITION_BY_COL") == plan.count("MapInPandas")
