"""Incremental runs: new files only, replayed batches, bounded state."""

from conftest import write_files
from pyspark.sql import functions as F

from tidelog.operators import clean
from tidelog.operators.chunking import chunk_budget
from tidelog.schema import LOG_FIELDS
from tidelog.sources.files import number_rows
from tidelog.sources.store import read_store
from tidelog.streaming import incremental as I


def to_records(batch):
    lines = number_rows(batch).withColumn("type", F.lit("text"))
    records = clean.good(clean.clean_lines(chunk_budget(lines, 1_000)))
    return records.select("file", "chunk_id", F.col("line_no").alias("pos"), *LOG_FIELDS)


def line(second, message):
    return f"2024-01-01T00:00:{second:02}Z INFO [api] {message}\n"


def test_second_run_adds_only_what_is_new(spark, tmp_path):
    source, root, checkpoint = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "checkpoint")
    source.mkdir()
    write_files(source, {"one.log": line(1, "a") + line(2, "b") + line(1, "a")})

    def run():
        I.merge_stream(I.stream_rows(spark, str(source)), root, "s", checkpoint, to_records).awaitTermination()
        return sorted((r.message, r.batch_id) for r in read_store(spark, root).collect())

    assert run() == [("a", 0), ("b", 0)]
    assert run() == [("a", 0), ("b", 0)]
    write_files(source, {"two.log": line(2, "b") + line(3, "c")})
    assert run() == [("a", 0), ("b", 0), ("c", 1)]


def test_bounded_deduplication_and_windows(spark, tmp_path):
    rows = spark.range(6).select(
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 1800).alias("event_time"),
        F.lit("t").alias("timestamp"), F.lit("INFO").alias("level"), F.lit("same").alias("message"), F.lit("s").alias("service"),
    )
    source = str(tmp_path / "rows")
    rows.coalesce(1).write.parquet(source)
    stream = I.stream_table(spark, source, rows.schema, "*.parquet")
    kept, counts = str(tmp_path / "kept"), str(tmp_path / "counts")
    I.append_stream(I.dedup_bounded(stream, delay="10 hours"), kept, str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(kept).count() == 1
    I.append_stream(I.stream_counts(stream), counts, str(tmp_path / "c2")).awaitTermination()
    found = {r.window_start: r.n for r in spark.read.parquet(counts).collect()}
    assert found == {"2024-01-01T00:00:00": 2}


def test_a_micro_batch_has_a_file_for_every_core(spark, monkeypatch):
    from tidelog.plans import stream_queries

    asked = []
    rows = stream_queries.I.stream_rows
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", 12)
    monkeypatch.setattr(stream_queries.I, "stream_rows", lambda *args, max_files: asked.append(max_files) or rows(*args, max_files=max_files))
    found = stream_queries.stream_clean_merge(spark, "/root/testdata/sf0.001")
    assert asked == [12]
    assert found.count() == found.distinct().count() > 0
