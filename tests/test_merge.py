"""Deduplication, the stored table, statistics and retrieval on small hand-made records."""

import pytest
from pyspark.sql import functions as F

from tidelog.operators import clean, retrieve, runs, stats
from tidelog.operators import dedup as D
from tidelog.operators.chunking import chunk_budget, with_block_offsets
from tidelog.operators.chunkmap import (
    answers_to_entries,
    chunk_payloads,
    infer_chunks,
    map_chunks,
    render_prompts,
    result_records,
    split_results,
    unstorable_entries,
)
from tidelog.schema import LOG_FIELDS
from tidelog.sources import store as S

RECORD = "file string, chunk_id long, pos long, " + ", ".join(f"{name} string" for name in LOG_FIELDS)


def record(pos, message="m", service="s", level="INFO", timestamp="2024-01-01T00:00:00", chunk=0, user=None):
    return ("f", chunk, pos, timestamp, level, message, service, user, None, None)


def frame(spark, rows):
    return spark.createDataFrame(rows, RECORD)


def test_first_record_of_a_hash_wins(spark):
    rows = [record(2, user="late"), record(1, user="early"), record(0, chunk=1, user="next chunk"), record(3, service=None)]
    kept = D.dedup_first_wins(D.with_hash(frame(spark, rows)))
    assert {(r.user_id, r.service) for r in kept.collect()} == {("early", "s"), (None, None)}


def test_hot_hash_is_cut_before_the_shuffle(spark):
    hot = spark.range(0, 50_000, 1, 8).select(
        F.lit("f").alias("file"), F.lit(0).cast("long").alias("chunk_id"), F.col("id").alias("pos"),
        F.lit("t").alias("timestamp"), F.lit("INFO").alias("level"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("message"), F.lit("s").alias("service"),
    )
    kept = D.dedup_first_wins(D.with_hash(hot))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan
    assert kept.count() == 50_000 - 16_667 + 1
    assert kept.filter("message = 'hot'").first().pos == 0


def test_merging_twice_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "store")
    first = frame(spark, [record(0, "a"), record(1, "a"), record(2, "b"), record(3, None)])
    second = frame(spark, [record(0, "b"), record(1, "c")])
    S.merge_batch(first, root, "r", 0)
    S.merge_batch(second, root, "r", 1)
    expected = [("a", 0), ("b", 0), ("c", 1)]
    stored = lambda: sorted((r.message, r.batch_id) for r in S.read_store(spark, root).collect())
    assert stored() == expected
    S.merge_batch(second, root, "r", 1)
    S.merge_batch(first, root, "r", 0)  # an older batch repeated after a newer one
    assert stored() == expected
    S.merge_batch(first, root, "another run", 0)
    assert stored() == expected
    row = S.read_store(spark, root).filter("message = 'a'").first()
    assert row.raw_data.startswith('{"timestamp":"2024-01-01T00:00:00"') and row.created_at
    S.reset_store(spark, root)
    assert stored() == []
    S.merge_batch(first, root, "r", 0)
    assert len(stored()) == 2


def test_opening_never_overwrites(spark, tmp_path):
    root = tmp_path / "store"
    assert S.open_store(spark, str(root)).count() == 0
    S.merge_batch(frame(spark, [record(0, "a")]), str(root), "r", 0)
    assert S.open_store(spark, str(root)).count() == 1
    (tmp_path / "file").write_text("no table")
    with pytest.raises(Exception):
        S.open_store(spark, str(tmp_path / "file")).count()
    assert (tmp_path / "file").read_text() == "no table"


@pytest.mark.parametrize("result", [None, [], "text", {"cleaned_logs": ["x"]}, {"cleaned_logs": 7}, {"cleaned_logs": [], "tokens_used": "many"}])
def test_malformed_chunk_results_are_failed_rows(spark, result):
    lines = spark.createDataFrame([("f", 0, n, f"line {n}", 7, "text") for n in range(3)], "file string, chunk_id long, line_no long, line string, n_bytes long, type string")
    row = map_chunks(lines, lambda chunk: result).first()
    assert (row.success, row.cleaned_line_count, row.original_line_count) == (False, 0, 3) and row.error


def test_texts_and_tokens_of_chunk_results(spark):
    lines = spark.createDataFrame([("f", 0, 0, "line", 5, "text")], "file string, chunk_id long, line_no long, line string, n_bytes long, type string")
    row = map_chunks(lines, lambda chunk: {"cleaned_logs": [{"message": True, "extra": [1]}], "tokens_used": None}).first()
    assert (row.success, row.tokens_used, row.cleaned[0].message, row.cleaned[0].raw_data) == (True, 0, "1", '{"message": true, "extra": [1]}')


def test_times_are_inferred_only_when_missing(spark):
    lines = [
        ("f", 0, 1, "2024-01-01T00:00:00.000001Z INFO first", 30, "text"),
        ("f", 0, 2, "level=info msg=second", 30, "text"),
        ("f", 0, 3, "<14>Jan  1 00:00:00 host app: third", 30, "text"),
        ("f", 0, 4, "ts=yesterday level=info msg=fourth", 30, "text"),
    ]
    chunked = chunk_budget(with_block_offsets(spark.createDataFrame(lines, LINES)), 10_000)
    rows = {r.line_no: (r.timestamp, r.time_inferred, r.reject_reason) for r in clean.clean_lines(chunked).collect()}
    assert rows == {
        1: ("2024-01-01T00:00:00.000001Z", False, None),
        2: ("2024-01-01T00:00:00.000001Z", True, None),
        3: (None, False, "unreadable timestamp"),
        4: (None, False, "unreadable timestamp"),
    }
    dated = chunked.withColumn("file_time", F.lit("2021-05-05").cast("timestamp"))
    assert {r.line_no: r.timestamp for r in clean.clean_lines(dated).collect()}[3] == "2021-01-01T00:00:00.000000Z"


def test_fates_and_counters(spark):
    records = D.with_hash(frame(spark, [record(0, "a"), record(1, "a"), record(2, "b"), record(3, None), record(4, "c")]))
    stored = records.filter("message = 'b'")
    fates = {r.fate: (r["count"], r.copies) for r in D.hash_fates(records, stored).groupBy("fate").agg(F.count("*").alias("count"), F.sum("copies").alias("copies")).collect()}
    assert fates == {"stored": (2, 3), "dup_in_store": (1, 1), "invalid": (1, 1)}
    results = spark.createDataFrame(
        [("f", 0, 9, 5, True, None), ("f", 1, 4, 0, False, "boom")],
        "file string, chunk_id long, original_line_count long, cleaned_line_count long, success boolean, error string",
    )
    row = D.merge_stats(results, records, stored).first().asDict()
    assert row == {
        "total_chunks_processed": 2, "total_raw_logs": 9, "total_cleaned_logs": 5, "total_input_lines": 13,
        "failed_chunks": 1, "duplicates_removed": 1, "duplicates_in_store": 1, "unstorable_logs": 1,
        "invalid_logs_filtered": 2, "final_log_count": 2,
    }
    assert [tuple(r) for r in D.processing_errors(results).collect()] == [("f", 1, "boom")]


def test_retrieval_rules(spark):
    rows = [
        record(n, str(n), service, level, f"2024-01-0{n + 1}")
        for n, (level, service) in enumerate([("info", "A"), ("INFO", "a"), ("ERROR", "A"), ("INFO", None)])
    ]
    records = frame(spark, rows)
    got = lambda **kw: [r.message for r in retrieve.retrieve(records, **kw).collect()]
    assert got() == ["3", "2", "1", "0"]
    assert got(level="Info") == ["3", "1", "0"]
    assert got(level="info", stored_as_is=True) == ["3", "1"]
    assert got(service="A") == ["2", "0"]
    assert got(level="", service="", limit=0) == got(limit=None) == ["3", "2", "1", "0"]
    assert got(limit=2, level="info") == ["3", "1"]
    with pytest.raises(ValueError):
        got(limit=-1)
    assert tuple(retrieve.retrieval_counts(records, 2, "info").first()) == (3, 2)
    plan = retrieve.retrieve(records, 2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_statistics_of_an_empty_and_a_filled_store(spark):
    empty = frame(spark, [])
    row = stats.statistics(empty).first()
    assert (row.total_logs, row.level_distribution, row.top_services, row.earliest) == (0, {}, [], None)
    row = stats.memory_statistics(empty).first()
    assert (row.total_logs, row.level_distribution, row.top_services, row.storage_type) == (0, None, None, "memory")
    filled = frame(spark, [record(n, str(n), f"svc{n % 12:02}", "INFO" if n % 2 else None, "" if n == 0 else f"t{n}") for n in range(30)])
    row = stats.memory_statistics(filled).first()
    assert row.level_distribution == {"INFO": 15, "UNKNOWN": 15} and row.earliest == "t1"
    assert [(s.service, s.n) for s in row.top_services] == [(f"svc{n:02}", 3) for n in range(6)] + [(f"svc{n:02}", 2) for n in range(6, 10)]


LINES = "file string, block long, line_no long, line string, n_bytes long, type string"


def test_chunk_functions_and_scorers(spark):
    rows = [("f", 0, n + 1, f"  line {n}\t", 10, "text") for n in range(20)]
    chunked = chunk_budget(with_block_offsets(spark.createDataFrame(rows, LINES)), 50)

    def function(chunk):
        if chunk["chunk_id"] == 2:
            raise RuntimeError("no luck")
        return {"cleaned_logs": [{"message": line, "extra": 1} for line in chunk["content"]], "tokens_used": chunk["line_count"]}

    results = map_chunks(chunked, function)
    done, failed = split_results(results)
    assert {r.chunk_id: r.tokens_used for r in done.collect()} == {0: 5, 1: 5, 3: 5}
    assert [(r.chunk_id, r.error, r.original_line_count) for r in failed.collect()] == [(2, "no luck", 5)]
    assert [r.message for r in result_records(results).filter("chunk_id = 3").orderBy("pos").collect()] == [f"line {n}" for n in range(15, 20)]

    def broken():
        raise OSError("no key")

    answers = infer_chunks(render_prompts(chunk_payloads(chunked)), broken)
    assert {(r.success, r.error) for r in answers.collect()} == {(False, "scorer initialization failed: no key")}


def test_clean_lines_end_to_end(spark):
    text = [
        ("f", 0, 1, "2024-01-01T00:00:00Z ERROR [api] boom user_id=7", 50, "text"),
        ("f", 0, 2, "2024-01-01T00:00:00Z ERROR [api] boom user_id=7", 50, "text"),
        ("f", 0, 3, "level=warn msg=\"no time\"", 25, "text"),
        ("f", 0, 4, "   at some.stack.Trace", 25, "text"),
        ("f", 0, 5, "2024-01-01T00:00:01Z HELLO odd level", 30, "text"),
        ("g", 0, 1, '{"ts":1704067200,"msg":"a","level":"warning","ip":"1.2.3.4"}', 60, "jsonl"),
        ("g", 0, 2, '{"msg":"a","level":"warning","user_id":5}', 40, "jsonl"),
        ("g", 0, 3, '{"ts":1704067200,"msg":""}', 40, "jsonl"),
        ("g", 0, 4, "{broken", 40, "jsonl"),
    ]
    chunked = chunk_budget(with_block_offsets(spark.createDataFrame(text, LINES)), 10_000)
    records = clean.clean_lines(chunked)
    reasons = {(r.file, r.line_no): r.reject_reason for r in records.collect()}
    assert reasons == {
        ("f", 1): None, ("f", 2): None, ("f", 3): None, ("f", 4): "malformed", ("f", 5): None,
        ("g", 1): None, ("g", 2): None, ("g", 3): "missing message", ("g", 4): "malformed",
    }
    kept = {(r.file, r.line_no): r for r in clean.dedup_by_type(clean.good(records)).collect()}
    assert set(kept) == {("f", 1), ("f", 3), ("f", 5), ("g", 1)}
    # A word that is no level is not taken for one: the line has a time and a message, and the default level.
    assert (kept["f", 5].level, kept["f", 5].message) == ("INFO", "HELLO odd level")
    assert kept["f", 3].timestamp == "2024-01-01T00:00:00.000000Z" and kept["f", 3].level == "WARN"
    assert (kept["f", 1].service, kept["f", 1].user_id, kept["f", 1].message) == ("api", "7", "boom user_id=7")
    assert (kept["g", 1].source_ip, kept["g", 1].service, kept["g", 1].user_id) == ("1.2.3.4", "unknown", None)


@pytest.mark.parametrize(
    "seconds, workers, begins",
    [((80.0, 10.0), 8, "Excellent"), ((50.0, 10.0), 8, "Good"), ((15.0, 10.0), 8, "Moderate"), ((10.0, 10.0), 8, "Limited"), ((10.0, 0.0), 8, "Limited")],
)
def test_run_comparison(spark, seconds, workers, begins):
    rows = [("k", "sequential", seconds[0], 1), ("k", "parallel", seconds[1], workers)]
    table = spark.createDataFrame(rows, "k string, processing_method string, processing_time_seconds double, parallel_workers long")
    row = runs.run_compare(table, ["k"]).first()
    speedup = seconds[0] / seconds[1] if seconds[1] else 0.0
    assert row.speedup_factor == speedup and row.recommendation.startswith(begins)
    assert f"{speedup:.1f}x" in row.recommendation
    assert row.time_saved_seconds == seconds[0] - seconds[1]


def test_unknown_run_is_an_error(spark):
    audit = spark.createDataFrame([("p1", "t")], "processing_id string, completed_at string")
    assert runs.run_info(audit, "p1")["completed_at"] == "t"
    with pytest.raises(KeyError):
        runs.run_info(audit, "p2")


def test_nested_members_are_not_storable(spark):
    import json

    entries = [
        {"timestamp": "t", "level": "INFO", "message": "m", "service": True, "user_id": 7},
        {"timestamp": "t", "level": "INFO", "message": ["m"]},
        {"timestamp": "t", "level": "INFO", "message": "m", "service": {"name": "s"}},
    ]
    answers = spark.createDataFrame([("f", 0, json.dumps(entries), True)], "file string, chunk_id long, response string, success boolean")
    kept = answers_to_entries(answers).collect()
    assert [(r.pos, r.service, r.user_id) for r in kept] == [(0, "1", "7")]
    refused = {r.pos: r.reject_reason for r in unstorable_entries(answers).collect()}
    assert refused == {1: "message is not a scalar", 2: "service is not a scalar"}


def test_both_store_lookups_agree(spark):
    records = D.with_hash(frame(spark, [record(n, str(n)) for n in range(50)]))
    stored = D.with_hash(frame(spark, [record(n, str(n)) for n in range(20, 90)]))
    for lookup in (D.dedup_vs_store, D.dedup_small_vs_store):
        assert sorted(r.pos for r in lookup(records, stored).collect()) == list(range(20))
