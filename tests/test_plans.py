"""Shapes of plans that matter at scale."""

import re

import pytest

from tidelog.plans import catalog
from tidelog.schema import LOG_FIELDS

DIRECTORY = "/root/testdata/sf0.001"
PYTHON = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas")
JVM_ONLY = [
    "log_hash", "dedup_first_wins", "dedup_vs_store", "merge_stats", "statistics", "retrieve", "explode_lines", "line_number",
    "chunk_budget", "normalize_timestamp", "parse_text_line", "clean_log_lines", "validate_entry_json", "scan_jsonl",
]


def plan_of(spark, name):
    return catalog.queries()[name](spark, DIRECTORY)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", JVM_ONLY)
def test_hot_paths_stay_in_the_jvm(spark, name):
    plan = plan_of(spark, name)
    assert not any(operator in plan for operator in PYTHON)
    assert "CartesianProduct" not in plan


def test_no_query_uses_row_at_a_time_python(spark):
    for name in ("detect_format", "chunk_next_fit", "chunk_json_items", "map_chunks", "infer_chunks"):
        assert "BatchEvalPython" not in plan_of(spark, name)


def test_scans_read_only_what_is_needed(spark):
    plan = plan_of(spark, "count_by_service")
    assert "props" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_text_does_not_travel_for_chunk_metadata(spark):
    frame = catalog.queries()["chunk_metadata"](spark, DIRECTORY)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    for part in plan.split("Exchange hashpartitioning")[1:]:
        below = part.split("\n")[1]
        assert not re.search(r"[\[ ]line#\d+[,\]]", below)


def test_top_k_and_partial_limits(spark):
    assert "TakeOrderedAndProject" in plan_of(spark, "newest_first_topk")
    assert "WindowGroupLimit" in plan_of(spark, "dedup_first_wins")
    assert "LeftAnti" in plan_of(spark, "dedup_vs_store")


def test_stored_table_is_read_by_column(spark, tmp_path):
    from tidelog.operators import dedup, retrieve, stats
    from tidelog.sources import store

    root = str(tmp_path / "store")
    fields = "file string, chunk_id long, pos long, " + ", ".join(f"{name} string" for name in LOG_FIELDS)
    rows = [("f", 0, 0, "t", "ERROR", "m", "api", None, None, None)]
    for batch in (0, 1):
        store.merge_batch(spark.createDataFrame(rows, fields), root, "r", batch)
    records = store.read_store(spark, root)

    def schemas(frame):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        return plan, re.findall(r"ReadSchema: struct<([^>]*)>", plan)

    _, read = schemas(stats.statistics(records))
    assert sorted(read) == ["level:string,service:string", "timestamp:string"]
    plan, _ = schemas(stats.statistic_rows(records))
    assert "SortAggregate" not in plan
    plan, _ = schemas(retrieve.retrieve(records, 10, "error", "api", stored_as_is=True))
    assert "EqualTo(level,ERROR)" in plan and "EqualTo(service,api)" in plan
    plan, _ = schemas(dedup.dedup_vs_store(records.filter("batch_id = 1"), records.filter("batch_id = 0")))
    assert "ReadSchema: struct<log_hash:string>" in plan and "PartitionFilters: [isnotnull(batch_id" in plan


def test_python_gets_few_bytes_at_a_time(spark):
    """Long documents: the batches that reach Python are bounded by bytes, not by the number of rows alone."""
    import pandas as pd
    from pyspark.sql import functions as F

    from tidelog.session import prepare

    @F.pandas_udf("long")
    def held(texts: pd.Series) -> pd.Series:
        return pd.Series([texts.str.len().sum()] * len(texts))

    frame = prepare(spark).range(0, 400, 1, 1).select(F.repeat(F.lit("x"), F.lit(100_000) + F.col("id").cast("int")).alias("text"))
    assert frame.select(held("text").alias("n")).agg(F.max("n")).first()[0] < 12 << 20
