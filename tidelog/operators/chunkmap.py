"""Apply a user function or a text scorer to every chunk.

Chunks are byte-limited (`tidelog.operators.chunking`), which bounds each group that is handed to
Python. Spark's tasks take the place of a worker pool.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.json_values import entry_problem, sqlite_text, storage_problem
from tidelog.functions.text import strip
from tidelog.operators.dedup import successful
from tidelog.operators.parse import listed_entries, model_entries
from tidelog.operators.validate import valid_entries
from tidelog.schema import CHUNK_RESULT_SCHEMA, LOG_FIELDS

Scorer = Callable[[str], tuple[str, int]]

_FIELD_RULES = (
    "timestamp: ISO 8601; level: one of ERROR, WARN, INFO, DEBUG; message: the main text; "
    "service: the emitting service, or unknown; user_id and request_id: null when absent"
)
STRUCTURED_INSTRUCTION = (
    "The lines below are JSON log events. Keep one event per timestamp and message, drop incomplete ones, "
    f"and give every event these fields - {_FIELD_RULES}. Answer with a JSON array only.\n\n"
)
TEXT_INSTRUCTION = (
    "The lines below are plain log text. Extract one JSON object per event, drop repeated and broken lines, "
    f"and use these fields - {_FIELD_RULES}; source_ip when present. Answer with a JSON array only.\n\n"
)

_ANSWER = (
    "file string, chunk_id long, line_count long, response string, tokens_used long, "
    "processing_time_seconds double, success boolean, error string"
)


def chunk_payloads(chunked: DataFrame) -> DataFrame:
    """One row per chunk: its stripped lines in order joined by newlines, and their count.

    The byte limit of a chunk bounds what is collected.
    """
    ordered = F.array_sort(F.collect_list(F.struct("line_no", strip(F.col("line")).alias("line"))))
    return (
        chunked.groupBy("file", "chunk_id", "type")
        .agg(ordered.alias("_lines"))
        .select(
            "file",
            "chunk_id",
            "type",
            F.size("_lines").cast("long").alias("line_count"),
            F.array_join(F.transform("_lines", lambda x: x["line"]), "\n").alias("payload"),
        )
    )


def prompt_text(chunk_type: Column, payload: Column) -> Column:
    head = F.when(chunk_type.isin("json", "jsonl"), F.lit(STRUCTURED_INSTRUCTION)).otherwise(F.lit(TEXT_INSTRUCTION))
    return F.concat(head, payload)


def render_prompts(payloads: DataFrame) -> DataFrame:
    return payloads.withColumn("prompt", prompt_text(F.col("type"), F.col("payload"))).drop("payload")


def infer_chunks(prompts: DataFrame, make_scorer: Callable[[], Scorer]) -> DataFrame:
    """Call a scorer (prompt -> text, tokens) for each chunk, one client per partition.

    A failing call, or a client that cannot be created, becomes a row with success=False.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer, broken = None, None
        try:
            scorer = make_scorer()
        except Exception as problem:  # every chunk of the partition reports it
            broken = f"scorer initialization failed: {problem}"
        for pdf in batches:
            answers = []
            for prompt in pdf["prompt"]:
                began = time.monotonic()
                text, tokens, error = None, 0, broken
                if scorer is not None:
                    try:
                        text, tokens = scorer(prompt)
                    except Exception as problem:
                        error = str(problem)
                answers.append((text, tokens, time.monotonic() - began, error is None, error))
            columns = ["response", "tokens_used", "processing_time_seconds", "success", "error"]
            frame = pd.DataFrame(answers, columns=columns, index=pdf.index)
            yield pd.concat([pdf[["file", "chunk_id", "line_count"]], frame], axis=1)

    return prompts.select("file", "chunk_id", "line_count", "prompt").mapInPandas(run, _ANSWER)


def _answered(answers: DataFrame) -> DataFrame:
    return valid_entries(model_entries(successful(answers).select("file", "chunk_id", "response")))


def answers_to_entries(answers: DataFrame) -> DataFrame:
    """Valid entries of the successful answers that the store accepts, standard fields as text."""
    entries = _answered(answers).filter(storage_problem(F.col("entry")).isNull())
    return entries.select(
        "file",
        "chunk_id",
        F.col("entry_pos").alias("pos"),
        "raw",
        *[sqlite_text(F.col("entry"), name).alias(name) for name in LOG_FIELDS],
    )


def unstorable_entries(answers: DataFrame) -> DataFrame:
    """Valid entries that the store refuses, with the reason."""
    reason = storage_problem(F.col("entry"))
    return _answered(answers).select(
        "file", "chunk_id", F.col("entry_pos").alias("pos"), "raw", reason.alias("reject_reason")
    ).filter("reject_reason is not null")


def answers_to_results(answers: DataFrame) -> DataFrame:
    """Chunk results: lines in, valid records out, tokens, time, success, error.

    Counts inside each row, so the scorer runs once. Write the answers to a table first when both
    results and entries are wanted.
    """
    valid = F.filter(listed_entries(F.col("response")), lambda entry: entry_problem(entry).isNull())
    return answers.select(
        "file",
        "chunk_id",
        F.col("line_count").alias("original_line_count"),
        F.when(F.col("success"), F.coalesce(F.size(valid), F.lit(0))).otherwise(0).cast("long").alias("cleaned_line_count"),
        "processing_time_seconds",
        "tokens_used",
        "success",
        "error",
    )


def stored_text(value: object) -> str | None:
    """A scalar as the store's text columns keep it; other values as JSON."""
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return str(int(value))
    return json.dumps(value) if isinstance(value, (list, dict)) else str(value)


def chunk_result(result: object) -> tuple[list[dict], int, bool, str | None]:
    """(records, tokens, success, error) of what a chunk function returned; raises for anything but the agreed shape."""
    if not isinstance(result, dict):
        raise TypeError(f"a chunk function must return a dict, not {type(result).__name__}")
    records = []
    for entry in result.get("cleaned_logs") or []:
        if not isinstance(entry, dict):
            raise TypeError(f"an entry must be a dict, not {type(entry).__name__}")
        records.append({**{name: stored_text(entry.get(name)) for name in LOG_FIELDS}, "raw_data": json.dumps(entry, default=str)})
    error = result.get("error")
    return records, int(result.get("tokens_used") or 0), bool(result.get("success", True)), None if error is None else str(error)


def map_chunks(chunked: DataFrame, function: Callable[[dict], dict]) -> DataFrame:
    """Apply `function` to each chunk and collect one result row per chunk.

    The function gets {chunk_id, content, size_bytes, line_count, type}, content being the stripped lines, and returns a dict with
    `cleaned_logs` (list of dicts) and optionally `tokens_used`, `success`, `error`. An exception, or a result of another
    shape, becomes a failed row and leaves the other chunks alone. Members beyond the standard fields stay in `raw_data`,
    the whole record as JSON.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line_no")
        chunk = {
            "chunk_id": int(pdf["chunk_id"].iloc[0]),
            "content": pdf["line"].tolist(),
            "size_bytes": int(pdf["n_bytes"].sum()),
            "line_count": len(pdf),
            "type": pdf["type"].iloc[0],
        }
        began = time.monotonic()
        try:
            records, tokens, success, error = chunk_result(function(chunk))
        except Exception as problem:
            records, tokens, success, error = [], 0, False, str(problem)
        row = {
            "file": pdf["file"].iloc[0],
            "chunk_id": chunk["chunk_id"],
            "cleaned": records,
            "original_line_count": chunk["line_count"],
            "cleaned_line_count": len(records),
            "processing_time_seconds": time.monotonic() - began,
            "tokens_used": tokens,
            "success": success,
            "error": error,
        }
        return pd.DataFrame([row])

    columns = ["file", "chunk_id", "type", "line_no", strip(F.col("line")).alias("line"), "n_bytes"]
    return chunked.select(*columns).groupBy("file", "chunk_id").applyInPandas(run, CHUNK_RESULT_SCHEMA)


def split_results(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(successful chunks, failed chunks)."""
    return results.filter("success"), results.filter("not success")


def result_records(results: DataFrame) -> DataFrame:
    """Records of the successful chunks with their position in the chunk."""
    return (
        successful(results)
        .select("file", "chunk_id", F.posexplode("cleaned").alias("_at", "_record"))
        .select("file", "chunk_id", F.col("_at").cast("long").alias("pos"), "_record.*")
    )


def count_in_out(records: DataFrame, is_valid: Column) -> DataFrame:
    """Lines in and valid records out per chunk."""
    return records.groupBy("file", "chunk_id").agg(
        F.count("*").alias("original_line_count"), F.count_if(is_valid).alias("cleaned_line_count")
    )
