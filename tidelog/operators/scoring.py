"""Scoring that can be taken up again: answers are kept in a table by the hash of their prompt.

Prompts without an answer are dealt to waves by that hash; each wave calls the scorer and appends what it got to the table
before the next begins. Whatever stops a run, another run over the same table calls the scorer only for prompts that
have no answer yet: at most the wave that was under way is paid for twice.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.chunkmap import Scorer
from tidelog.sources.scratch import path_exists

ANSWERS = "prompt_hash string, response string, tokens_used long, processing_time_seconds double, success boolean, error string, attempts int"
WAVE_PROMPTS = 10_000
IN_FLIGHT = 4
ATTEMPTS = 3
# Seconds before the second attempt; doubled for each further one.
WAIT = 0.5


def prompt_hash() -> Column:
    return F.sha2("prompt", 256)


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """One successful answer per prompt hash; no rows where no table is."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], ANSWERS)
    answers = spark.read.schema(ANSWERS).parquet(path).where("success")
    # A wave that was written and run again has two answers to a prompt: the same one of them is always taken.
    row = F.struct("attempts", "tokens_used", "response", "processing_time_seconds")
    chosen = answers.groupBy("prompt_hash").agg(F.min(row).alias("a"))
    return chosen.select("prompt_hash", "a.response", "a.tokens_used", "a.processing_time_seconds", F.lit(True).alias("success"), F.lit(None).cast("string").alias("error"), "a.attempts")


def attempted(scorer: Scorer, prompt: str, attempts: int, wait: float) -> tuple:
    """(response, tokens, seconds, success, error, attempts) of a call that is repeated when it fails."""
    began = time.monotonic()
    for number in range(1, attempts + 1):
        try:
            response, tokens = scorer(prompt)
            return response, tokens, time.monotonic() - began, True, None, number
        except Exception as problem:
            error = str(problem)
        if number < attempts:
            time.sleep(wait * 2 ** (number - 1))
    return None, 0, time.monotonic() - began, False, error, attempts


def called(prompts: DataFrame, make_scorer: Callable[[], Scorer], in_flight: int = IN_FLIGHT, attempts: int = ATTEMPTS, wait: float = WAIT) -> DataFrame:
    """ANSWERS rows of (prompt_hash, prompt): a client per partition, at most `in_flight` calls at a time, answers in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer, broken = None, None
        try:
            scorer = make_scorer()
        except Exception as problem:  # every prompt of the partition reports it
            broken = f"scorer initialization failed: {problem}"
        names = [column.split()[0] for column in ANSWERS.split(", ")]
        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                rows, waiting = [], deque()
                for key, prompt in zip(batch["prompt_hash"], batch["prompt"], strict=True):
                    if broken:
                        rows.append((key, None, 0, 0.0, False, broken, 0))
                        continue
                    if len(waiting) == in_flight:
                        first, call = waiting.popleft()
                        rows.append((first, *call.result()))
                    waiting.append((key, pool.submit(attempted, scorer, prompt, attempts, wait)))
                rows += [(first, *call.result()) for first, call in waiting]
                yield pd.DataFrame(rows, columns=names)

    return prompts.select("prompt_hash", "prompt").mapInPandas(run, ANSWERS)


def infer_resumable(
    prompts: DataFrame,
    make_scorer: Callable[[], Scorer],
    path: str,
    wave_prompts: int = WAVE_PROMPTS,
    in_flight: int = IN_FLIGHT,
    attempts: int = ATTEMPTS,
    wait: float = WAIT,
) -> DataFrame:
    """As `infer_chunks`, with the answers kept at `path`. Equal prompts are answered once, failed ones again in the next run.

    Failed calls are rows with success=False. Prompts are hashed, so the table serves any chunks with the same prompts.
    """
    spark = prompts.sparkSession
    hashed = prompts.withColumn("prompt_hash", prompt_hash())
    # A hash belongs to one prompt; a third of all chunks with the same prompt is one call.
    once = hashed.groupBy("prompt_hash").agg(F.first("prompt").alias("prompt"))
    open_ = once.join(read_answers(spark, path), "prompt_hash", "left_anti")
    waves = max(1, -(-open_.count() // wave_prompts))
    for wave in range(waves):
        # Dealt by hash, waves do not overlap.
        part = open_.where(F.pmod(F.xxhash64("prompt_hash"), F.lit(waves)) == wave)
        called(part, make_scorer, in_flight, attempts, wait).write.mode("append").parquet(path)
    answers = read_answers(spark, path)
    failed = spark.read.schema(ANSWERS).parquet(path).where("not success").join(answers, "prompt_hash", "left_anti")
    failed = failed.groupBy("prompt_hash").agg(F.min(F.struct("error", "attempts", "processing_time_seconds")).alias("f"))
    failed = failed.select("prompt_hash", F.lit(None).cast("string").alias("response"), F.lit(0).cast("long").alias("tokens_used"), "f.processing_time_seconds", F.lit(False).alias("success"), "f.error", "f.attempts")
    answered = answers.unionByName(failed).drop("attempts")
    columns = ["response", "tokens_used", "processing_time_seconds", "success", "error"]
    return hashed.select("file", "chunk_id", "line_count", "prompt_hash").join(answered, "prompt_hash").select("file", "chunk_id", "line_count", *columns)
