"""Run metrics and the audit table of processing runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.text import iso_now, one_decimal, ratio

# Speedup thresholds, the first one relative to the number of workers.
EXCELLENT_PER_WORKER = 0.7
GOOD_SPEEDUP = 2.0
MODERATE_SPEEDUP = 1.2


def run_rates(runs: DataFrame) -> DataFrame:
    """Adds chunks_per_second and success_rate, both 0 when nothing was measured."""
    seconds = F.when(F.col("processing_time_seconds") > 0, F.col("processing_time_seconds"))
    return runs.withColumn("chunks_per_second", ratio(F.col("total_chunks"), seconds)).withColumn(
        "success_rate", ratio(F.col("successful_chunks"), F.col("total_chunks"))
    )


def recommendation(speedup: Column, workers: Column) -> Column:
    # The four texts.
    factor = one_decimal(speedup)
    return (
        F.when(
            speedup > workers * EXCELLENT_PER_WORKER,
            F.concat(
                F.lit("Excellent parallel performance! "), factor, F.lit("x speedup with "), workers.cast("string"), F.lit(" workers."),
            ),
        )
        .when(
            speedup > GOOD_SPEEDUP, F.concat(F.lit("Good parallel performance. "), factor, F.lit("x speedup achieved."))
        )
        .when(
            speedup > MODERATE_SPEEDUP,
            F.concat(F.lit("Moderate parallel benefit. "), factor, F.lit("x speedup. Consider optimizing worker tasks.")),
        )
        .otherwise(
            F.concat(
                F.lit("Limited parallel benefit. "), factor, F.lit("x speedup. Sequential processing may be sufficient."),
            )
        )
    )


def run_compare(runs: DataFrame, keys: Sequence[str], workers: str = "parallel_workers") -> DataFrame:
    """Sequential against parallel seconds per key, with speedup, efficiency and a recommendation."""
    seconds = F.col("processing_time_seconds")
    method = F.col("processing_method")
    paired = runs.groupBy(*keys).agg(
        F.sum(F.when(method == "sequential", seconds)).alias("sequential_seconds"),
        F.sum(F.when(method == "parallel", seconds)).alias("parallel_seconds"),
        F.max(F.when(method == "parallel", F.col(workers))).alias("workers"),
    )
    measured = paired.filter("sequential_seconds is not null and parallel_seconds is not null")
    speedup = ratio(F.col("sequential_seconds"), F.when(F.col("parallel_seconds") > 0, F.col("parallel_seconds")))
    return (
        measured.withColumn("speedup_factor", speedup)
        .withColumn("efficiency_percent", ratio(F.col("speedup_factor"), F.when(F.col("workers") > 0, F.col("workers"))) * 100)
        .withColumn("time_saved_seconds", F.col("sequential_seconds") - F.col("parallel_seconds"))
        .withColumn("recommendation", recommendation(F.col("speedup_factor"), F.col("workers")))
    )


def run_records(runs: DataFrame, completed_at: Column | None = None) -> DataFrame:
    """Audit rows. Input: file_id, original_name, chunk_count, use_parallel, processing_time_seconds,
    final_log_count, started_at (TIMESTAMP)."""
    return runs.select(
        F.concat_ws("_", F.lit("proc"), F.date_format("started_at", "yyyyMMdd_HHmmss"), "file_id").alias("processing_id"),
        "file_id",
        "original_name",
        F.col("chunk_count").cast("long").alias("chunk_count"),
        F.when(F.col("use_parallel"), F.lit("parallel")).otherwise(F.lit("sequential")).alias("processing_method"),
        F.col("processing_time_seconds").cast("double").alias("processing_time_seconds"),
        (F.col("processing_time_seconds").cast("double") / 60).alias("estimated_time_minutes"),
        F.col("final_log_count").cast("long").alias("final_log_count"),
        (iso_now() if completed_at is None else completed_at).alias("completed_at"),
        F.lit("completed").alias("status"),
    )


def append_runs(records: DataFrame, path: str) -> None:
    records.write.mode("append").parquet(path)


def list_runs(audit: DataFrame) -> DataFrame:
    return audit.orderBy("completed_at", "processing_id")


def find_run(audit: DataFrame, processing_id: str) -> DataFrame:
    """Audit rows of one run (lazy; an unknown id gives no row)."""
    return audit.filter(F.col("processing_id") == F.lit(processing_id))


def run_info(audit: DataFrame, processing_id: str) -> dict:
    """Driver-side lookup of one run; unknown ids raise KeyError."""
    found = find_run(audit, processing_id).head(1)
    if not found:
        raise KeyError(f"unknown run: {processing_id}")
    return found[0].asDict()
