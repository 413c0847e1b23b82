"""Statistics over stored records and over chunk results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.text import per_call, ratio
from tidelog.operators.dedup import one_row
from tidelog.operators.retrieve import TOP_SERVICES


def total_count(records: DataFrame) -> DataFrame:
    return records.agg(F.count("*").alias("total_logs"))


def count_by_level(records: DataFrame, missing: str | None = None) -> DataFrame:
    """Records per level as stored (no case folding); `missing` names the NULL group."""
    level = F.coalesce("level", F.lit(missing)) if missing else F.col("level")
    return records.groupBy(level.alias("level")).agg(F.count("*").alias("n"))


def count_by_service(records: DataFrame, missing: str | None = None) -> DataFrame:
    """Records per service; the NULL group stays unless `missing` names it."""
    service = F.coalesce("service", F.lit(missing)) if missing else F.col("service")
    return records.groupBy(service.alias("service")).agg(F.count("*").alias("n"))


def time_range(records: DataFrame, skip_blank: bool = False) -> DataFrame:
    """Smallest and largest timestamp text."""
    stamp = F.nullif(F.col("timestamp"), F.lit("")) if skip_blank else F.col("timestamp")
    return records.agg(F.min(stamp).alias("earliest"), F.max(stamp).alias("latest"))


def statistic_rows(records: DataFrame) -> DataFrame:
    """Level counts, service counts and the grand total in one pass (grouping sets).

    Pairs are counted first, so only a few rows per task are expanded into the sets.
    """
    return rows_of_counts(records.groupBy("level", "service").agg(F.count("*").alias("n")))


def rows_of_counts(pairs: DataFrame) -> DataFrame:
    """`statistic_rows` of records that were counted by level and service before (several rows of a pair add up)."""
    grouped = pairs.groupingSets([["level"], ["service"], []], "level", "service").agg(
        F.grouping_id().alias("_set"), F.sum("n").alias("n")
    )
    return grouped.select(
        F.when(F.col("_set") == 1, "level").when(F.col("_set") == 2, "service").otherwise("total").alias("dimension"),
        F.when(F.col("_set") == 1, F.col("level")).when(F.col("_set") == 2, F.col("service")).alias("key"),
        "n",
    )


def statistics(records: DataFrame, storage_type: str = "table", services_by_name: bool = False) -> DataFrame:
    """One row: total, level map, up to ten services, time range; zero and NULLs for an empty store.

    Counts come from one pass over level and service. Services are ranked and cut to ten on the way,
    in parallel, and levels are few by validation, so the row at the end is assembled from a handful.
    The time range is a pass of its own over the timestamps: text extremes inside a grouped
    aggregate would make Spark sort the records.
    `services_by_name` lists the first services by name instead of the largest.
    """
    pairs = records.groupBy("level", "service").agg(F.count("*").alias("n"))
    return statistics_of_counts(pairs, time_range(records), storage_type, services_by_name)


def statistics_of_counts(pairs: DataFrame, times: DataFrame, storage_type: str = "table", services_by_name: bool = False) -> DataFrame:
    """`statistics` from counts by level and service and a row of the time range."""
    rows = rows_of_counts(pairs.withColumn("level", F.coalesce("level", F.lit("UNKNOWN"))))
    # Every level is its own partition of the ranking, all services share one.
    alone = F.when(F.col("dimension") == "level", F.col("key"))
    by_size = [] if services_by_name else [F.desc("n")]
    ranking = Window.partitionBy("dimension", alone).orderBy(*by_size, F.asc_nulls_first("key"))
    kept = rows.withColumn("rank", F.row_number().over(ranking)).filter(F.col("rank") <= TOP_SERVICES)

    def of(dimension: str, value: Column) -> Column:
        return F.when(F.col("dimension") == dimension, value)

    services = F.array_sort(F.collect_list(of("service", F.struct("rank", F.col("key").alias("service"), "n"))))
    counts = kept.agg(
        F.coalesce(F.max(of("total", F.col("n"))), F.lit(0)).alias("total_logs"),
        F.map_from_entries(F.array_sort(F.collect_list(of("level", F.struct("key", "n"))))).alias("level_distribution"),
        F.transform(services, lambda x: F.struct(x["service"].alias("service"), x["n"].alias("n"))).alias("top_services"),
    )
    return one_row(counts, times).withColumn("storage_type", F.lit(storage_type))


def memory_statistics(records: DataFrame) -> DataFrame:
    """Statistics of records that were never validated: missing levels and services get a name,
    blank timestamps do not count, and an empty input has nothing but its zero total."""
    named = records.withColumn("level", F.coalesce("level", F.lit("UNKNOWN"))).withColumn(
        "service", F.coalesce("service", F.lit("unknown"))
    ).withColumn("timestamp", F.nullif(F.col("timestamp"), F.lit("")))
    row = statistics(named, "memory")
    empty = F.col("total_logs") == 0
    return row.withColumns({name: F.when(~empty, F.col(name)) for name in ("level_distribution", "top_services")})


def success_summary(results: DataFrame) -> DataFrame:
    """Chunks, successes and failures with a guarded rate over the `success` flag."""
    return results.agg(
        F.count("*").alias("total_chunks"),
        F.count_if("success").alias("successful_chunks"),
        F.count_if(~F.col("success")).alias("failed_chunks"),
    ).withColumn("success_rate", ratio(F.col("successful_chunks"), F.col("total_chunks")))


def usage_stats(results: DataFrame) -> DataFrame:
    """Scorer usage: calls, success percentage, tokens and time per successful call."""
    counted = results.agg(
        F.count("*").alias("total_calls"),
        F.count_if("success").alias("successful_calls"),
        F.count_if(~F.col("success")).alias("failed_calls"),
        F.coalesce(F.sum(F.when(F.col("success"), F.col("tokens_used"))), F.lit(0)).alias("total_tokens_used"),
        F.coalesce(F.sum(F.when(F.col("success"), F.col("processing_time_seconds"))), F.lit(0.0)).alias(
            "total_processing_time"
        ),
    )
    return (
        counted.withColumn("success_rate", per_call(F.col("successful_calls"), F.col("total_calls")) * 100)
        .withColumn("avg_tokens_per_call", per_call(F.col("total_tokens_used"), F.col("successful_calls")))
        .withColumn("avg_time_per_call", per_call(F.col("total_processing_time"), F.col("successful_calls")))
    )


def system_overview(files: DataFrame, runs: DataFrame, records: DataFrame, results: DataFrame) -> DataFrame:
    """Files, runs, store statistics and scorer usage in one row."""
    return one_row(
        files.agg(F.count("*").alias("uploaded_files")),
        runs.agg(F.count("*").alias("processing_jobs")),
        statistics(records),
        usage_stats(results),
    )
