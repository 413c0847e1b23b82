"""Merge chunks, drop duplicates, and account for every record."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.hashing import log_hash
from tidelog.schema import HASH_FIELDS, LINEAGE, REQUIRED_FIELDS


def union_chunks(frames: Sequence[DataFrame]) -> DataFrame:
    """All records of several inputs; columns are matched by name."""
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), frames)


def successful(results: DataFrame) -> DataFrame:
    return results.filter("success")


def processing_errors(results: DataFrame) -> DataFrame:
    return results.filter(~F.col("success")).select("file", "chunk_id", "error")


def skip_failed(records: DataFrame, results: DataFrame) -> DataFrame:
    """Records of the chunks that succeeded."""
    return records.join(successful(results).select("file", "chunk_id"), ["file", "chunk_id"], "left_semi")


def with_hash(records: DataFrame, fields: Sequence[str] = HASH_FIELDS) -> DataFrame:
    return records.withColumn("log_hash", log_hash(fields))


def dedup_first_wins(records: DataFrame, order: Sequence[str] = LINEAGE) -> DataFrame:
    """The first record of each hash in lineage order.

    Spark keeps one row per hash and input partition before the shuffle, so a hash that a large
    share of all rows have in common does not travel.
    """
    first = Window.partitionBy("log_hash").orderBy(*order)
    return records.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")


def distinct_hashes(records: DataFrame) -> DataFrame:
    return records.select("log_hash").distinct()


def approx_distinct_hashes(records: DataFrame, rsd: float = 0.02) -> DataFrame:
    """Size estimate without a shuffle of the hashes."""
    return records.agg(F.approx_count_distinct("log_hash", rsd).alias("approx_hashes"))


def dedup_vs_store(records: DataFrame, stored: DataFrame) -> DataFrame:
    """Records whose hash is not stored yet. Only the hash column of the store is read.

    `records` come from `dedup_first_wins`, which already placed them by hash, so neither side has
    a repeated key.
    """
    return records.join(stored.select("log_hash"), "log_hash", "left_anti")


def dedup_small_vs_store(records: DataFrame, stored: DataFrame) -> DataFrame:
    """The same for a batch that is small next to the store (persist it first, it is read twice).

    The stored hashes are first reduced to those that occur in the batch. When the batch is small
    enough to be broadcast, Spark only scans the hash column and does not shuffle it.
    """
    known = stored.select("log_hash").join(records.select("log_hash"), "log_hash", "left_semi")
    return records.join(known, "log_hash", "left_anti")


def storable() -> Column:
    """Whether the NOT NULL columns of the store have values."""
    checks = [F.col(name).isNotNull() for name in REQUIRED_FIELDS]
    return reduce(lambda left, right: left & right, checks)


def storable_records(records: DataFrame) -> DataFrame:
    return records.filter(storable())


def unstorable_records(records: DataFrame) -> DataFrame:
    reason = F.when(F.lit(False), F.lit(""))
    for name in REQUIRED_FIELDS:
        reason = reason.when(F.col(name).isNull(), F.lit(f"{name} is null"))
    return records.filter(~storable()).withColumn("reject_reason", reason)


def tag_lineage(records: DataFrame, run: str, batch_id: int) -> DataFrame:
    return records.select(
        "*",
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("created_at"),
        F.lit(run).alias("run"),
        F.lit(batch_id).cast("long").alias("batch_id"),
    )


def hash_fates(records: DataFrame, stored: DataFrame | None = None, order: Sequence[str] = LINEAGE) -> DataFrame:
    """One row per hash: how many records had it, and what became of the first of them.

    Pre-aggregated per input partition, so repeated hashes are merged before the shuffle.
    """
    per_hash = records.groupBy("log_hash").agg(
        F.count("*").alias("copies"), F.min_by(storable(), F.struct(*order)).alias("_storable")
    )
    if stored is None:
        known = per_hash.withColumn("_known", F.lit(False))
    else:
        known = per_hash.join(stored.select("log_hash", F.lit(True).alias("_known")), "log_hash", "left")
    fate = (
        F.when(~F.col("_storable"), F.lit("invalid"))
        .when(F.coalesce("_known", F.lit(False)), F.lit("dup_in_store"))
        .otherwise(F.lit("stored"))
    )
    return known.select("log_hash", "copies", fate.alias("fate"))


def merge_stats(
    results: DataFrame, records: DataFrame, stored: DataFrame | None = None, order: Sequence[str] = LINEAGE
) -> DataFrame:
    """One row of merge counters.

    `results` has a row per chunk (original_line_count, cleaned_line_count, success); `records` are
    the records of the successful chunks. Duplicates of the store and unstorable records are
    counted apart; `invalid_logs_filtered` is their sum.
    """
    chunks = results.agg(
        F.count("*").alias("total_chunks_processed"),
        F.coalesce(F.sum(F.when(F.col("success"), F.col("original_line_count"))), F.lit(0)).alias("total_raw_logs"),
        F.coalesce(F.sum(F.when(F.col("success"), F.col("cleaned_line_count"))), F.lit(0)).alias("total_cleaned_logs"),
        F.coalesce(F.sum("original_line_count"), F.lit(0)).alias("total_input_lines"),
        F.count_if(~F.col("success")).alias("failed_chunks"),
    )
    fates = hash_fates(records, stored, order).agg(
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates_removed"),
        F.count_if(F.col("fate") == "dup_in_store").alias("duplicates_in_store"),
        F.count_if(F.col("fate") == "invalid").alias("unstorable_logs"),
        F.count_if(F.col("fate") != "stored").alias("invalid_logs_filtered"),
        F.count_if(F.col("fate") == "stored").alias("final_log_count"),
    )
    return one_row(chunks, fates)


def chunk_details(results: DataFrame) -> DataFrame:
    """Counters of each successful chunk."""
    return successful(results).select(
        "file",
        "chunk_id",
        F.col("original_line_count").alias("original_count"),
        F.col("cleaned_line_count").alias("cleaned_count"),
        "tokens_used",
        F.col("processing_time_seconds").alias("processing_time"),
    )


def one_row(*frames: DataFrame) -> DataFrame:
    """Columns of several one-row aggregates side by side, joined on a constant key."""
    keyed = [frame.withColumn("_one", F.lit(1)) for frame in frames]
    return reduce(lambda left, right: left.join(right, "_one"), keyed).drop("_one")
