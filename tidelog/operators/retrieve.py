"""Filtered, newest-first retrieval of stored records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.json_values import parse_json
from tidelog.functions.text import display_time, or_unknown
from tidelog.schema import LINEAGE

# Rows returned when the caller names no limit, rows and services shown on screen.
DEFAULT_LIMIT = 1000
DISPLAY_ROWS = 50
DISPLAY_SERVICES = 5
TOP_SERVICES = 10


def level_is(level: str | None, stored_as_is: bool = False) -> Column | None:
    """Filter on the level; an empty argument means no filter.

    Levels compare without regard to case. stored_as_is=True upper-cases only the argument; for
    tables of normalized records that is the same, and Parquet can skip row groups by it.
    """
    if not level:
        return None
    return (F.col("level") if stored_as_is else F.upper("level")) == level.upper()


def service_is(service: str | None) -> Column | None:
    """Exact, case-sensitive filter on the service; an empty argument means no filter."""
    return F.col("service") == service if service else None


def matching(records: DataFrame, *conditions: Column | None) -> DataFrame:
    """Rows that satisfy all given conditions; the filters reach the Parquet scan."""
    for condition in conditions:
        if condition is not None:
            records = records.filter(condition)
    return records


def newest_first(records: DataFrame, ties: Sequence[str] = LINEAGE) -> DataFrame:
    return records.orderBy(F.desc("timestamp"), *ties)


def limited(records: DataFrame, limit: int | None) -> DataFrame:
    """First `limit` rows; None and 0 mean all, a negative number is an error."""
    if limit is not None and limit < 0:
        raise ValueError("limit must not be negative")
    return records.limit(limit) if limit else records


def retrieve(
    records: DataFrame,
    limit: int | None = DEFAULT_LIMIT,
    level: str | None = None,
    service: str | None = None,
    stored_as_is: bool = False,
    ties: Sequence[str] = LINEAGE,
) -> DataFrame:
    """Filter, sort newest first, limit: a distributed top-k when a limit is given."""
    found = matching(records, level_is(level, stored_as_is), service_is(service))
    return limited(newest_first(found, ties), limit)


def retrieval_counts(
    records: DataFrame, limit: int | None = DEFAULT_LIMIT, level: str | None = None, service: str | None = None
) -> DataFrame:
    """`total_matching` rows of the filter and `total_count` rows that the limit lets through."""
    total = matching(records, level_is(level), service_is(service)).agg(F.count("*").alias("total_matching"))
    shown = F.least("total_matching", F.lit(limit).cast("long")) if limit else F.col("total_matching")
    return total.withColumn("total_count", shown)


def raw_documents(records: DataFrame) -> DataFrame:
    """Stored JSON decoded to VARIANT `doc`; rows that do not decode are skipped."""
    return records.select("log_hash", "raw_data", parse_json(F.col("raw_data")).alias("doc")).filter("doc is not null")


def display_columns(records: DataFrame) -> DataFrame:
    return records.select(
        display_time(F.col("timestamp")).alias("timestamp"),
        "level",
        or_unknown(F.col("service")).alias("service"),
        "message",
    )


def display_rows(records: DataFrame, ties: Sequence[str] = LINEAGE, rows: int = DISPLAY_ROWS) -> DataFrame:
    """The first screen of the newest records."""
    return display_columns(newest_first(records, ties).limit(rows))


def display_services(records: DataFrame, services: int = DISPLAY_SERVICES) -> DataFrame:
    """The services on the first screen: the largest, with their share of all records."""
    counts = records.groupBy("service").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over one row per service
    shown = counts.withColumn("share", F.col("n") / total).orderBy(F.desc("n"), F.asc_nulls_first("service"))
    return shown.limit(services)


def top_services(records: DataFrame, k: int = TOP_SERVICES) -> DataFrame:
    """Services by record count; ties by name, NULL first."""
    counts = records.groupBy("service").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), F.asc_nulls_first("service")).limit(k)


def first_services(records: DataFrame, k: int = TOP_SERVICES) -> DataFrame:
    """The first services by name with their counts, whatever their size."""
    counts = records.groupBy("service").agg(F.count("*").alias("n"))
    return counts.orderBy(F.asc_nulls_first("service")).limit(k)
