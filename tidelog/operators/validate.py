"""Acceptance rules for records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.json_values import entry_problem
from tidelog.schema import REQUIRED_FIELDS, VALID_LEVELS


def record_problem() -> Column:
    """Reason a typed record is rejected: a required field is NULL or '', or the level is unknown."""
    problem = F.when(F.lit(False), F.lit(""))
    for name in REQUIRED_FIELDS:
        problem = problem.when(F.coalesce(F.col(name), F.lit("")) == "", F.lit(f"missing {name}"))
    return problem.when(~F.upper("level").isin(*VALID_LEVELS), F.lit("unknown level"))


def valid_records(records: DataFrame) -> DataFrame:
    return records.filter(record_problem().isNull())


def rejected_records(records: DataFrame) -> DataFrame:
    return records.withColumn("reject_reason", record_problem()).filter(F.col("reject_reason").isNotNull())


def valid_entries(entries: DataFrame, entry: str = "entry") -> DataFrame:
    return entries.filter(entry_problem(F.col(entry)).isNull())


def rejected_entries(entries: DataFrame, entry: str = "entry") -> DataFrame:
    return entries.withColumn("reject_reason", entry_problem(F.col(entry))).filter(F.col("reject_reason").isNotNull())
