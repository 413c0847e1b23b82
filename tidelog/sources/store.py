"""The stored table: Parquet files below one root, partitioned by run and batch.

Parquet has no UNIQUE constraint, so uniqueness comes from `merge_batch`: first record of each hash
within the batch, minus the hashes stored by earlier batches. A batch overwrites its own partition
and ignores what later batches of its run stored, so repeating it leaves the table unchanged but for
`created_at`. One writer at a time; readers miss a partition while it is overwritten.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.clean import emit_json
from tidelog.operators.dedup import (
    dedup_first_wins,
    dedup_small_vs_store,
    dedup_vs_store,
    storable,
    storable_records,
    tag_lineage,
    with_hash,
)
from tidelog.schema import LINEAGE, STORE_SCHEMA
from tidelog.sources.scratch import path_exists, saved
from tidelog.sources.sidecars import dedup_by_filters, write_sidecars

_DATA_COLUMNS = [name for name in STORE_SCHEMA.fieldNames() if name not in ("run", "batch_id")]


def reset_store(spark: SparkSession, root: str) -> None:
    """Leave an empty, readable table at `root`."""
    empty = spark.createDataFrame([], STORE_SCHEMA)
    empty.write.mode("overwrite").partitionBy("run", "batch_id").parquet(root)


def read_store(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(STORE_SCHEMA).option("basePath", root).parquet(root)


def open_store(spark: SparkSession, root: str) -> DataFrame:
    """The stored table, created when there is nothing at `root` yet. What is there is never overwritten."""
    if not path_exists(spark, root):
        spark.createDataFrame([], STORE_SCHEMA).write.mode("append").partitionBy("run", "batch_id").parquet(root)
    return read_store(spark, root)


def partition_name(value: str) -> str:
    """A partition value as a path keeps it: control characters and those with a meaning in paths are percent-coded."""
    return re.sub(r"[\x00-\x1f\x7f\"#%'*/:=?\\{}\[\]^]", lambda met: f"%{ord(met.group()):02X}", value)


def stored_before(stored: DataFrame, run: str, batch_id: int) -> DataFrame:
    """What was stored when the batch first ran: everything but this and later batches of the run."""
    return stored.filter((F.col("run") != run) | (F.col("batch_id") < batch_id))


def batch_path(run: str, batch_id: int) -> str:
    return f"run={partition_name(run)}/batch_id={batch_id}"


def write_batch(records: DataFrame, root: str, run: str, batch_id: int, sidecars: bool = False) -> None:
    """Write one batch to its partition, ordered by time inside each file for range pruning, and its sidecars if wanted."""
    path = batch_path(run, batch_id)
    records.select(*_DATA_COLUMNS).sortWithinPartitions("timestamp").write.mode("overwrite").parquet(f"{root}/{path}")
    if sidecars:
        write_sidecars(records.sparkSession, root, path)


def unique_records(records: DataFrame, order: Sequence[str] = LINEAGE) -> DataFrame:
    """First record of each hash, without those the NOT NULL columns refuse."""
    return storable_records(dedup_first_wins(with_hash(records), order))


def merge_batch(records: DataFrame, root: str, run: str, batch_id: int, small: bool = False) -> None:
    """Deduplicate records against themselves and the table, and store the rest.

    Needs file, chunk_id, pos and the standard fields. The whole record is kept: `raw_data` as given, else the source
    line or entry in `raw`; only without both is it made of the standard fields.
    small=True suits batches that are small next to the store: the batch is kept while its hashes
    are looked up, and the stored hashes are scanned instead of shuffled.
    """
    stored = stored_before(open_store(records.sparkSession, root), run, batch_id)
    unique = unique_records(with_raw_data(records))
    if not small:
        write_batch(tag_lineage(dedup_vs_store(unique, stored), run, batch_id), root, run, batch_id)
        return
    unique = unique.persist()
    try:
        write_batch(tag_lineage(dedup_small_vs_store(unique, stored), run, batch_id), root, run, batch_id)
    finally:
        unique.unpersist()


def with_raw_data(records: DataFrame) -> DataFrame:
    if "raw_data" in records.columns:
        return records
    return records.withColumn("raw_data", F.col("raw")) if "raw" in records.columns else emit_json(records)


def merge_indexed(records: DataFrame, root: str, run: str, batch_id: int) -> dict[str, int]:
    """As `merge_batch`, with the store's sidecars; returns the counters of `merge_stats` for the records.

    The records are read once, and what is counted is what is written: the batch's own first records go to the scratch
    folder while they are counted, and those that no earlier batch holds to the store. Of the store, the filters are read, and the hash
    columns of batches that may hold one of the records.
    """
    spark = records.sparkSession
    stored = stored_before(open_store(spark, root), run, batch_id)
    read, first, kept = Observation(), Observation(), Observation()
    records = with_raw_data(records).observe(read, F.count("*").alias("records"))
    unique = dedup_first_wins(with_hash(records)).observe(first, F.count("*").alias("unique"), F.count_if(storable()).alias("storable"))
    unique = saved(storable_records(unique), "unique-records")
    fresh = dedup_by_filters(unique, stored, root).observe(kept, F.count("*").alias("stored"))
    write_batch(tag_lineage(fresh, run, batch_id), root, run, batch_id, sidecars=True)
    counted = {**read.get, **first.get, **kept.get}
    unstorable, known = counted["unique"] - counted["storable"], counted["storable"] - counted["stored"]
    return {
        "duplicates_removed": counted["records"] - counted["unique"],
        "duplicates_in_store": known,
        "unstorable_logs": unstorable,
        "invalid_logs_filtered": unstorable + known,
        "final_log_count": counted["stored"],
    }


def with_store_tags(records: DataFrame) -> DataFrame:
    """In-session form of the store: the record plus hash, chunk and time under underscore names."""
    return with_hash(records).select(
        "*",
        F.col("log_hash").alias("_log_hash"),
        F.col("chunk_id").alias("_chunk_id"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("_stored_at"),
    ).drop("log_hash")


def append_session_store(held: DataFrame | None, records: DataFrame) -> DataFrame:
    """Records added to those already held in the session; nothing is unique across calls."""
    tagged = with_store_tags(records)
    return tagged if held is None else held.unionByName(tagged, allowMissingColumns=True)


