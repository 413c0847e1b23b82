"""Exact stream merging with the stored hashes as keyed state, so that no micro-batch reads the store."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from tidelog.operators.dedup import storable, tag_lineage, with_hash
from tidelog.schema import LINEAGE, LOG_FIELDS
from tidelog.sources.store import open_store, with_raw_data, write_batch

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SEEN = StructType([StructField("seen", BooleanType())])
FRESH = StructType(
    [StructField("log_hash", StringType())]
    + [StructField(name, StringType()) for name in (*LOG_FIELDS, "raw_data", "file")]
    + [StructField(name, LongType()) for name in ("chunk_id", "pos")]
)


class FirstOfHash(StatefulProcessor):
    """Per hash: the first record, in lineage order, of the first micro-batch that has a storable one first; nothing afterwards."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", SEEN)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        # One record is held, however many copies there are.
        first = min(rows, key=lambda row: tuple((row[name] is not None, row[name]) for name in LINEAGE))
        if first["storable"] and not self.seen.exists():
            self.seen.update((True,))
            yield Row(**{name: first[name] for name in FRESH.fieldNames()})

    def handleInitialState(self, key: tuple, initialState: Row, timerValues) -> None:  # noqa: N802, N803
        self.seen.update((True,))

    def close(self) -> None:
        pass


def fresh_records(records: DataFrame, stored: DataFrame) -> DataFrame:
    """The records of a stream that are the first of their hash and not in `stored`, with their hash.

    Hashes are the state: `stored` is read once, when the query starts without a checkpoint; afterwards each micro-batch
    touches the state of its own hashes only. The first of a micro-batch wins in lineage order; hashes whose first record
    the NOT NULL columns refuse are not stored and stay open.
    """
    hashed = with_hash(with_raw_data(records)).withColumn("storable", storable())
    hashed = hashed.select(*FRESH.fieldNames(), "storable")
    state = stored.select("log_hash").groupBy("log_hash")
    return hashed.groupBy("log_hash").transformWithState(
        statefulProcessor=FirstOfHash(), outputStructType=FRESH, outputMode="Append", timeMode="None", initialState=state
    )


def merge_keyed_stream(records: DataFrame, root: str, run: str, checkpoint: str) -> StreamingQuery:
    """As `merge_stream`, for a stream of records: exact deduplication against the stored table by keyed state.

    What other runs stored is the initial state; what this run stores is in the checkpoint, so the run's own
    partitions are never read and a micro-batch that is replayed writes what it wrote before. One writer at a time, and a
    checkpoint belongs to its run: other runs that store while this one has a checkpoint are not seen.
    """
    spark = records.sparkSession
    stored = open_store(spark, root).where(F.col("run") != run)

    def store(batch: DataFrame, batch_id: int) -> None:
        write_batch(tag_lineage(batch, run, batch_id), root, run, batch_id, sidecars=True)

    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)  # read when the query starts
    try:
        return (
            fresh_records(records, stored)
            .writeStream.foreachBatch(store)
            .outputMode("append")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        spark.conf.set(name, before)
