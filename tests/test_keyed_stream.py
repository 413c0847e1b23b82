"""Stream merging by keyed state: restarts, replayed micro-batches, and the store as initial state."""

import shutil
from pathlib import Path

import pytest

from tidelog.schema import LOG_FIELDS
from tidelog.sources import sidecars, store
from tidelog.streaming import incremental as I
from tidelog.streaming.keyed import merge_keyed_stream

RECORD = "file string, chunk_id long, pos long, " + ", ".join(f"{name} string" for name in LOG_FIELDS)


def record(pos, message, chunk=0, user=None):
    return ("f", chunk, pos, "2024-01-01T00:00:00", "INFO", message, "s", user, None, None)


@pytest.fixture
def arriving(spark, tmp_path):
    """Adds records to a stream's source; runs the stream; gives what each batch stored."""
    source, root, checkpoint = (str(tmp_path / name) for name in ("in", "store", "checkpoint"))

    def add(rows):
        spark.createDataFrame(rows, RECORD).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = I.stream_table(spark, source, spark.createDataFrame([], RECORD).schema, "*.parquet")
        merge_keyed_stream(stream, root, "s", checkpoint).awaitTermination()
        stored = store.read_store(spark, root)
        return sorted((r.run, r.batch_id, r.message, r.user_id) for r in stored.collect())

    return add, run, root, checkpoint


def test_store_is_the_initial_state_and_restarts_go_on(spark, arriving):
    add, run, root, checkpoint = arriving
    store.merge_batch(spark.createDataFrame([record(0, "old")], RECORD), root, "before", 0)
    old = ("before", 0, "old", None)
    add([record(5, "a", user="late"), record(2, "a", user="first"), record(1, "a", chunk=1, user="next chunk"), record(0, "old"), record(3, None)])
    assert run() == [old, ("s", 0, "a", "first")]
    assert run() == [old, ("s", 0, "a", "first")]
    add([record(0, "a", user="again"), record(9, "b", user="new"), record(8, "old")])
    expected = [old, ("s", 0, "a", "first"), ("s", 1, "b", "new")]
    assert run() == expected
    # The last micro-batch was written but not committed: it is replayed and writes the same.
    (marker,) = [p for p in Path(checkpoint, "commits").glob("1")]
    marker.unlink()
    marker.with_name(".1.crc").unlink(missing_ok=True)
    assert run() == expected
    assert [r.n for r in sidecars.sidecar(spark, root, "files").where("run = 's' and batch_id = 1").collect()] == [1]


def test_first_micro_batch_replayed_from_the_start(spark, arriving):
    """The first micro-batch failed after it had written: what it wrote itself is no reason to drop its records."""
    add, run, root, checkpoint = arriving
    add([record(1, "a"), record(2, "b")])
    expected = [("s", 0, "a", None), ("s", 0, "b", None)]
    assert run() == expected
    shutil.rmtree(checkpoint)
    assert run() == expected


def test_stored_tables_are_not_read_after_the_start(spark, arriving):
    add, run, root, _ = arriving
    store.merge_batch(spark.createDataFrame([record(0, "old")], RECORD), root, "before", 0)
    add([record(1, "a")])
    run()
    # Without the other run's files, its hashes are still known.
    shutil.rmtree(f"{root}/run=before")
    add([record(1, "old"), record(2, "c")])
    assert run() == [("s", 0, "a", None), ("s", 1, "c", None)]
