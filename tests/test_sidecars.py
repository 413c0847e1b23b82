"""Sidecars of the stored table against whole scans."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from tidelog.operators import dedup as D
from tidelog.operators import retrieve as R
from tidelog.operators import stats
from tidelog.schema import LOG_FIELDS
from tidelog.sources import sidecars as X
from tidelog.sources import store as S

RECORD = "file string, chunk_id long, pos long, " + ", ".join(f"{name} string" for name in LOG_FIELDS)
LEVELS = ("INFO", "info", "WARN", "ERROR")


def batch(spark, rng, day, rows=60, spread=40):
    """Records of one day, many of them repeated, some without a message."""
    out = []
    for pos in range(rows):
        second = rng.randrange(spread)
        message = None if rng.random() < 0.05 else f"m{rng.randrange(6)}"
        out.append((f"f{day}", 0, pos, f"2024-01-{day:02}T00:00:{second:02}", rng.choice(LEVELS), message, rng.choice(["a", "b", None]), None, None, None))
    return spark.createDataFrame(out, RECORD)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """Twelve days, a batch each (the runs' names are no plain paths); and the counters of every merge."""
    root, rng = str(tmp_path_factory.mktemp("sidecars") / "store"), random.Random(1)
    counters = []
    for day in range(1, 13):
        records = batch(spark, rng, day)
        run = ["daily", "a/b=c: 7%"][day % 2]
        counters.append((run, day, S.merge_indexed(records, root, run, day)))
    return root, counters


def rows(frame):
    return sorted(map(str, frame.collect()))


def test_statistics_from_sidecars(spark, store):
    root, _ = store
    whole = S.read_store(spark, root)
    assert rows(X.store_statistics(spark, root)) == rows(stats.statistics(whole))
    assert rows(X.store_statistics(spark, root, services_by_name=True)) == rows(stats.statistics(whole, services_by_name=True))
    plan = X.store_statistics(spark, root)._jdf.queryExecution().toString()
    assert "_index/files" in plan and "message" not in plan


@pytest.mark.parametrize("limit, level, service", [(1, None, None), (7, None, None), (25, "info", None), (9, "ERROR", "b"), (5, None, "none"), (10_000, None, None)])
def test_newest_rows(spark, store, limit, level, service):
    root, _ = store
    expected = R.retrieve(S.read_store(spark, root), limit, level, service)
    assert list(map(str, X.retrieve_newest(spark, root, limit, level, service).collect())) == list(map(str, expected.collect()))


def test_a_small_limit_reads_few_files(spark, store):
    root, _ = store
    every = S.read_store(spark, root)
    days = X.current_file_rows(spark, root, every)
    files, least = X.newest_files(days, 10)
    assert least > "2024-01-12" and {f.split("/")[1] for f in files} == {"batch_id=12"}
    assert len(files) * 4 < len(every.inputFiles())
    # Ties with the least timestamp are all in the files read.
    same = spark.createDataFrame([(f"f{i}", "INFO", "a", 2, "t1", "t1") for i in range(5)], "file string, level string, service string, n long, earliest string, latest string")
    assert X.newest_files(same, 3) == ([f"f{i}" for i in range(5)], "t1")


def test_filters_admit_what_is_stored_and_little_else(spark, store):
    root, _ = store
    stored = S.read_store(spark, root)
    filters = X.sidecar(spark, root, "filters")
    met = X.admitting_batches(stored.select("log_hash"), filters).distinct()
    assert stored.select("log_hash", "run", "batch_id").join(met, ["log_hash", "run", "batch_id"], "left_anti").count() == 0
    others = spark.range(20_000).select(F.md5(F.concat(F.lit("x"), F.col("id").cast("string"))).alias("log_hash"))
    assert X.admitting_batches(others, filters).count() < 20


def test_filter_size_follows_the_batch(spark):
    def batch(n):
        return spark.range(n).select(F.md5(F.col("id").cast("string")).alias("log_hash"))

    small, large = X.filter_rows(batch(500)), X.filter_rows(batch(20_000))
    assert small.select("blocks").first().blocks == 1
    assert large.select("blocks").first().blocks == 32 and large.count() == 32
    filters = large.selectExpr("*", "'r' as run", "0L as batch_id")
    assert X.admitting_batches(batch(20_000), filters).count() == 20_000
    fresh = spark.range(20_000, 120_000).select(F.md5(F.col("id").cast("string")).alias("log_hash"))
    assert X.admitting_batches(fresh, filters).count() < 30


def test_only_admitting_batches_are_read(spark, store):
    root, _ = store
    stored = S.read_store(spark, root)
    new = spark.createDataFrame([("0" * 32,), ("1" * 32,)], "log_hash string")
    assert X.batches_to_read(new, stored, root) == []
    one = stored.where("batch_id = 5").select("log_hash").limit(3)
    assert X.batches_to_read(one, stored, root) == [("a/b=c: 7%", 5)]
    held = X.of_batches(stored, [("a/b=c: 7%", 5)])
    assert {f.split("/")[-2] for f in held.inputFiles()} == {"batch_id=5"} or "PartitionFilters" in held._jdf.queryExecution().toString()
    assert X.dedup_by_filters(one.union(new), stored, root).count() == 2


def test_merges_and_counters_equal_the_plain_ones(spark, store, tmp_path):
    root, counters = store
    plain, rng = str(tmp_path / "plain"), random.Random(1)
    results = spark.createDataFrame([("f", 0, 1, 1, True)], "file string, chunk_id long, original_line_count long, cleaned_line_count long, success boolean")
    for run, day, counted in counters:
        records = batch(spark, rng, day)
        if day in (1, 2, 7):
            stored = S.stored_before(S.open_store(spark, plain), run, day)
            expected = D.merge_stats(results, D.with_hash(records), stored).first().asDict()
            assert counted == {name: expected[name] for name in counted}
        S.merge_batch(records, plain, run, day)
    columns = ["log_hash", "timestamp", "message", "file", "pos", "run", "batch_id"]
    assert rows(S.read_store(spark, root).select(columns)) == rows(S.read_store(spark, plain).select(columns))


def test_replay_lost_sidecars_and_reset(spark, tmp_path):
    root, rng = str(tmp_path / "store"), random.Random(9)
    batches = [batch(spark, rng, day) for day in (1, 1, 2)]
    for number, records in enumerate(batches):
        S.merge_indexed(records, root, "r", number)
    before = rows(S.read_store(spark, root).drop("created_at"))
    counted = S.merge_indexed(batches[1], root, "r", 1)
    assert rows(S.read_store(spark, root).drop("created_at")) == before and counted["duplicates_in_store"] > 0
    whole = rows(stats.statistics(S.read_store(spark, root)))
    assert rows(X.store_statistics(spark, root)) == whole
    # A batch written without sidecars, and one whose sidecars are gone.
    S.merge_batch(batch(spark, rng, 3), root, "r", 3)
    shutil.rmtree(f"{root}/_index/files/run=r/batch_id=2")
    shutil.rmtree(f"{root}/_index/filters/run=r/batch_id=0")
    stored = S.read_store(spark, root)
    assert rows(X.store_statistics(spark, root)) == rows(stats.statistics(stored))
    assert rows(X.retrieve_newest(spark, root, 8)) == rows(R.retrieve(stored, 8))
    assert S.merge_indexed(stored.drop("log_hash", "created_at", "run", "batch_id"), root, "other", 0)["final_log_count"] == 0
    # Sidecars of files that were replaced are not counted.
    S.write_batch(D.tag_lineage(D.with_hash(S.with_raw_data(batches[0].where("message is not null"))), "r", 0), root, "r", 0)
    assert rows(X.store_statistics(spark, root)) == rows(stats.statistics(S.read_store(spark, root)))
    S.reset_store(spark, root)
    assert X.store_statistics(spark, root).first().total_logs == 0
    assert X.retrieve_newest(spark, root, 5).count() == 0


def test_sketches_merge(spark, store):
    root, _ = store
    stored, sketches = S.read_store(spark, root), X.sidecar(spark, root, "sketches")
    assert sketches.count() == 12
    exact = stored.select("log_hash").distinct().count()
    assert abs(X.distinct_estimate(sketches).first()[0] - exact) <= 0.03 * exact
    for n in (10, 5_000, 200_000):
        hashes = spark.range(n).select(F.md5(F.col("id").cast("string")).alias("log_hash"))
        parts = X.sketch_rows(hashes.where("log_hash < '8'")).union(X.sketch_rows(hashes.where("log_hash > '5'")))
        whole = X.distinct_estimate(X.sketch_rows(hashes)).first()[0]
        assert abs(X.distinct_estimate(parts).first()[0] - whole) <= 0.01 * n + 1
        assert abs(whole - n) <= 0.03 * n
    assert X.distinct_estimate(sketches.limit(0)).first()[0] == 0
