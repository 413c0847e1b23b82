"""Small tables beside the stored one, a partition per batch, so that questions need not read the whole store.

Below `<root>/_index` (readers of the store pass over it), replaced together with the batch:

- `files`: per data file, level and service, the number of rows and the first and last timestamp. Their sums are the store's
  statistics, and they tell which files can hold the newest rows.
- `filters`: a Bloom filter of the batch's hashes in blocks of 32,768 bits, about BITS_PER_HASH bits a hash. A record whose
  bits are not all set is new to the batch; only batches that admit a record have their hash column read.
- `sketches`: a mergeable sketch of the batch's hashes for distinct counts.

Everything read through them is exact whatever state they are in (the sketches' estimates apart): files that no sidecar
knows are read, and sidecars of files that are no longer there are ignored.
"""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import retrieve, stats
from tidelog.schema import LINEAGE, STORE_SCHEMA
from tidelog.sources.scratch import path_exists

FILES = "file string, level string, service string, n long, earliest string, latest string, run string, batch_id long"
FILTERS = "blocks long, block long, bits array<long>, run string, batch_id long"
SKETCHES = "sketch binary, run string, batch_id long"
KINDS = {"files": FILES, "filters": FILTERS, "sketches": SKETCHES}

BITS_PER_HASH = 32
WORDS = 512  # of 64 bits in a block
TESTS = 8
# Registers of a sketch: 2^14, a standard error of 0.65 %.
SKETCH_BITS = 14


def sidecar(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """One kind of sidecar rows of all batches; no rows where none was written."""
    path = f"{root}/_index/{kind}"
    if not path_exists(spark, path):
        return spark.createDataFrame([], KINDS[kind])
    return spark.read.schema(KINDS[kind]).option("basePath", path).parquet(path)


def write_sidecars(spark: SparkSession, root: str, partition: str) -> None:
    """The sidecars of one written batch; `partition` is its path below the root. Reads the batch's own columns only."""
    batch = spark.read.schema(STORE_SCHEMA).parquet(f"{root}/{partition}")
    made = {"files": file_rows(batch), "filters": filter_rows(batch), "sketches": sketch_rows(batch)}
    for kind, rows in made.items():
        rows.write.mode("overwrite").parquet(f"{root}/_index/{kind}/{partition}")


def stored_file() -> Column:
    """A data file's path from its partition on, as `stored_files` lists it."""
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+/[^/]+/[^/]+)$", 1)


def file_rows(batch: DataFrame) -> DataFrame:
    groups = batch.groupBy(stored_file().alias("file"), "level", "service")
    return groups.agg(F.count("*").alias("n"), F.min("timestamp").alias("earliest"), F.max("timestamp").alias("latest"))


def stored_files(stored: DataFrame) -> list[str]:
    """The data files that a scan of `stored` would list, from their partition on, as they stand in paths."""
    return sorted("/".join(file.split("/")[-3:]) for file in stored.inputFiles())


def data_paths(root: str, files: list[str]) -> list[str]:
    """Paths to read of files as `stored_files` lists them, in URI form."""
    return [f"{root}/{unquote(file)}" for file in files]


# --- membership -------------------------------------------------------------------------------------


def bit_places(value: Column) -> list[Column]:
    """The TESTS bits of a hash in its block, 15 bits of a number each."""
    each = [F.xxhash64(value, F.lit(n)) for n in range(-(-TESTS // 4))]
    return [F.shiftright(each[i // 4], 15 * (i % 4)).bitwiseAND(WORDS * 64 - 1) for i in range(TESTS)]


def block_of(value: Column, blocks: Column) -> Column:
    """The block of a hash in a filter of a power of two of blocks."""
    return F.xxhash64(value, F.lit("block")).bitwiseAND(blocks - 1)


def filter_rows(batch: DataFrame) -> DataFrame:
    """blocks, block, bits of the filter of a batch's hashes; its size follows the number of hashes."""
    least = batch.agg(F.count("*")).first()[0] * BITS_PER_HASH / (WORDS * 64)
    blocks = 1
    while blocks < least:
        blocks *= 2
    value = F.col("log_hash")
    places = batch.select(block_of(value, F.lit(blocks).cast("long")).alias("block"), F.explode(F.array(*bit_places(value))).alias("place"))
    words = places.groupBy("block", F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits"))
    whole = words.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))
    bits = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(WORDS - 1).cast("long")), lambda word: F.coalesce(F.try_element_at("words", word), F.lit(0).cast("long")))
    return whole.select(F.lit(blocks).cast("long").alias("blocks"), "block", bits.alias("bits"))


def admitting_batches(records: DataFrame, filters: DataFrame) -> DataFrame:
    """log_hash, run, batch_id: the batches whose filter has all bits of a record's hash.

    Filters come in few sizes, so a record is looked up in one block per size; all batches of that size meet it there, and pairs
    that the bits refuse never leave the join.
    """
    sizes = filters.select("blocks").distinct()
    value = F.col("log_hash")
    asked = records.select("log_hash").crossJoin(F.broadcast(sizes))  # powers of two: 64 rows at most
    asked = asked.select("log_hash", "blocks", block_of(value, F.col("blocks")).alias("block"), F.array(*bit_places(value)).alias("places"))
    test = F.expr(" and ".join(f"(shiftright(bits[int(shiftright(places[{i}], 6))], int(places[{i}] & 63)) & 1L) = 1L" for i in range(TESTS)))
    held = filters.withColumnsRenamed({"blocks": "of_blocks", "block": "of_block"})
    met = asked.join(held, (F.col("blocks") == F.col("of_blocks")) & (F.col("block") == F.col("of_block")) & test)
    return met.select("log_hash", "run", "batch_id")


def batches_to_read(records: DataFrame, stored: DataFrame, root: str) -> list[tuple[str, int]]:
    """The batches of `stored` that may hold a hash of the records: those that admit one, and those without a filter."""
    spark = records.sparkSession
    present = sorted({batch_of(file) for file in stored_files(stored)})
    filters = sidecar(spark, root, "filters")
    known = {(row.run, row.batch_id) for row in filters.select("run", "batch_id").distinct().collect()}
    admitted = {(row.run, row.batch_id) for row in admitting_batches(records, filters).select("run", "batch_id").distinct().collect()}
    return [batch for batch in present if batch in admitted or batch not in known]


def batch_of(file: str) -> tuple[str, int]:
    run, batch_id, _ = file.split("/")
    return unquote(unquote(run.removeprefix("run="))), int(batch_id.removeprefix("batch_id="))


def of_batches(stored: DataFrame, batches: list[tuple[str, int]]) -> DataFrame:
    """Only these partitions of the store."""
    runs: dict[str, list[int]] = {}
    for run, batch_id in batches:
        runs.setdefault(run, []).append(batch_id)
    chosen = [(F.col("run") == run) & F.col("batch_id").isin(ids) for run, ids in runs.items()]
    return stored.where(reduce(lambda a, b: a | b, chosen)) if chosen else stored.where(F.lit(False))


def dedup_by_filters(records: DataFrame, stored: DataFrame, root: str) -> DataFrame:
    """As `dedup_vs_store`, reading the hash column only of the batches whose filters admit a record.

    `records` are read twice; give them from a written table.
    """
    held = of_batches(stored, batches_to_read(records, stored, root))
    return records.join(held.select("log_hash"), "log_hash", "left_anti")


# --- statistics -------------------------------------------------------------------------------------


def current_file_rows(spark: SparkSession, root: str, stored: DataFrame) -> DataFrame:
    """`files` rows of exactly the files that are there: those of unknown files are counted now, those of lost files left out."""
    present = stored_files(stored)
    rows = sidecar(spark, root, "files")
    known = {row.file for row in rows.select("file").distinct().collect()}  # as many as the listing of the store
    fresh = [file for file in present if file not in known]
    rows = rows.drop("run", "batch_id")
    if not set(present) >= known:
        rows = rows.join(spark.createDataFrame([(file,) for file in present], "file string"), "file", "left_semi")
    if fresh:
        rows = rows.unionByName(file_rows(spark.read.schema(STORE_SCHEMA).parquet(*data_paths(root, fresh))))
    return rows


def store_statistics(spark: SparkSession, root: str, services_by_name: bool = False) -> DataFrame:
    """`statistics` of the stored table from the sidecars of its files."""
    stored = spark.read.schema(STORE_SCHEMA).option("basePath", root).parquet(root)
    rows = current_file_rows(spark, root, stored)
    return stats.statistics_of_counts(rows, rows.agg(F.min("earliest").alias("earliest"), F.max("latest").alias("latest")), "table", services_by_name)


def sketch_rows(batch: DataFrame) -> DataFrame:
    return batch.agg(F.hll_sketch_agg("log_hash", F.lit(SKETCH_BITS)).alias("sketch")).where(F.col("sketch").isNotNull())


def distinct_estimate(sketches: DataFrame) -> DataFrame:
    """Distinct hashes of any batches together, from their sketches."""
    return sketches.agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0)).alias("approx_hashes"))


# --- newest first -----------------------------------------------------------------------------------


def newest_files(rows: DataFrame, limit: int, *conditions: Column | None) -> tuple[list[str], str | None]:
    """(the files that can hold one of the `limit` newest rows that match, a timestamp that none of those is below).

    Rows are grouped by file, level and service, so the number that match in a group is exact. Groups in descending order of
    their first timestamp hold `limit` rows, from some group on, none older than that group's first: files that end before are not needed.
    """
    matching = retrieve.matching(rows, *conditions)
    least, found = None, 0
    for row in matching.orderBy(F.desc("earliest")).select("earliest", "n").limit(limit).collect():  # `limit` rows at most
        least, found = row.earliest, found + row.n
        if found >= limit:
            break
    if found < limit:
        least = None
    if least is not None:
        matching = matching.where(F.col("latest") >= least)
    return sorted(row.file for row in matching.select("file").distinct().collect()), least


def retrieve_newest(spark: SparkSession, root: str, limit: int, level: str | None = None, service: str | None = None, ties: tuple[str, ...] = LINEAGE) -> DataFrame:
    """`retrieve` from the stored table, reading the few files that can hold the newest rows."""
    if limit <= 0:
        raise ValueError("limit must be positive")
    stored = spark.read.schema(STORE_SCHEMA).option("basePath", root).parquet(root)
    conditions = retrieve.level_is(level), retrieve.service_is(service)
    files, least = newest_files(current_file_rows(spark, root, stored), limit, *conditions)
    if not files:
        return stored.where(F.lit(False))
    found = spark.read.schema(STORE_SCHEMA).option("basePath", root).parquet(*data_paths(root, files))
    if least is not None:
        found = found.where(F.col("timestamp") >= least)
    return retrieve.retrieve(found, limit, level, service, ties=ties)
