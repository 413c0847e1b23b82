"""Helpers shared by the corpus operators: tables, the shared folder, let-bindings, connected classes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.sources.scratch import scratch_path

# The white space of every word rule in this package: space, tab, line feed, vertical tab, form feed, return.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder the session shares: `spark.checkpoint.dir`, else the warehouse. It goes when the session's process ends."""
    return scratch_path(spark, f"corpus/{label}")


def saved(frame: DataFrame, label: str, group_bytes: int | None = None) -> DataFrame:
    """`frame` written to the shared folder and read back: lineage ends there, lost executors cost nothing.

    A reader holds a row group at a time, which `group_bytes` bounds for tables of very large rows.
    """
    path = shared_path(frame.sparkSession, label)
    writer = frame.write if group_bytes is None else frame.write.option("parquet.block.size", str(group_bytes))
    writer.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs inside hand at most `rows` rows at a time to Python, which bounds the texts a worker holds."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, also where `body` uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def rows_per_task(frame_rows: int, rows: int, least: int) -> int:
    """Partitions for `frame_rows` rows at about `rows` each."""
    return max(least, -(-frame_rows // rows))


def connected_classes(links: DataFrame, label: str) -> DataFrame:
    """(node, root) for the nodes of `links` (a, b: bigint); root is the smallest node of the class.

    Alternating large and small stars: every round joins each node's links with that node's smallest neighbour, so no
    task holds a class; a node with very many links is an ordinary skewed join key. Each round is a written table.
    Null ends and loops are ignored. Repeated links count once. No links: an empty table.
    """
    edges = saved(_downward(links.select("a", "b")).distinct(), label)
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = _downward(large).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
        edges = saved(_downward(small).distinct(), label)
        last, mark = mark, _mark(edges)
        if mark == last:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.distinct())


def _downward(links: DataFrame) -> DataFrame:
    links = links.where("a <> b")
    return links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))


def _mark(edges: DataFrame) -> tuple[int, int | None]:
    """Number and order-free hash of the links: equal for two rounds when nothing moves any more."""
    found = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return found[0], found[1]
