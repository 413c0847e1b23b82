"""Where intermediate tables go: the shared folder the session names."""

from __future__ import annotations

import atexit
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_MADE: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below `spark.checkpoint.dir`, else below the warehouse: both are shared by driver and executors.

    What is written there goes when the session's process ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{root.rstrip('/')}/tidelog/{label}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def saved(frame: DataFrame, label: str) -> DataFrame:
    """`frame` written to the scratch folder and read back: lineage ends there."""
    path = scratch_path(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(context._jsc.hadoopConfiguration()).exists(where)


@atexit.register
def remove_scratch() -> None:
    """Deletes the paths handed out, as long as the session that can reach them is still there."""
    context = SparkContext._active_spark_context
    if context is None or context._jsc is None:
        return
    while _MADE:
        path = context._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
