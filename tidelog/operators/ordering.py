"""Order-dependent columns without a one-task window per file.

A file (or any other ordered group) may hold a large share of all rows, so nothing here runs one
window over a whole group. Rows carry a `block` that cuts the group into contiguous pieces of
bounded size; a window runs inside each block, a second window runs over one small row per block,
and the two are joined on (group, block). Whether that join broadcasts is left to Spark, which
checks the measured size of the block table and otherwise joins on evenly sized blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def together(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt so that one task has all rows of a key, for functions over whole partitions.

    Nothing tells Spark that such a function needs its keys together. A plain `repartition` by the keys is dropped behind a join
    on the same keys, and that join may turn into a broadcast join, or have a large partition cut up, while the query runs:
    a key's rows are then dealt to several tasks. No join deals rows by this hash, so the exchange stays.
    """
    return df.repartition(F.xxhash64(*keys))


def _before(group: Sequence[str], block: str):
    return Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)


def block_totals(df: DataFrame, group: Sequence[str], block: str, **totals: Column) -> DataFrame:
    """Per block: the sum of each measure in earlier blocks of the group (`<name>_before`)."""
    per_block = df.groupBy(*group, block).agg(*[F.sum(expr).alias(name) for name, expr in totals.items()])
    before = _before(group, block)
    return per_block.select(
        *group, block, *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"{name}_before") for name in totals]
    )


def running_sum(
    df: DataFrame, group: Sequence[str], block: str, order: Sequence[str], value: Column, name: str
) -> DataFrame:
    """Inclusive running sum of `value` in group order, as column `name`."""
    staged = df.withColumn("_value", value)
    before = block_totals(staged, group, block, _value=F.col("_value"))
    inside = Window.partitionBy(*group, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        staged.withColumn("_inside", F.sum("_value").over(inside))
        .join(before, [*group, block])
        .withColumn(name, F.col("_inside") + F.col("_value_before"))
        .drop("_value", "_inside", "_value_before")
    )


def row_numbers(
    df: DataFrame, group: Sequence[str], block: str, order: Sequence[str], name: str = "line_no"
) -> DataFrame:
    """1-based position of each row in its group."""
    return running_sum(df, group, block, order, F.lit(1).cast("long"), name)


def last_known(
    df: DataFrame, group: Sequence[str], block: str, order: Sequence[str], value: str, name: str
) -> DataFrame:
    """The most recent non-NULL `value` at or before each row in group order."""
    position = F.struct(*order)
    per_block = df.groupBy(*group, block).agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), position)).alias("_block_last")
    )
    carried = per_block.select(
        *group, block, F.last("_block_last", ignorenulls=True).over(_before(group, block)).alias("_carried")
    )
    inside = Window.partitionBy(*group, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.withColumn("_inside", F.last(value, ignorenulls=True).over(inside))
        .join(carried, [*group, block])
        .withColumn(name, F.coalesce("_inside", "_carried"))
        .drop("_inside", "_carried")
    )
