"""Positions in a total order, without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded, staged

#: monotonically_increasing_id keeps the row's number within its partition in so many low bits.
_ROW_BITS = 33


def placed(df: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """df (written once to the shared folder) plus _at, a row's place in its group from 0, and _of, the group's rows.

    Rows are range-partitioned by group and order and numbered inside their partition; the only window
    runs over one row per group and partition.  Equal rows are dealt out by their number in the input,
    so neither a group, nor an id, nor a row that is repeated many times has to fit into one task.
    ``group`` must not be null."""
    dealt = df.withColumn("_pl_row", F.monotonically_increasing_id())
    keys = [F.col(group), *order, F.col("_pl_row")]
    rows = staged(dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_pl_row").withColumn("_pl_id", F.monotonically_increasing_id()), name)
    part = F.shiftright("_pl_id", _ROW_BITS)
    parts = rows.groupBy(F.col(group), part.alias("_pl_part")).agg(F.min("_pl_id").alias("_pl_first"), F.count(F.lit(1)).alias("_pl_n"))
    every = W.partitionBy(group)
    before = F.coalesce(F.sum("_pl_n").over(every.orderBy("_pl_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = staged(parts.select(group, "_pl_part", (before - F.col("_pl_first")).alias("_pl_shift"), F.sum("_pl_n").over(every).alias("_of")), f"{name}-parts")
    rows = rows.withColumn("_pl_part", part).join(bounded(parts), [group, "_pl_part"])
    return rows.withColumn("_at", F.col("_pl_id") + F.col("_pl_shift")).drop("_pl_id", "_pl_part", "_pl_shift")
