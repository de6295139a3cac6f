"""Positions and running sums over a whole table, without a window that holds it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .stage import staged

#: monotonically_increasing_id keeps a row's number within its partition in so many low bits.
_ROW_BITS = 33


def numbered(df: DataFrame, order: list, add: str | None = None) -> DataFrame:
    """df plus _place (from 0 in ``order``, which should tell rows apart) and _all (rows); with ``add`` also _upto, the sum
    of that column up to and with the row, and _sum, that of all.

    Rows are dealt out by ranges, sorted and numbered inside their partition and written once; what stands before a
    partition comes from one row a partition."""
    rows = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "numbered").withColumn("_part", F.shiftright("_id", _ROW_BITS))
    value = F.col(add) if add else F.lit(0)
    parts = rows.groupBy("_part").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"), F.sum(value).alias("_s"))
    before, every = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1), W.partitionBy()  # one row a partition
    parts = parts.select("_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(every).alias("_all"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_gone"), F.sum("_s").over(every).alias("_sum"))
    out = rows.join(F.broadcast(parts), "_part").withColumn("_place", F.col("_id") + F.col("_shift"))
    if add:
        out = out.withColumn("_upto", F.col("_gone") + F.sum(value).over(W.partitionBy("_part").orderBy("_id").rowsBetween(W.unboundedPreceding, 0)))
    return out.drop("_part", "_id", "_shift", "_gone", *([] if add else ["_sum"]))
