"""Window compositions that Spark has no single function for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from .order import numbered


def change_pct(value: str, order, by=()) -> Column:
    """Percent change against the row before; null without one or with a zero base."""
    before = F.lag(value).over(W.partitionBy(*by).orderBy(*([order] if isinstance(order, str) else order)))
    return ratio(F.col(value) - before, before) * 100


def average_rank(col: str, by=()) -> Column:
    """Rank with ties at their mean."""
    return F.rank().over(W.partitionBy(*by).orderBy(col)) + (F.count("*").over(W.partitionBy(*by, col)) - 1) / 2


def average_ranks(values: DataFrame, col: str, n: str) -> DataFrame:
    """(col, rank, n_all): the mean rank of each value among all rows, out of one row a value with its count ``n``.

    Values meet in buckets of a logarithmic scale; the only window over everything is one row a bucket, some
    thousands at most, whatever the table's size."""
    v = F.col(col)
    df = values.select(v, F.col(n).alias("_n"), (F.signum(v) * F.floor(F.log1p(F.abs(v)) * 64)).cast("int").alias("_bucket"))
    tops = df.groupBy("_bucket").agg(F.sum("_n").alias("_in"))
    upto = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    tops = tops.select("_bucket", F.coalesce(F.sum("_in").over(upto), F.lit(0)).alias("_before"), F.sum("_in").over(W.partitionBy()).alias("n_all"))
    inner = F.coalesce(F.sum("_n").over(W.partitionBy("_bucket").orderBy(col).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("_inner", inner).join(tops, "_bucket").select(col, (F.col("_before") + F.col("_inner") + (F.col("_n") + 1) / 2).alias("rank"), "n_all")


def quartile(df: DataFrame, col: str, key: str, out: str, reverse: bool = False) -> DataFrame:
    """Quartile label 1..4 of the first-come rank, edges by linear interpolation; one value only: 2."""
    ends = df.agg((F.min(col) == F.max(col)).alias("_flat"))  # one row
    df = numbered(df, [col, key])
    bucket = F.lit(4)
    for k in (3, 2, 1):
        bucket = F.when(F.col("_place") * 4 <= (F.col("_all") - 1) * k, k).otherwise(bucket)
    return df.join(F.broadcast(ends)).withColumn(out, F.when(F.col("_flat"), 2).otherwise(5 - bucket if reverse else bucket).cast("int")).drop("_place", "_all", "_flat")


def keep_first(df: DataFrame, keys, order) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def carry_forward(col: str, order, by=()) -> Column:
    return F.last(col, ignorenulls=True).over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
