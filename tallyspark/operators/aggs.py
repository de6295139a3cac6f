"""Aggregates with the null and tie rules of the pipelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def distinct_with_null(c: Column) -> Column:
    """Distinct values, null counted as one."""
    return F.count_distinct(c) + F.coalesce(F.max(F.when(c.isNull(), 1)), F.lit(0))


def sum_if(test: Column, value: Column) -> Column:
    return F.sum(F.when(test, value))


def mode_of(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """(by, col): the most frequent value, ties to the smallest."""
    n = df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count("*").alias("_n"))
    w = W.partitionBy(*by).orderBy(F.desc("_n"), col)
    return n.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").select(*by, col)


def share_of_total(col: str) -> Column:
    return F.try_divide(F.col(col), F.sum(col).over(W.partitionBy()))


def first_seen(df: DataFrame, by: list[str], col: str, order: list[str], out: str, sep: str = " + ", most: int = 12) -> DataFrame:
    """(by, out): distinct values in the order of their first row, joined; beyond ``most`` only their number is told.

    Values are made distinct before they are ranked, and no more than ``most`` of a group are gathered."""
    value = F.trim(F.col(col).cast("string"))
    one = df.select(*by, value.alias("_value"), F.struct(*order).alias("_first")).where("_value <> ''").groupBy(*by, "_value").agg(F.min("_first").alias("_first"))
    w = W.partitionBy(*by).orderBy("_first", "_value")
    one = one.withColumns({"_place": F.row_number().over(w), "_n": F.count("*").over(W.partitionBy(*by))}).where(F.col("_place") <= most)
    lists = one.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_place", "_value"))).alias("_list"), F.max("_n").alias("_n"))
    text = F.array_join(F.transform("_list", lambda x: x["_value"]), sep)
    return lists.select(*by, F.when(F.col("_n") > most, F.concat(text, F.lit(f"{sep}... ("), F.col("_n").cast("string"), F.lit(" items)"))).otherwise(text).alias(out))
