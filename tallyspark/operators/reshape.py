"""Reshaping: month columns to rows, differently shaped unions, scaffolds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unpivot_months(df: DataFrame, ids: list[str], prefix: str = "Mo ", value: str = "target") -> DataFrame:
    """One row for each id and month column 'Mo NN' with a value other than null and 0."""
    cols = [c for c in df.columns if c.startswith(prefix)]
    long = df.unpivot(ids, cols, "month_label", value)
    return long.where(F.col(value).isNotNull() & (F.col(value) != 0)).withColumn("month_num", F.regexp_extract("month_label", r"(\d+)$", 1).cast("int")).drop("month_label")


def diagonal_union(*frames: DataFrame, fill=None) -> DataFrame:
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return out if fill is None else out.fillna(fill)


def month_scaffold(df: DataFrame, first: str, last: str, out: str = "month") -> DataFrame:
    """A row for each month from first to last (dates)."""
    return df.select("*", F.explode(F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month"))).alias(out))
