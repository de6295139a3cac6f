"""Dates: month keys, many-format parsing, period frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm:ss")


def month_key(d: Column) -> Column:
    return F.date_format(d, "MM-yyyy")


def month_label(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def month_date(key: Column) -> Column:
    """First day of a 'MM-yyyy' key."""
    return F.try_to_date(F.concat(F.lit("01-"), key), "dd-MM-yyyy")


def parse_date(c: Column) -> Column:
    return F.coalesce(*(F.try_to_date(c, f) for f in FORMATS))


def file_date(c: Column) -> Column:
    return F.regexp_extract(c, r"(\d{1,2} [A-Za-z]+ \d{4})", 1)


def overlap_days(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Days that the closed spans [a, b] and [c, d] share."""
    return F.greatest(F.datediff(F.least(b, d), F.greatest(a, c)) + 1, F.lit(0))
