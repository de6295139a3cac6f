"""Null-safe numbers: money, division, clipping, locale-tolerant parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def money(c: Column) -> Column:
    return c.cast(MONEY)


def total(c: Column) -> Column:
    """Exact sum as a double, 0 for nothing."""
    return F.coalesce(F.sum(c), F.lit(0).cast(MONEY)).cast("double")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def ratio0(a: Column, b: Column) -> Column:
    return F.coalesce(ratio(a, b), F.lit(0.0))


def pct(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double")) * 100


def clip(c: Column, low=None, high=None) -> Column:
    """Clips; a null stays null."""
    out = c
    if low is not None:
        out = F.when(c.isNull(), None).otherwise(F.greatest(out, F.lit(low)))
    if high is not None:
        out = F.when(c.isNull(), None).otherwise(F.least(out, F.lit(high)))
    return out


def delta_pct(now: Column, base: Column) -> Column:
    """Change in percent of the absolute base, 0 where there is no base."""
    return F.when(F.coalesce(base.cast("double"), F.lit(0.0)) == 0, F.lit(0.0)).otherwise((now.cast("double") - base.cast("double")) / F.abs(base.cast("double")) * 100)


def mean_of_known(*cols: Column) -> Column:
    """Row mean over the columns that are not null."""
    some = sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0))
    n = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in cols), F.lit(0))
    return F.try_divide(some, n.cast("double"))


def parse_number(c: Column) -> Column:
    """A double out of prices as people write them: '1.234,56', '1,234.56', 'Rp 1.000', '(500)'.

    With both separators the last one is the decimal mark, unless three digits follow it; a lone separator
    before exactly three digits of a longer number groups thousands."""
    s = F.regexp_replace(F.trim(c), r"[^\d.,\-()]", "")
    minus = s.rlike(r"^\(.*\)$")
    s = F.regexp_replace(s, r"[()]", "")
    comma, dot = F.length(s) - F.locate(",", F.reverse(s)), F.length(s) - F.locate(".", F.reverse(s))
    has_c, has_d = s.contains(","), s.contains(".")
    after = F.length(s) - F.greatest(comma, dot) - 1
    bare = F.regexp_replace(s, "[.,]", "")
    both = F.when(after == 3, bare).when(comma > dot, F.regexp_replace(F.regexp_replace(s, r"\.", ""), ",", ".")).otherwise(F.regexp_replace(s, ",", ""))
    grouped = F.length(s) > 4
    only_c = F.when(((F.length(s) - comma - 1) == 3) & grouped, F.regexp_replace(s, ",", "")).otherwise(F.regexp_replace(s, r"^([^,]*),", "$1."))
    only_d = F.when(((F.length(s) - dot - 1) == 3) & grouped, F.regexp_replace(s, r"\.", "")).otherwise(s)
    text = F.when(has_c & has_d, both).when(has_c, only_c).when(has_d, only_d).otherwise(s)
    number = F.when((s == "") | (s == "-"), None).otherwise(text.try_cast("double"))
    return F.when(minus, -number).otherwise(number)
