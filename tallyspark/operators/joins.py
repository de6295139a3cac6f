"""Join compositions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def full_outer(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join with the keys of either side, nulls alike."""
    right = b.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    test = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    joined = a.join(right, test, "full")
    return joined.select(*(F.coalesce(k, f"_r_{k}").alias(k) for k in keys), *(c for c in joined.columns if c not in keys and not c.startswith("_r_")))


def orphans(df: DataFrame, key: str, *known: DataFrame) -> DataFrame:
    """Rows whose key is in none of the known frames."""
    out = df.where(F.col(key).isNotNull())
    for k in known:
        out = out.join(k.select(key).distinct(), key, "left_anti")
    return out


def lookup(df: DataFrame, ref: DataFrame, key: str) -> DataFrame:
    """Left join to a reference with one row a key (the first by its columns, if there are more)."""
    one = ref.groupBy(key).agg(F.min(F.struct(*(c for c in ref.columns if c != key))).alias("_ref")).select(key, "_ref.*")
    return df.join(one, key, "left")


def fan_lookup(df: DataFrame, ref: DataFrame, key: str, upper: bool = False) -> DataFrame:
    """Left join to every row that a reference has for the key; ``upper`` compares trimmed capitals."""
    if not upper:
        return df.join(ref, key, "left")
    right = ref.withColumn("_key", F.upper(F.trim(key))).drop(key)
    return df.withColumn("_key", F.upper(F.trim(key))).join(right, "_key", "left").drop("_key")


def resolve(df: DataFrame, ref: DataFrame, steps: list[tuple[str, str]], order: str, out: str) -> DataFrame:
    """``out``: the reference row (struct) by the first (column, reference column) pair that hits; of several rows
    the last by ``order`` counts."""
    found = []
    for n, (mine, theirs) in enumerate(steps):
        last = ref.where(F.col(theirs).isNotNull()).groupBy(F.col(theirs).alias(f"_k{n}")).agg(F.max_by(F.struct(*ref.columns), F.col(order)).alias(f"_r{n}"))
        df = df.join(last, F.col(mine) == F.col(f"_k{n}"), "left").drop(f"_k{n}")
        found.append(f"_r{n}")
    return df.withColumn(out, F.coalesce(*found)).drop(*found)


def full_outer_named(a: DataFrame, b: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Full outer join where the right side names its keys otherwise."""
    return full_outer(a, b.withColumnsRenamed({r: k for k, r in keys.items()}), list(keys))


def in_range(df: DataFrame, ranges: DataFrame, key: str, value: str, low: str, high: str, order: str) -> DataFrame:
    """Each row with the first, by ``order``, of its key's ranges that holds the value (open ends are null); rows that
    none holds go.  A key's ranges are its grades, few, and come to its rows as one array."""
    cols = [c for c in ranges.columns if c != key]
    grades = ranges.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_order"), *cols))).alias("_grades"))
    holds = lambda r: (r[low].isNull() | (F.col(value) >= r[low])) & (r[high].isNull() | (F.col(value) <= r[high]))
    hit = df.join(grades, key).withColumn("_hit", F.get(F.filter("_grades", holds), F.lit(0))).where("_hit is not null")
    return hit.select(*df.columns, *(f"_hit.{c}" for c in cols))
