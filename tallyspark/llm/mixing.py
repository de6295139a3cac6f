"""Mixing sources to target weights by a time-varying curriculum (DataFrame functions only).

Every source has a share of the mix and a weight schedule over training time t in [0, 1].
The integral of a linear schedule from ``a`` to ``b`` (mean 1) is F(t) = a t + (b - a) t^2 / 2;
the words a source has delivered by t are target * F(t).  A document whose words begin at word c
of its source's stream is trained at t = F^-1(c / target), and the range sort over t is the
training order.  Prefix sums are taken in two levels (hash bucket, then inside the bucket), so a
source that holds most rows is spread over thousands of window groups.

Defined cases: null text has size 0; a null source is a source of its own, ordered last; rows with
the same id are separate documents, interchangeable in order; an empty table gives an empty result;
extra columns are kept (internal names start with ``_mx_``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

WORD = r"[^\x20\x09-\x0D]+"
#: Start and end factor of the schedules, dealt to the sources in turn: rising, level, falling.
RAMPS = ((0.5, 1.5), (1.0, 1.0), (1.5, 0.5))


def _turn(idx: Column, values) -> Column:
    """values[idx mod len(values)] as a chain of literals."""
    out = F.lit(float(values[-1]))
    for k in range(len(values) - 2, -1, -1):
        out = F.when((idx % len(values)) == k, F.lit(float(values[k]))).otherwise(out)
    return out


def source_targets(sizes: DataFrame, weights=(3, 1, 2), budget: float = 1.5, epochs: int = 2) -> DataFrame:
    """One row per source key: size, weight turn, target.  Weighted water-filling in closed form:
    sources sorted by cap/weight are capped while the level of the rest lies above their ratio."""
    every = W.orderBy(F.col("_mx_source").asc_nulls_last())
    s = sizes.groupBy("_mx_source").agg(F.sum("_mx_size").alias("_mx_total"))
    s = s.withColumn("_mx_idx", F.row_number().over(every) - 1)
    s = s.withColumn("_mx_w", _turn(F.col("_mx_idx"), weights)).withColumn("_mx_cap", F.col("_mx_total").cast("double") * F.lit(float(epochs)))
    by = W.orderBy((F.col("_mx_cap") / F.col("_mx_w")).asc(), F.col("_mx_idx").asc())
    before, rest, whole = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(0, W.unboundedFollowing), by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("_mx_level", (F.sum("_mx_total").over(whole).cast("double") * F.lit(float(budget)) - F.coalesce(F.sum("_mx_cap").over(before), F.lit(0.0))) / F.sum("_mx_w").over(rest))
    s = s.withColumn("_mx_free", F.when(F.col("_mx_level") <= F.col("_mx_cap") / F.col("_mx_w"), F.col("_mx_level")))
    s = s.withColumn("_mx_at", F.first("_mx_free", ignorenulls=True).over(whole))
    return s.select("_mx_source", "_mx_idx", "_mx_total", F.least(F.col("_mx_cap"), F.col("_mx_at") * F.col("_mx_w")).alias("_mx_target"))


def _when_trained(q: Column, a: Column, b: Column) -> Column:
    """F^-1(q) of the linear schedule from a to b."""
    d = b - a
    return F.when(d == 0.0, q).otherwise((F.sqrt(a * a + F.lit(2.0) * d * q) - a) / F.when(d == 0.0, F.lit(1.0)).otherwise(d))


def curriculum(docs: DataFrame, weights=(3, 1, 2), budget: float = 1.5, epochs: int = 2, ramps=RAMPS, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """docs plus _mx_size, _mx_total, _mx_target, and _mx_takes: array of (pass, words, position)."""
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    sized = docs.withColumns({
        "_mx_size": F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long"),
        "_mx_source": F.col(source_col),
        "_mx_sk": F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")),
        "_mx_key": key,
        "_mx_bucket": F.substring(key, 1, 3),
    })
    sums = sized.groupBy("_mx_source", "_mx_sk", "_mx_bucket").agg(F.sum("_mx_size").alias("_mx_size"))
    targets = source_targets(sums, weights, budget, epochs)
    sk = F.coalesce(F.concat(F.lit("s"), F.col("_mx_source").cast("string")), F.lit("n"))
    starts = sums.select("_mx_sk", "_mx_bucket", F.coalesce(F.sum("_mx_size").over(W.partitionBy("_mx_sk").orderBy("_mx_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_mx_start"))
    starts = starts.join(targets.select(sk.alias("_mx_sk"), "_mx_idx", "_mx_total", "_mx_target"), "_mx_sk")
    inside = W.partitionBy("_mx_sk", "_mx_bucket").orderBy("_mx_key", "_mx_size").rowsBetween(W.unboundedPreceding, -1)
    rows = sized.join(starts, ["_mx_sk", "_mx_bucket"]).withColumn("_mx_from", F.col("_mx_start") + F.coalesce(F.sum("_mx_size").over(inside), F.lit(0)))
    goal = F.floor(F.col("_mx_target") + 0.5)
    a, b = (_turn(F.col("_mx_idx"), [r[k] for r in ramps]) for k in (0, 1))

    def take(r: int) -> Column:
        start = F.col("_mx_from") + F.col("_mx_total") * r
        words = F.greatest(F.lit(0), F.least(F.col("_mx_size"), goal - start)).cast("long")
        q = start.cast("double") / F.when(goal > 0, goal).otherwise(F.lit(1)).cast("double")
        return F.struct(F.lit(r).alias("pass"), words.alias("words"), F.when(words > 0, _when_trained(q, a, b)).alias("position"))

    return rows.withColumn("_mx_takes", F.array(*(take(r) for r in range(epochs)))).drop("_mx_sk", "_mx_bucket", "_mx_start", "_mx_from", "_mx_source", "_mx_idx")


def training_order(docs: DataFrame, **how) -> DataFrame:
    """One row per use of a document: its columns, mix_pass, mix_words (a whole document, or its first
    words where the target ends inside it) and mix_position, range-sorted by position."""
    cols = [c for c in docs.columns]
    rows = curriculum(docs, **how).select(*cols, "_mx_key", F.explode(F.filter("_mx_takes", lambda t: t["words"] > 0)).alias("_mx_take"))
    rows = rows.select(*cols, "_mx_key", F.col("_mx_take.pass").alias("mix_pass"), F.col("_mx_take.words").alias("mix_words"), F.col("_mx_take.position").alias("mix_position"))
    return rows.repartitionByRange("mix_position", "_mx_key").sortWithinPartitions("mix_position", "_mx_key").drop("_mx_key")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: size, source_size, target, taken (words over both passes), position of its first use."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows = curriculum(docs).select(
        "doc_id",
        F.col("_mx_size").alias("size"),
        F.col("_mx_total").alias("source_size"),
        F.col("_mx_target").alias("target"),
        F.aggregate("_mx_takes", F.lit(0).cast("long"), lambda s, t: s + t["words"]).alias("taken"),
        F.col("_mx_takes")[0]["position"].alias("position"),
        "_mx_key",
    )
    return rows.repartitionByRange("position", "_mx_key").sortWithinPartitions("position", "_mx_key").drop("_mx_key")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS total, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS idx FROM d GROUP BY source),
w AS (SELECT *, CASE idx % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, total::DOUBLE * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(total) OVER ()::DOUBLE * 1.5::DOUBLE
          - coalesce(sum(cap) OVER (ORDER BY cap / w, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / sum(w) OVER (ORDER BY cap / w, idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
v AS (SELECT arg_min(level, cap / w) AS level FROM l WHERE level <= cap / w),
t AS (SELECT source, idx, total, least(cap, v.level * w) AS target FROM l, v),
c AS (SELECT d.doc_id, d.size, t.total, t.target, t.idx, floor(t.target + 0.5)::BIGINT AS goal,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c0
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, total AS source_size, target,
  (greatest(0, least(size, goal - c0)) + greatest(0, least(size, goal - c0 - total)))::BIGINT AS taken,
  CASE WHEN least(size, goal - c0) > 0 THEN CASE idx % 3
    WHEN 0 THEN (sqrt(0.25::DOUBLE + 2.0::DOUBLE * 1.0::DOUBLE * (c0::DOUBLE / goal::DOUBLE)) - 0.5::DOUBLE) / 1.0::DOUBLE
    WHEN 1 THEN c0::DOUBLE / goal::DOUBLE
    ELSE (sqrt(2.25::DOUBLE + 2.0::DOUBLE * -1.0::DOUBLE * (c0::DOUBLE / goal::DOUBLE)) - 1.5::DOUBLE) / -1.0::DOUBLE END END AS position
FROM c
"""
