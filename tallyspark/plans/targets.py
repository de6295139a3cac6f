"""Targets of value, volume and active outlets, and what they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.numeric import MONEY, delta_pct, ratio
from ..functions.text import norm_key
from ..operators.joins import full_outer, full_outer_named
from ..operators.reshape import unpivot_months
from ..sources.tables import invoice_lines
from .daily import _AO, DIMS, YEAR, active_outlets, wide_target
from .frames_sql import INV

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def value_targets(spark, sf_dir) -> DataFrame:
    return unpivot_months(wide_target(spark, sf_dir), DIMS)


def volume_targets(spark, sf_dir) -> DataFrame:
    """Targets in volume, which only the division ICI has."""
    return unpivot_months(wide_target(spark, sf_dir, "volume").where("division = 'ICI'"), DIMS)


def _last_year(col: str, name: str, more: str = "") -> str:
    return f"{name} AS (SELECT branch, salesman, division, sku, CAST(month(invoice_date) AS INTEGER) AS month_num, CAST(sum({col}) * 1.05::DECIMAL(3,2) AS DECIMAL(18,2)) AS target FROM inv WHERE year(invoice_date) = {YEAR - 1}{more} GROUP BY 1, 2, 3, 4, 5 HAVING CAST(sum({col}) * 1.05::DECIMAL(3,2) AS DECIMAL(18,2)) <> 0)"


_VAL, _VOL = _last_year("net", "val"), _last_year("volume", "vol", " AND division = 'ICI'")


@query("q_targets_union", f"WITH {INV}, {_VAL}, {_VOL} SELECT branch, salesman, division, sku, month_num, 'Value' AS kind, CAST(target AS DOUBLE) AS target FROM val WHERE division <> 'ICI' UNION ALL SELECT branch, salesman, division, sku, month_num, 'Volume', CAST(target AS DOUBLE) FROM vol")
def targets_union(spark, sf_dir):
    """One list of targets: in volume for ICI, in value for the rest."""
    value = value_targets(spark, sf_dir).where("division <> 'ICI'").withColumn("kind", F.lit("Value"))
    both = value.unionByName(volume_targets(spark, sf_dir).withColumn("kind", F.lit("Volume")))
    return both.select(*DIMS, "month_num", "kind", F.col("target").cast("double").alias("target"))


@query("q_ici_quantity", f"WITH {INV}, {_VAL}, {_VOL} SELECT val.branch, val.salesman, val.division, val.sku, val.month_num, CAST(val.target AS DOUBLE) AS target_value, CAST(vol.target AS DOUBLE) AS target_volume, CAST(val.target AS DOUBLE) / CAST(vol.target AS DOUBLE) AS price FROM val LEFT JOIN vol USING (branch, salesman, division, sku, month_num) WHERE val.division = 'ICI'")
def ici_quantity(spark, sf_dir):
    """The value targets of ICI with their volume beside them, and the price that both imply."""
    value = value_targets(spark, sf_dir).where("division = 'ICI'").withColumnRenamed("target", "value")
    df = value.join(volume_targets(spark, sf_dir).withColumnRenamed("target", "volume"), [*DIMS, "month_num"], "left")
    return df.select(*DIMS, "month_num", F.col("value").cast("double").alias("target_value"), F.col("volume").cast("double").alias("target_volume"), ratio(F.col("value"), F.col("volume")).alias("price"))


@query("q_ao_vs_target", f"WITH {INV}, {_AO}, t AS (SELECT salesman AS seller, division AS division_mapped, CAST(month(invoice_date) AS INTEGER) AS month_mapped, count(DISTINCT customer_name) AS target_ao FROM inv WHERE year(invoice_date) = {YEAR - 1} AND branch <> 'Project' GROUP BY 1, 2, 3) SELECT coalesce(salesman, seller) AS salesman, coalesce(division, division_mapped) AS division, coalesce(month_num, month_mapped) AS month_num, coalesce(total_ao, 0) AS total_ao, coalesce(target_ao, 0) AS target_ao, CAST(coalesce(total_ao, 0) AS DOUBLE) / nullif(CAST(coalesce(target_ao, 0) AS DOUBLE), 0) AS achievement FROM ao FULL JOIN t ON salesman = seller AND division = division_mapped AND month_num = month_mapped")
def ao_vs_target(spark, sf_dir):
    """Active outlets against their target: last year's number of customers of the salesman, division and month."""
    last = invoice_lines(spark, sf_dir).where((F.year("invoice_date") == YEAR - 1) & ~rules.excluded_target(F.col("branch")))
    target = last.groupBy(F.col("salesman").alias("seller"), F.col("division").alias("division_mapped"), F.month("invoice_date").alias("month_mapped")).agg(F.count_distinct("customer_name").alias("target_ao"))
    both = full_outer_named(active_outlets(spark, sf_dir), target, {"salesman": "seller", "division": "division_mapped", "month_num": "month_mapped"}).fillna(0, ["total_ao", "target_ao"])
    return both.select("salesman", "division", "month_num", "total_ao", "target_ao", ratio(F.col("total_ao"), F.col("target_ao")).alias("achievement"))


_KEY = "regexp_replace(lower(trim(sku)), '[^a-z0-9]', '', 'g')"


@query("q_report_vs_target", f"""WITH {INV}, a AS (SELECT strftime(invoice_date, '%Y-%m') AS year_month, branch, salesman, {_KEY} AS sku_key, sum(net) AS net FROM inv WHERE year(invoice_date) = {YEAR} GROUP BY 1, 2, 3, 4),
t AS (SELECT '{YEAR}-' || strftime(invoice_date, '%m') AS year_month, branch, salesman, {_KEY} AS sku_key, CAST(sum(net) * 1.05::DECIMAL(3,2) AS DECIMAL(18,2)) AS target FROM inv WHERE year(invoice_date) = {YEAR - 1} GROUP BY 1, 2, 3, 4),
b AS (SELECT year_month, branch, salesman, sku_key, CAST(coalesce(net, 0) AS DOUBLE) AS net, CAST(coalesce(target, 0) AS DOUBLE) AS target FROM a FULL JOIN t USING (year_month, branch, salesman, sku_key))
SELECT *, CASE WHEN target = 0 THEN 0 ELSE (net - target) / abs(target) * 100 END AS delta_pct FROM b""")
def report_vs_target(spark, sf_dir):
    """Actual and target by month, branch, salesman and key of the product group; both years in one pass each."""
    inv = invoice_lines(spark, sf_dir)
    keys = ["year_month", "branch", "salesman", "sku_key"]
    of = lambda year: inv.where(F.year("invoice_date") == year).groupBy(F.concat(F.lit(f"{YEAR}-"), F.date_format("invoice_date", "MM")).alias("year_month"), "branch", "salesman", norm_key(F.col("sku")).alias("sku_key"))
    actual = of(YEAR).agg(F.sum("net").alias("net"))
    target = of(YEAR - 1).agg((F.sum("net") * F.lit(1.05).cast("decimal(3,2)")).cast(MONEY).alias("target"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast(MONEY)).cast("double")
    both = full_outer(actual, target, keys).select(*keys, zero("net").alias("net"), zero("target").alias("target"))
    return both.withColumn("delta_pct", delta_pct(F.col("net"), F.col("target")))
