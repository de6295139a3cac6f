"""Report metrics: period comparisons, Pareto, efficiency, mix, trends; visit tracking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import overlap_days
from ..functions.numeric import delta_pct, ratio, total
from ..operators.joins import full_outer
from ..operators.order import numbered
from ..operators.reshape import month_scaffold, unpivot_months
from ..operators.windows import change_pct
from ..sources.tables import invoice_lines, visits
from .daily import _TARGET, DIMS, YEAR, wide_target
from .frames_sql import INV, VISIT

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_DELTA = "CASE WHEN coalesce({b}, 0) = 0 THEN 0 ELSE ({a} - {b}) / abs({b}) * 100 END"


@query("q_dim_compare", f"WITH {INV}, a AS (SELECT branch, division, sum(net) FILTER (year(invoice_date) = {YEAR}) AS n, sum(net) FILTER (year(invoice_date) = {YEAR - 1}) AS p FROM inv GROUP BY 1, 2), c AS (SELECT branch, division, CAST(coalesce(n, 0) AS DOUBLE) AS now, CAST(coalesce(p, 0) AS DOUBLE) AS before FROM a) SELECT *, now - before AS diff, {_DELTA.format(a='now', b='before')} AS diff_pct FROM c")
def dim_compare(spark, sf_dir):
    """Two periods side by side: one pass of conditional sums instead of a full join."""
    y = F.year("invoice_date")
    c = invoice_lines(spark, sf_dir).groupBy("branch", "division").agg(total(F.when(y == YEAR, F.col("net"))).alias("now"), total(F.when(y == YEAR - 1, F.col("net"))).alias("before"))
    return c.withColumns({"diff": F.col("now") - F.col("before"), "diff_pct": delta_pct(F.col("now"), F.col("before"))})


@query("q_pareto", f"WITH {INV}, s AS (SELECT product_name AS entity, sum(net) AS revenue FROM inv GROUP BY 1), c AS (SELECT entity, CAST(revenue AS DOUBLE) AS revenue, CAST(sum(revenue) OVER (ORDER BY revenue DESC, entity ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / CAST(sum(revenue) OVER () AS DOUBLE) * 100 AS cumulative_pct, row_number() OVER (ORDER BY revenue DESC, entity) AS place FROM s) SELECT *, count(*) FILTER (cumulative_pct <= 80) OVER () + 1 AS n_80 FROM c QUALIFY place <= 12")
def pareto(spark, sf_dir):
    """Twelve largest entities with their cumulative share, and how many make up 80 percent."""
    s = invoice_lines(spark, sf_dir).groupBy(F.col("product_name").alias("entity")).agg(F.sum("net").alias("r"))
    c = numbered(s, [F.desc("r"), F.col("entity")], "r").withColumns({"cumulative_pct": F.col("_upto").cast("double") / F.col("_sum").cast("double") * 100, "place": F.col("_place") + 1})
    within = c.agg((F.count(F.when(F.col("cumulative_pct") <= 80, 1)) + 1).alias("n_80"))  # one row
    return c.where("place <= 12").join(F.broadcast(within)).select("entity", F.col("r").cast("double").alias("revenue"), "cumulative_pct", F.col("place").cast("long").alias("place"), "n_80")


@query("q_efficiency", f"WITH {INV}, s AS (SELECT salesman, CAST(sum(net) AS DOUBLE) AS revenue, count(net) AS n FROM inv GROUP BY 1), a AS (SELECT *, revenue / nullif(CAST(n AS DOUBLE), 0) AS basket FROM s) SELECT *, revenue / max(revenue) OVER () * 50 + basket / max(basket) OVER () * 50 AS score FROM a")
def efficiency(spark, sf_dir):
    s = invoice_lines(spark, sf_dir).groupBy("salesman").agg(total(F.col("net")).alias("revenue"), F.count("net").alias("n")).withColumn("basket", ratio(F.col("revenue"), F.col("n")))
    every = W.partitionBy()
    return s.withColumn("score", F.col("revenue") / F.max("revenue").over(every) * 50 + F.col("basket") / F.max("basket").over(every) * 50)


@query("q_division_mix", f"WITH {INV}, s AS (SELECT division, sum(net) AS r FROM inv GROUP BY 1) SELECT division, CAST(r AS DOUBLE) AS revenue, CAST(r AS DOUBLE) / CAST(sum(r) OVER () AS DOUBLE) * 100 AS share_pct FROM s QUALIFY row_number() OVER (ORDER BY r DESC, division) <= 4")
def division_mix(spark, sf_dir):
    s = invoice_lines(spark, sf_dir).groupBy("division").agg(F.sum("net").alias("r"))
    s = s.withColumns({"share_pct": F.col("r").cast("double") / F.sum("r").over(W.partitionBy()).cast("double") * 100, "place": F.row_number().over(W.orderBy(F.desc("r"), "division"))})
    return s.where("place <= 4").select("division", F.col("r").cast("double").alias("revenue"), "share_pct")


@query("q_weekly", f"WITH {INV}, s AS (SELECT CAST(date_trunc('week', invoice_date) AS DATE) AS week, CAST(sum(net) AS DOUBLE) AS revenue FROM inv GROUP BY 1) SELECT *, (revenue - lag(revenue) OVER (ORDER BY week)) / nullif(lag(revenue) OVER (ORDER BY week), 0) * 100 AS change_pct, avg(revenue) OVER (ORDER BY week ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rolling_mean FROM s")
def weekly(spark, sf_dir):
    s = invoice_lines(spark, sf_dir).groupBy(F.date_trunc("week", "invoice_date").cast("date").alias("week")).agg(total(F.col("net")).alias("revenue"))
    return s.withColumns({"change_pct": change_pct("revenue", "week"), "rolling_mean": F.avg("revenue").over(W.orderBy("week").rowsBetween(-2, 0))})


def to_date_frame(spark, sf_dir, unit: str, back: int) -> DataFrame:
    """Sums from the start of the period to the last date, and over the same days of the period before."""
    inv = invoice_lines(spark, sf_dir)
    last = inv.agg(F.max("invoice_date").alias("last"))  # one row
    start = F.trunc("last", unit)
    frame = last.select("last", start.alias("start"), F.add_months(start, -back).alias("p_start")).withColumn("p_last", F.least(F.date_add("p_start", F.datediff("last", "start")), F.date_sub("start", 1)))
    df = inv.join(F.broadcast(frame))
    d = F.col("invoice_date")
    out = df.groupBy("branch").agg(total(F.when(d.between(F.col("start"), F.col("last")), F.col("net"))).alias("now"), total(F.when(d.between(F.col("p_start"), F.col("p_last")), F.col("net"))).alias("before"), F.max("start").alias("start"), F.max("p_last").alias("p_last"))
    return out.withColumn("diff_pct", delta_pct(F.col("now"), F.col("before")))


def _to_date(unit, months):
    return f"WITH {INV}, l AS (SELECT max(invoice_date) AS last FROM inv), f AS (SELECT last, CAST(date_trunc('{unit}', last) AS DATE) AS start, CAST(date_trunc('{unit}', last) - INTERVAL {months} MONTH AS DATE) AS p_start FROM l), g AS (SELECT *, least(p_start + CAST(date_diff('day', start, last) AS INTEGER), start - 1) AS p_last FROM f), s AS (SELECT branch, CAST(coalesce(sum(net) FILTER (invoice_date BETWEEN start AND last), 0) AS DOUBLE) AS now, CAST(coalesce(sum(net) FILTER (invoice_date BETWEEN p_start AND p_last), 0) AS DOUBLE) AS before, max(start) AS start, max(p_last) AS p_last FROM inv, g GROUP BY 1) SELECT *, {_DELTA.format(a='now', b='before')} AS diff_pct FROM s"


@query("q_qtd", _to_date("quarter", 3))
def qtd(spark, sf_dir):
    return to_date_frame(spark, sf_dir, "quarter", 3)


@query("q_ytd", _to_date("year", 12))
def ytd(spark, sf_dir):
    return to_date_frame(spark, sf_dir, "year", 12)


@query("q_completed_quarter", f"WITH {INV}, l AS (SELECT CAST(date_trunc('quarter', max(invoice_date) + 1) AS DATE) AS stop FROM inv) SELECT CAST(date_trunc('quarter', invoice_date) AS DATE) AS quarter, CAST(sum(net) AS DOUBLE) AS revenue, count(DISTINCT customer_code) AS n_customers FROM inv, l WHERE invoice_date < stop GROUP BY 1")
def completed_quarter(spark, sf_dir):
    """Quarters that are over by the last date of the data."""
    inv = invoice_lines(spark, sf_dir)
    stop = inv.agg(F.trunc(F.date_add(F.max("invoice_date"), 1), "quarter").alias("stop"))  # one row
    return inv.join(F.broadcast(stop)).where("invoice_date < stop").groupBy(F.trunc("invoice_date", "quarter").alias("quarter")).agg(total(F.col("net")).alias("revenue"), F.count_distinct("customer_code").alias("n_customers"))


@query("q_target_window_alloc", f"""WITH {INV}, {_TARGET}, t AS (SELECT division, month_num, sum(target) AS target FROM target GROUP BY 1, 2), w AS (SELECT *, make_date({YEAR}, month_num, 1) AS first_day, last_day(make_date({YEAR}, month_num, 1)) AS final_day FROM t),
o AS (SELECT *, greatest(date_diff('day', greatest(first_day, DATE '{YEAR}-02-10'), least(final_day, DATE '{YEAR}-05-20')) + 1, 0) AS days, date_diff('day', first_day, final_day) + 1 AS month_days FROM w)
SELECT division, month_num, CAST(days AS INTEGER) AS days, CAST(target AS DOUBLE) AS target, CAST(target AS DOUBLE) * days / month_days AS allocated FROM o WHERE days > 0""")
def target_window_alloc(spark, sf_dir):
    """Monthly targets spread over the days that a window shares with the month."""
    t = unpivot_months(wide_target(spark, sf_dir), DIMS).groupBy("division", "month_num").agg(F.sum("target").alias("t"))
    first = F.make_date(F.lit(YEAR), "month_num", F.lit(1))
    last = F.last_day(first)
    t = t.withColumns({"days": overlap_days(first, last, F.lit(f"{YEAR}-02-10").cast("date"), F.lit(f"{YEAR}-05-20").cast("date")), "month_days": F.datediff(last, first) + 1}).where("days > 0")
    return t.select("division", "month_num", "days", F.col("t").cast("double").alias("target"), (F.col("t").cast("double") * F.col("days") / F.col("month_days")).alias("allocated"))


@query("q_unit_vs_target", f"""WITH {INV}, {_TARGET}, a AS (SELECT sku, CASE WHEN division = 'ICI' THEN 'Volume' ELSE 'Value' END AS unit, sum(CASE WHEN division = 'ICI' THEN volume ELSE net END) AS actual FROM inv WHERE year(invoice_date) = {YEAR} GROUP BY 1, 2), t AS (SELECT sku, CASE WHEN division = 'ICI' THEN 'Volume' ELSE 'Value' END AS unit, sum(target) AS target FROM target WHERE month_num <= 6 GROUP BY 1, 2)
SELECT coalesce(a.sku, t.sku) AS sku, coalesce(a.unit, t.unit) AS unit, CAST(coalesce(actual, 0) AS DOUBLE) AS actual, CAST(coalesce(target, 0) AS DOUBLE) AS target, CAST(coalesce(actual, 0) AS DOUBLE) / nullif(CAST(coalesce(target, 0) AS DOUBLE), 0) AS achievement FROM a FULL JOIN t ON a.sku = t.sku AND a.unit = t.unit""")
def unit_vs_target(spark, sf_dir):
    unit = F.when(F.col("division") == "ICI", "Volume").otherwise("Value")
    a = invoice_lines(spark, sf_dir).where(F.year("invoice_date") == YEAR).groupBy("sku", unit.alias("unit")).agg(F.sum(F.when(F.col("division") == "ICI", F.col("volume")).otherwise(F.col("net"))).alias("actual"))
    t = unpivot_months(wide_target(spark, sf_dir), DIMS).where("month_num <= 6").groupBy("sku", unit.alias("unit")).agg(F.sum("target").alias("target"))
    z = lambda c: F.coalesce(c, F.lit(0)).cast("double").alias(c)
    return full_outer(a, t, ["sku", "unit"]).select("sku", "unit", z("actual"), z("target")).withColumn("achievement", ratio(F.col("actual"), F.col("target")))


@query("q_trend_stats", f"""WITH {INV}, b AS (SELECT CAST(date_trunc('month', min(invoice_date)) AS DATE) AS lo, CAST(date_trunc('month', max(invoice_date)) AS DATE) AS hi FROM inv), d AS (SELECT DISTINCT division FROM inv), sc AS (SELECT division, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS month FROM d, b),
m AS (SELECT division, CAST(date_trunc('month', invoice_date) AS DATE) AS month, sum(net) AS net FROM inv GROUP BY 1, 2), f AS (SELECT sc.division, sc.month, CAST(coalesce(net, 0) AS DOUBLE) AS revenue, row_number() OVER (PARTITION BY sc.division ORDER BY sc.month) - 1 AS x FROM sc LEFT JOIN m ON sc.division = m.division AND sc.month = m.month),
c AS (SELECT *, CASE WHEN coalesce(lag(revenue) OVER w, 0) = 0 THEN NULL ELSE (revenue - lag(revenue) OVER w) / lag(revenue) OVER w * 100 END AS ch FROM f WINDOW w AS (PARTITION BY division ORDER BY month)),
g AS (SELECT division, count(*) AS n_months, regr_slope(revenue, x) / nullif(abs(avg(revenue)), 0) * 100 AS slope_pct, stddev_pop(abs(revenue)) / nullif(avg(abs(revenue)), 0) * 100 AS volatility_pct, max(CASE WHEN month = (SELECT hi FROM b) THEN ch END) AS c1, max(CASE WHEN month = (SELECT hi - INTERVAL 1 MONTH FROM b) THEN ch END) AS c2, max(CASE WHEN month = (SELECT hi - INTERVAL 2 MONTH FROM b) THEN ch END) AS c3 FROM c GROUP BY 1)
SELECT division, n_months, round(slope_pct, 6) AS slope_pct, round(volatility_pct, 6) AS volatility_pct, CASE WHEN c1 < -1 AND c2 < -1 AND c3 < -1 THEN 'koreksi beruntun' WHEN c1 > 1 AND c2 > 1 AND c3 > 1 THEN 'ekspansi beruntun' WHEN c2 < -1 AND c1 > 1 THEN 'rebound awal' WHEN c2 > 1 AND c1 < -1 THEN 'pembalikan negatif' WHEN volatility_pct >= 22 THEN 'fluktuatif' WHEN slope_pct > 2 THEN 'uptrend bertahap' WHEN slope_pct < -2 THEN 'downtrend bertahap' ELSE 'sideways terkendali' END AS pattern FROM g""")
def trend_stats(spark, sf_dir):
    """Slope, volatility and pattern of monthly revenue, months without sales filled with 0.  Lines are read once: divisions,
    months and the whole span come out of one row a division and month."""
    month = F.trunc("invoice_date", "month")
    m = invoice_lines(spark, sf_dir).groupBy("division", month.alias("month")).agg(F.sum("net").alias("net"))
    every = W.partitionBy()  # over divisions and months
    m = m.withColumns({"lo": F.min("month").over(every), "hi": F.max("month").over(every)})
    known = F.when(F.col("month").isNotNull(), F.struct("month", F.coalesce("net", F.lit(0)).cast("double").alias("revenue")))
    held = m.groupBy("division").agg(F.map_from_entries(F.collect_list(known)).alias("held"), F.max("lo").alias("lo"), F.max("hi").alias("hi"))  # as many entries as months
    w = W.partitionBy("division").orderBy("month")
    f = month_scaffold(held, "lo", "hi").select("division", "month", "hi", F.coalesce(F.try_element_at("held", "month"), F.lit(0.0)).alias("revenue")).withColumn("x", F.row_number().over(w) - 1).withColumn("ch", change_pct("revenue", "month", ["division"]))
    at = lambda k: F.max(F.when(F.col("month") == F.add_months(F.trunc("hi", "month"), -k), F.col("ch")))
    g = f.groupBy("division").agg(F.count("*").alias("n_months"), (F.try_divide(F.regr_slope("revenue", "x"), F.abs(F.avg("revenue"))) * 100).alias("slope"), (F.try_divide(F.stddev_pop(F.abs("revenue")), F.avg(F.abs("revenue"))) * 100).alias("vol"), at(0).alias("c1"), at(1).alias("c2"), at(2).alias("c3"))
    c1, c2, c3 = F.col("c1"), F.col("c2"), F.col("c3")
    pattern = (
        F.when((c1 < -1) & (c2 < -1) & (c3 < -1), "koreksi beruntun").when((c1 > 1) & (c2 > 1) & (c3 > 1), "ekspansi beruntun").when((c2 < -1) & (c1 > 1), "rebound awal").when((c2 > 1) & (c1 < -1), "pembalikan negatif")
        .when(F.col("vol") >= 22, "fluktuatif").when(F.col("slope") > 2, "uptrend bertahap").when(F.col("slope") < -2, "downtrend bertahap").otherwise("sideways terkendali")
    )
    return g.select("division", "n_months", F.round("slope", 6).alias("slope_pct"), F.round("vol", 6).alias("volatility_pct"), pattern.alias("pattern"))


@query("q_visit_summary", f"WITH {VISIT} SELECT salesman, visit_date, branch, count(*) AS planned_visits FROM visit GROUP BY 1, 2, 3")
def visit_summary(spark, sf_dir):
    """Planned visits; a missing branch is a group of its own."""
    return visits(spark, sf_dir).groupBy("salesman", "visit_date", "branch").agg(F.count("*").alias("planned_visits"))


@query("q_visit_status", f"WITH {VISIT} SELECT salesman, visit_date, branch, CASE WHEN status = '' THEN 'Unknown' ELSE status END AS status, count(*) AS visits FROM visit GROUP BY 1, 2, 3, 4")
def visit_status(spark, sf_dir):
    return visits(spark, sf_dir).withColumn("status", F.when(F.col("status") == "", "Unknown").otherwise(F.col("status"))).groupBy("salesman", "visit_date", "branch", "status").agg(F.count("*").alias("visits"))
