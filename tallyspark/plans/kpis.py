"""The report's key figures: every period and dimension out of one aggregation with grouping sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import delta_pct, ratio, ratio0
from ..operators.stage import staged
from ..sources.tables import invoice_lines
from .frames_sql import INV

QUERIES, SQL = {}, {}
DIMENSIONS = ("branch", "salesman", "sku")
#: Period and the one it is held against, as (name, other): ranges are made by ``calendar``.
PAIRS = (("day", "day_before"), ("week", "week_before"), ("month", "month_before"), ("qtd", "qtd_before"), ("ytd", "ytd_before"), ("full_month", "full_month_before"), ("full_quarter", "full_quarter_before"))
PERIODS = tuple(p for pair in PAIRS for p in pair)
#: Status of paid invoices in the test tables.
PAID = "A"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def calendar(lines: DataFrame) -> DataFrame:
    """One row: first and last day of every period, as of the last day with data.  Day, week and month are held against the
    last ones before that have data; periods to date against the same number of days; full ones against full ones."""
    days = lines.agg(F.array_sort(F.collect_set("invoice_date")).alias("days"))  # as many as days
    last = F.array_max("days")
    start = lambda unit: F.trunc(last, unit)
    before = lambda day: F.array_max(F.filter("days", lambda d: d < day))
    back = lambda unit, months: F.add_months(start(unit), -months)
    end = lambda unit, months: F.date_sub(F.add_months(start(unit), -months), 1)
    gone = lambda unit: F.datediff(last, start(unit))
    week, month = F.trunc(before(start("week")), "week"), F.trunc(before(start("month")), "month")
    ranges = {
        "day": (last, last), "day_before": (before(last), before(last)),
        "week": (start("week"), last), "week_before": (week, F.date_add(week, 6)),
        "month": (start("month"), last), "month_before": (month, F.last_day(month)),
        "qtd": (start("quarter"), last), "qtd_before": (back("quarter", 3), F.date_add(back("quarter", 3), gone("quarter"))),
        "ytd": (start("year"), last), "ytd_before": (back("year", 12), F.date_add(back("year", 12), gone("year"))),
        "full_month": (back("month", 1), end("month", 0)), "full_month_before": (back("month", 2), end("month", 1)),
        "full_quarter": (back("quarter", 3), end("quarter", 0)), "full_quarter_before": (back("quarter", 6), end("quarter", 3)),
    }
    return days.select(*(F.struct(a.alias("a"), b.alias("b")).alias(p) for p, (a, b) in ranges.items()))


def period_sums(lines: DataFrame) -> DataFrame:
    """Revenue, lines and paid revenue of each period, for all and for each member of each dimension (``dim`` and ``member``).
    Lines become sums of the days that lie within the same periods before they are dealt to the periods, of which a day has many."""
    held = lines.join(F.broadcast(calendar(lines)))  # one row
    bits = (F.when(F.col("invoice_date").between(F.col(f"{p}.a"), F.col(f"{p}.b")), 1 << k).otherwise(0) for k, p in enumerate(PERIODS))
    held = held.select(*DIMENSIONS, "net", "status", sum(bits, F.lit(0)).alias("within"))  # the periods that hold the day
    own = [F.sum("net").alias("revenue"), F.count("net").alias("lines"), F.sum(F.when(F.col("status") == PAID, F.col("net"))).alias("paid"), *(F.grouping(d).alias(f"g_{d}") for d in DIMENSIONS)]
    part = held.groupingSets([[F.col("within")], *([F.col(d), F.col("within")] for d in DIMENSIONS)], *map(F.col, DIMENSIONS), F.col("within")).agg(*own)
    sums = [F.sum(F.when(F.col("within").bitwiseAND(1 << i) != 0, F.col(k))).alias(f"{k}_{p}") for i, p in enumerate(PERIODS) for k in ("revenue", "lines", "paid")]
    out = part.groupBy(*DIMENSIONS, *(f"g_{d}" for d in DIMENSIONS)).agg(*sums)
    dim = F.coalesce(*(F.when(F.col(f"g_{d}") == 0, d) for d in DIMENSIONS))
    return out.select(dim.alias("dim"), F.coalesce(*(F.when(F.col(f"g_{d}") == 0, F.col(d)) for d in DIMENSIONS)).alias("member"), *(F.coalesce(F.col(f"{k}_{p}"), F.lit(0)).cast("double").alias(f"{k}_{p}") for p in PERIODS for k in ("revenue", "lines", "paid")))


def _figures(now: str, before: str) -> dict[str, Column]:
    c = F.col
    basket = lambda p: ratio0(c(f"revenue_{p}"), c(f"lines_{p}"))
    out = {f"{k}_{p}": c(f"{k}_{p}") for p in (now, before) for k in ("revenue", "lines")}
    out |= {f"{n}_{p}": f for p in (now, before) for n, f in (("basket", basket(p)), ("paid", c(f"paid_{p}")), ("open", c(f"revenue_{p}") - c(f"paid_{p}")), ("paid_pct", ratio0(c(f"paid_{p}"), c(f"revenue_{p}")) * 100))}
    return out | {f"revenue_{now}_diff": c(f"revenue_{now}") - c(f"revenue_{before}"), f"revenue_{now}_pct": delta_pct(c(f"revenue_{now}"), c(f"revenue_{before}")), f"lines_{now}_pct": delta_pct(c(f"lines_{now}"), c(f"lines_{before}")), f"basket_{now}_pct": delta_pct(basket(now), basket(before))}


def key_figures(lines: DataFrame) -> DataFrame:
    """(metric, value, label): some 200 figures.  best_ and worst_ name the member of a dimension whose revenue of a period
    rose and fell most, ties to the first name."""
    sums = staged(period_sums(lines), "report-sums")  # one row a member of a dimension, read three times
    figures = {k: v for pair in PAIRS for k, v in _figures(*pair).items()}
    entry = lambda name, value, label=None: F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"), (F.lit(None).cast("string") if label is None else label).alias("label"))
    whole = sums.where("dim is null").select(F.explode(F.array(*(entry(k, v) for k, v in figures.items()))).alias("m")).select("m.*")
    # one row a dimension
    diff = {now: F.col(f"revenue_{now}") - F.col(f"revenue_{before}") for now, before in PAIRS}
    what = {now: F.struct(d.alias("diff"), delta_pct(F.col(f"revenue_{now}"), F.col(f"revenue_{before}")).alias("pct"), F.col("member").alias("member")) for (now, before), d in zip(PAIRS, diff.values())}
    ends = sums.where("dim is not null").groupBy("dim").agg(*(x for now, _ in PAIRS for x in (F.min_by(what[now], F.struct(-diff[now], "member")).alias(f"best_{now}"), F.min_by(what[now], F.struct(diff[now], "member")).alias(f"worst_{now}"))))
    named = [F.struct(F.concat(F.lit(f"{side}_"), "dim", F.lit(f"_{now}_{k}")).alias("metric"), F.col(f"{side}_{now}.{k}").alias("value"), F.col(f"{side}_{now}.member").alias("label")) for now, _ in PAIRS for side in ("best", "worst") for k in ("diff", "pct")]
    share = sums.where("dim is not null").select("dim", "member", "revenue_month").withColumn("all", F.sum("revenue_month").over(W.partitionBy("dim")))
    top = share.groupBy("dim").agg(F.min_by(F.struct("member", ratio(F.col("revenue_month"), F.col("all")).alias("share")), F.struct(-F.col("revenue_month"), "member")).alias("t"), F.count(F.when(F.col("revenue_month") > 0, 1)).alias("active"))
    top = top.select(F.explode(F.array(F.struct(F.concat(F.lit("top_"), "dim", F.lit("_month_share_pct")).alias("metric"), (F.coalesce("t.share", F.lit(0.0)) * 100).alias("value"), F.col("t.member").alias("label")), F.struct(F.concat(F.lit("active_"), "dim", F.lit("_month")).alias("metric"), F.col("active").cast("double").alias("value"), F.lit(None).cast("string").alias("label")))).alias("m")).select("m.*")
    return whole.unionByName(ends.select(F.explode(F.array(*named)).alias("m")).select("m.*")).unionByName(top)


def _sql() -> str:
    last, lt = "(SELECT max(invoice_date) FROM inv)", "(SELECT max(invoice_date) FROM inv WHERE invoice_date < {})"
    start = lambda unit: f"CAST(date_trunc('{unit}', {last}) AS DATE)"
    back = lambda unit, m: f"CAST({start(unit)} - INTERVAL {m} MONTH AS DATE)"
    prior = lambda unit: f"CAST(date_trunc('{unit}', {lt.format(start(unit))}) AS DATE)"
    ranges = {
        "day": (last, last), "day_before": (lt.format(last), lt.format(last)), "week": (start("week"), last), "week_before": (prior("week"), f"{prior('week')} + 6"),
        "month": (start("month"), last), "month_before": (prior("month"), f"last_day({prior('month')})"),
        "qtd": (start("quarter"), last), "qtd_before": (back("quarter", 3), f"{back('quarter', 3)} + ({last} - {start('quarter')})::INTEGER"),
        "ytd": (start("year"), last), "ytd_before": (back("year", 12), f"{back('year', 12)} + ({last} - {start('year')})::INTEGER"),
        "full_month": (back("month", 1), f"{start('month')} - 1"), "full_month_before": (back("month", 2), f"{back('month', 1)} - 1"),
        "full_quarter": (back("quarter", 3), f"{start('quarter')} - 1"), "full_quarter_before": (back("quarter", 6), f"{back('quarter', 3)} - 1"),
    }
    values = ", ".join(f"('{p}', {a}, {b})" for p, (a, b) in ranges.items())
    pairs = ", ".join(f"('{a}', '{b}')" for a, b in PAIRS)
    delta = lambda a, b: f"CASE WHEN {b} = 0 THEN 0 ELSE ({a} - {b}) / abs({b}) * 100 END"
    sums = "CAST(coalesce(sum(net), 0) AS DOUBLE) AS revenue, CAST(count(net) AS DOUBLE) AS lines, CAST(coalesce(sum(net) FILTER (status = 'A'), 0) AS DOUBLE) AS paid"
    dims = " UNION ALL ".join(f"SELECT '{d}' AS dim, m.member, cal.p, {sums} FROM (SELECT DISTINCT {d} AS member FROM inv) m CROSS JOIN cal LEFT JOIN inv ON inv.{d} = m.member AND invoice_date BETWEEN a AND b GROUP BY 2, 3" for d in DIMENSIONS)
    figure = lambda name, value: f"SELECT {name} AS metric, CAST({value} AS DOUBLE) AS value, NULL AS label FROM wh"
    side = lambda s: " UNION ALL ".join(f"SELECT '{n}_' || dim || '_' || now || '_{k}', {k}, member FROM df QUALIFY row_number() OVER (PARTITION BY dim, now ORDER BY diff {o}, member) = 1" for n, o in (("best", "DESC"), ("worst", "ASC")) for k in ("diff", "pct"))
    return f"""WITH {INV}, cal AS MATERIALIZED (SELECT * FROM (VALUES {values}) t(p, a, b)), pr AS (SELECT * FROM (VALUES {pairs}) t(now, bef)),
al AS (SELECT p, {sums} FROM cal LEFT JOIN inv ON invoice_date BETWEEN a AND b GROUP BY 1), ab AS (SELECT *, CASE WHEN lines = 0 THEN 0 ELSE revenue / lines END AS basket FROM al),
wh AS (SELECT now, x.revenue, x.lines, x.basket, y.revenue AS revenue_b, y.lines AS lines_b, y.basket AS basket_b FROM pr JOIN ab x ON x.p = now JOIN ab y ON y.p = bef),
dm AS MATERIALIZED ({dims}), df AS (SELECT dim, member, now, x.revenue - y.revenue AS diff, {delta('x.revenue', 'y.revenue')} AS pct FROM pr JOIN dm x ON x.p = now JOIN dm y USING (dim, member) WHERE y.p = bef)
SELECT 'revenue_' || p AS metric, revenue AS value, CAST(NULL AS VARCHAR) AS label FROM ab UNION ALL SELECT 'lines_' || p, lines, NULL FROM ab UNION ALL SELECT 'basket_' || p, basket, NULL FROM ab UNION ALL SELECT 'paid_' || p, paid, NULL FROM ab UNION ALL SELECT 'open_' || p, revenue - paid, NULL FROM ab UNION ALL SELECT 'paid_pct_' || p, CASE WHEN revenue = 0 THEN 0 ELSE paid / revenue * 100 END, NULL FROM ab
UNION ALL {figure("'revenue_' || now || '_diff'", 'revenue - revenue_b')} UNION ALL {figure("'revenue_' || now || '_pct'", delta('revenue', 'revenue_b'))} UNION ALL {figure("'lines_' || now || '_pct'", delta('lines', 'lines_b'))} UNION ALL {figure("'basket_' || now || '_pct'", delta('basket', 'basket_b'))}
UNION ALL {side('')}
UNION ALL SELECT 'top_' || dim || '_month_share_pct', coalesce(revenue / nullif(sum(revenue) OVER (PARTITION BY dim), 0), 0) * 100, member FROM dm WHERE p = 'month' QUALIFY row_number() OVER (PARTITION BY dim ORDER BY revenue DESC, member) = 1
UNION ALL SELECT 'active_' || dim || '_month', CAST(count(*) FILTER (revenue > 0) AS DOUBLE), NULL FROM dm WHERE p = 'month' GROUP BY dim"""


_ROUND = "metric, round(value, 6) AS value, label"


@query("q_report_kpis", f"SELECT {_ROUND} FROM ({_sql()})")
def report_kpis(spark, sf_dir):
    """Lines are read for the calendar and for the sums: what both need of them is staged, so they are joined once."""
    lines = staged(invoice_lines(spark, sf_dir).select("invoice_date", *DIMENSIONS, "net", "status"), "report-lines")
    return key_figures(lines).withColumn("value", F.round("value", 6))
