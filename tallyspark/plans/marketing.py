"""Gift programmes: events, windows around them, uplift, cohorts, RFM segments, cashback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import ratio, total
from ..operators.aggs import mode_of
from ..operators.order import numbered
from ..operators.windows import keep_first, quartile
from ..sources.tables import gifts, purchases
from .frames_sql import BUY, GIFT

QUERIES, SQL = {}, {}
WINDOWS = (7, 14, 28, 60, 90)
PRIMARY = 28


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def gift_events(spark, sf_dir) -> DataFrame:
    """One row a customer, day and programme, with neighbours in time, weights, overlaps and maturity."""
    g = gifts(spark, sf_dir)
    keys = ["customer", "date", "program"]
    ev = g.groupBy(*keys).agg(F.count("*").alias("gift_count")).join(mode_of(g, keys, "branch"), keys)
    same = W.partitionBy("customer", "date")
    days = ev.select("customer", "date").distinct()
    line = W.partitionBy("customer").orderBy("date")
    days = days.withColumns({"prev_date": F.lag("date").over(line), "next_date": F.lead("date").over(line), "n_dates": F.count("*").over(W.partitionBy("customer"))})
    ev = ev.withColumn("same_day", F.count("*").over(same)).join(days, ["customer", "date"])
    bounds = purchases(spark, sf_dir).agg(F.min("date").alias("data_min"), F.max("date").alias("data_max"))  # one row
    ev = ev.join(F.broadcast(bounds))
    d = F.col("date")
    return ev.withColumns({
        "weight": F.lit(1.0) / F.col("same_day"),
        "baseline_overlap": F.coalesce(F.col("prev_date") >= F.date_sub(d, PRIMARY), F.lit(False)),
        "post_overlap": F.coalesce(F.col("next_date") <= F.date_add(d, PRIMARY), F.lit(False)),
        "pre_mature": F.date_sub(d, PRIMARY) >= F.col("data_min"),
        "post_mature": F.date_add(d, PRIMARY) <= F.col("data_max"),
    }).drop("data_min", "data_max")


_EV = f"""{BUY}, {GIFT},
ge0 AS (SELECT customer, date, program, count(*) AS gift_count FROM gift GROUP BY 1, 2, 3),
gb AS (SELECT customer, date, program, branch FROM (SELECT customer, date, program, branch, row_number() OVER (PARTITION BY customer, date, program ORDER BY count(*) DESC, branch) AS rn FROM gift GROUP BY 1, 2, 3, 4) WHERE rn = 1),
gd AS (SELECT customer, date, lag(date) OVER w AS prev_date, lead(date) OVER w AS next_date, count(*) OVER (PARTITION BY customer) AS n_dates FROM (SELECT DISTINCT customer, date FROM ge0) WINDOW w AS (PARTITION BY customer ORDER BY date)),
bb AS (SELECT min(date) AS data_min, max(date) AS data_max FROM buy),
ge AS (SELECT e.*, gb.branch, count(*) OVER (PARTITION BY e.customer, e.date) AS same_day, prev_date, next_date, n_dates, 1.0::DOUBLE / count(*) OVER (PARTITION BY e.customer, e.date) AS weight, coalesce(prev_date >= e.date - 28, FALSE) AS baseline_overlap, coalesce(next_date <= e.date + 28, FALSE) AS post_overlap, e.date - 28 >= data_min AS pre_mature, e.date + 28 <= data_max AS post_mature
 FROM ge0 e JOIN gb USING (customer, date, program) JOIN gd USING (customer, date), bb)"""


@query("q_gift_events", f"WITH {_EV}, n AS (SELECT *, 'GE' || lpad(CAST(row_number() OVER (ORDER BY customer, date, program) AS VARCHAR), 7, '0') AS event_code FROM ge) SELECT * FROM n")
def q_gift_events(spark, sf_dir):
    ev = numbered(gift_events(spark, sf_dir), ["customer", "date", "program"])
    return ev.withColumn("event_code", F.concat(F.lit("GE"), F.lpad((F.col("_place") + 1).cast("string"), 7, "0"))).drop("_place", "_all")


def gift_windows(spark, sf_dir) -> DataFrame:
    """Revenue around each event: one join, all windows as conditional sums."""
    ev = gift_events(spark, sf_dir)
    b = purchases(spark, sf_dir).select("customer", F.col("date").alias("buy_date"), "value", F.col("event_id").alias("buy_id"), F.col("sku"))
    far = max(WINDOWS)
    # purchases meet events in cells as long as the widest window, so a busy customer's years are not all compared
    cell = lambda day: F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / far)
    at = cell("date")
    asked = ev.select("customer", "date").distinct().withColumn("_cell", F.explode(F.array(at - 1, at, at + 1)))
    near = b.withColumn("_cell", cell("buy_date")).join(asked, ["customer", "_cell"]).drop("_cell").withColumn("after", F.datediff("buy_date", "date")).where((F.col("after") != 0) & F.col("after").between(-far, far))
    a = F.col("after")
    aggs = []
    for w in WINDOWS:
        inside = a.between(1, w)
        aggs += [total(F.when(inside, F.col("value"))).alias(f"revenue_{w}d"), F.count_distinct(F.when(inside, F.col("buy_id"))).alias(f"orders_{w}d"), F.count_distinct(F.when(inside, F.col("sku"))).alias(f"skus_{w}d"), total(F.when(a.between(-w, -1), F.col("value"))).alias(f"before_{w}d")]
    aggs += [F.min(F.when(a > 0, a)).alias("days_to_repeat"), F.min(F.when(a < 0, -a)).alias("days_since_purchase")]
    out = ev.join(near.groupBy("customer", "date").agg(*aggs), ["customer", "date"], "left")
    zero = [f"{n}_{w}d" for w in WINDOWS for n in ("revenue", "orders", "skus", "before")]
    out = out.fillna(0, subset=zero)
    up = F.col("revenue_28d") - F.col("before_28d")
    return out.withColumns({"uplift": up, "uplift_pct": ratio(up, F.col("before_28d")) * 100, "attributed": F.col("revenue_28d") * F.col("weight"), "response": response(F.col("revenue_28d"), F.col("before_28d"))})


def response(now: Column, before: Column) -> Column:
    return F.when(now == 0, "No Repeat After Gift").when(before == 0, "New or Reactivated").when(now > before, "Positive Impact").when(now == before, "Flat").otherwise("Repeat but Lower Value")


_WIN_AGG = ", ".join(f"CAST(coalesce(sum(CASE WHEN after BETWEEN 1 AND {w} THEN value END), 0) AS DOUBLE) AS revenue_{w}d, count(DISTINCT CASE WHEN after BETWEEN 1 AND {w} THEN event_id END) AS orders_{w}d, count(DISTINCT CASE WHEN after BETWEEN 1 AND {w} THEN sku END) AS skus_{w}d, CAST(coalesce(sum(CASE WHEN after BETWEEN -{w} AND -1 THEN value END), 0) AS DOUBLE) AS before_{w}d" for w in WINDOWS)
_ZERO = ", ".join(f"coalesce({n}_{w}d, 0) AS {n}_{w}d" for w in WINDOWS for n in ("revenue", "orders", "skus", "before"))
_GW = f"""{_EV},
nr AS (SELECT g.customer, g.date, b.value, b.event_id, b.sku, CAST(date_diff('day', g.date, b.date) AS INTEGER) AS after FROM (SELECT DISTINCT customer, date FROM ge) g JOIN buy b ON g.customer = b.customer WHERE b.date <> g.date AND b.date BETWEEN g.date - {max(WINDOWS)} AND g.date + {max(WINDOWS)}),
wa AS (SELECT customer, date, {_WIN_AGG}, min(CASE WHEN after > 0 THEN after END) AS days_to_repeat, min(CASE WHEN after < 0 THEN -after END) AS days_since_purchase FROM nr GROUP BY 1, 2),
gw0 AS (SELECT ge.*, {_ZERO}, days_to_repeat, days_since_purchase FROM ge LEFT JOIN wa USING (customer, date)),
gw AS (SELECT *, revenue_28d - before_28d AS uplift, (revenue_28d - before_28d) / nullif(before_28d, 0) * 100 AS uplift_pct, revenue_28d * weight AS attributed, CASE WHEN revenue_28d = 0 THEN 'No Repeat After Gift' WHEN before_28d = 0 THEN 'New or Reactivated' WHEN revenue_28d > before_28d THEN 'Positive Impact' WHEN revenue_28d = before_28d THEN 'Flat' ELSE 'Repeat but Lower Value' END AS response FROM gw0)"""


@query("q_gift_windows", f"WITH {_GW} SELECT * FROM gw")
def q_gift_windows(spark, sf_dir):
    return gift_windows(spark, sf_dir)


_D = "CAST(sum(CAST({0} AS DECIMAL(18,2))) AS DOUBLE)"


@query("q_gift_bundle", f"WITH {_GW} SELECT program, count(*) AS n_events, count(DISTINCT customer) AS n_customers, CAST(sum(gift_count) AS BIGINT) AS n_gifts, {_D.format('revenue_28d')} AS revenue, {_D.format('before_28d')} AS before, count(*) FILTER (revenue_28d > 0) AS n_repeat, CAST(count(*) FILTER (revenue_28d > 0) AS DOUBLE) / count(*) * 100 AS repeat_pct, CAST(sum(days_to_repeat) AS DOUBLE) / nullif(count(days_to_repeat), 0) AS mean_days, string_agg(DISTINCT response, ' + ' ORDER BY response) AS responses FROM gw GROUP BY 1")
def gift_bundle(spark, sf_dir):
    d = lambda c: total(F.col(c).cast("decimal(18,2)"))
    again = F.count(F.when(F.col("revenue_28d") > 0, 1))
    return gift_windows(spark, sf_dir).groupBy("program").agg(F.count("*").alias("n_events"), F.count_distinct("customer").alias("n_customers"), F.sum("gift_count").alias("n_gifts"), d("revenue_28d").alias("revenue"), d("before_28d").alias("before"), again.alias("n_repeat"), (ratio(again, F.count("*")) * 100).alias("repeat_pct"), ratio(F.sum("days_to_repeat"), F.count("days_to_repeat")).alias("mean_days"), F.array_join(F.array_sort(F.collect_set("response")), " + ").alias("responses"))


@query("q_gift_cohort", f"""WITH {_GW}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY date, program) AS rn FROM gw) WHERE rn = 1)
SELECT CAST(date_trunc('week', date) AS DATE) AS cohort, count(*) AS n_customers, {', '.join(f"count(*) FILTER (orders_{w}d > 0) AS repeat_{w}d, CAST(count(*) FILTER (orders_{w}d > 0) AS DOUBLE) / count(*) * 100 AS rate_{w}d" for w in WINDOWS)} FROM f GROUP BY 1""")
def gift_cohort(spark, sf_dir):
    """First gifts by week; the share of customers that bought again (never above 100)."""
    f = keep_first(gift_windows(spark, sf_dir), ["customer"], ["date", "program"])
    aggs = [F.count("*").alias("n_customers")]
    for w in WINDOWS:
        n = F.count(F.when(F.col(f"orders_{w}d") > 0, 1))
        aggs += [n.alias(f"repeat_{w}d"), (ratio(n, F.count("*")) * 100).alias(f"rate_{w}d")]
    return f.groupBy(F.date_trunc("week", "date").cast("date").alias("cohort")).agg(*aggs)


_MASKS = {"A all": "TRUE", "B mature": "pre_mature AND post_mature", "C no overlap": "NOT baseline_overlap AND NOT post_overlap", "D single programme": "same_day = 1", "E clean": "pre_mature AND post_mature AND NOT baseline_overlap AND NOT post_overlap AND same_day = 1"}


@query("q_uplift_kpi", f"WITH {_GW} " + " UNION ALL ".join(f"SELECT '{n}' AS view_name, count(*) FILTER ({m}) AS n_events, CAST(coalesce(sum(CAST(revenue_28d AS DECIMAL(18,2))) FILTER ({m}), 0) AS DOUBLE) AS revenue, CAST(coalesce(sum(CAST(before_28d AS DECIMAL(18,2))) FILTER ({m}), 0) AS DOUBLE) AS before, count(*) FILTER (({m}) AND uplift > 0) AS n_positive FROM gw" for n, m in _MASKS.items()))
def uplift_kpi(spark, sf_dir):
    """Sums under five masks, in one pass."""
    gw = gift_windows(spark, sf_dir)
    aggs = []
    for i, m in enumerate(_MASKS.values()):
        m = F.expr(m)
        aggs += [F.count(F.when(m, 1)).alias(f"n{i}"), total(F.when(m, F.col("revenue_28d").cast("decimal(18,2)"))).alias(f"r{i}"), total(F.when(m, F.col("before_28d").cast("decimal(18,2)"))).alias(f"b{i}"), F.count(F.when(m & (F.col("uplift") > 0), 1)).alias(f"p{i}")]
    rows = F.array(*(F.struct(F.lit(n).alias("view_name"), F.col(f"n{i}").alias("n_events"), F.col(f"r{i}").alias("revenue"), F.col(f"b{i}").alias("before"), F.col(f"p{i}").alias("n_positive")) for i, n in enumerate(_MASKS)))
    return gw.agg(*aggs).select(F.inline(rows))


@query("q_repeat_kpi", f"WITH {_GW} SELECT baseline_overlap, post_mature, {', '.join(f'count(*) FILTER (orders_{w}d > 0) AS repeat_{w}d' for w in WINDOWS)}, count(*) AS n_events FROM gw GROUP BY 1, 2")
def repeat_kpi(spark, sf_dir):
    return gift_windows(spark, sf_dir).groupBy("baseline_overlap", "post_mature").agg(*(F.count(F.when(F.col(f"orders_{w}d") > 0, 1)).alias(f"repeat_{w}d") for w in WINDOWS), F.count("*").alias("n_events"))


@query("q_negative_uplift", f"WITH {_GW} SELECT response, CASE WHEN NOT post_mature THEN 'window not over' WHEN baseline_overlap THEN 'baseline overlap' WHEN same_day > 1 THEN 'several programmes' ELSE 'lower value' END AS reason, count(*) AS n_events, {_D.format('uplift')} AS uplift FROM gw WHERE uplift < 0 GROUP BY 1, 2")
def negative_uplift(spark, sf_dir):
    reason = F.when(~F.col("post_mature"), "window not over").when(F.col("baseline_overlap"), "baseline overlap").when(F.col("same_day") > 1, "several programmes").otherwise("lower value")
    return gift_windows(spark, sf_dir).where("uplift < 0").groupBy("response", reason.alias("reason")).agg(F.count("*").alias("n_events"), total(F.col("uplift").cast("decimal(18,2)")).alias("uplift"))


def segment(r: Column, f: Column, m: Column) -> Column:
    return (
        F.when((r >= 4) & (f >= 4) & (m >= 4), "Champions").when((f >= 4) & (m >= 3), "Loyal Customers").when(m >= 4, "Big Spenders").when(r >= 4, "Recent Customers")
        .when((r >= 3) & (f >= 3), "Potential Loyalist").when((r <= 2) & (f >= 3), "At Risk").when((r == 1) & (f <= 2), "Lost Customers").otherwise("Need Attention")
    )


# Next action by segment, without and with a gift.
ACTIONS = {
    "Champions": ("Prioritas gift eksklusif", "Pertahankan — monitor value after gift"),
    "Loyal Customers": ("Gift untuk apresiasi loyalitas", "Monitor — sudah loyal & dapat gift"),
    "Lost Customers": ("Coba win-back campaign dengan gift", "Butuh pendekatan non-gift (gift tidak cukup)"),
    "At Risk": ("Coba gift untuk retensi segera", "Evaluasi — gift tidak mencegah churn"),
    "Potential Loyalist": ("Gift untuk konversi ke Loyal", "Monitor konversi ke Loyal"),
    "Big Spenders": ("Gift premium untuk high spender", "Monitor"),
    "Recent Customers": ("Nurture — terlalu baru untuk gift", "Nurture — terlalu baru untuk gift"),
    "Need Attention": ("Gift untuk reaktivasi", "Re-evaluasi efektivitas gift"),
}
WEAK = "Evaluasi program — gift belum efektif"


def next_action(seg: Column, gifted: Column, resp: Column) -> Column:
    out = F.lit("Monitor")
    for name, (without, with_) in ACTIONS.items():
        out = F.when(seg == name, F.when(gifted, with_).otherwise(without)).otherwise(out)
    return F.when(gifted & resp.isin("Negative Impact", "Repeat but Lower Value", "No Repeat After Gift"), WEAK).otherwise(out)


def rfm(spark, sf_dir) -> DataFrame:
    b = purchases(spark, sf_dir)
    base = b.groupBy("customer").agg(F.max("date").alias("last_date"), F.min("date").alias("first_date"), F.count_distinct("event_id").alias("frequency"), total(F.col("value")).alias("monetary"), F.count_distinct("sku").alias("n_skus"))
    day = b.agg(F.date_add(F.max("date"), 1).alias("snapshot"))  # one row
    base = base.join(F.broadcast(day)).withColumns({"recency": F.datediff("snapshot", "last_date"), "mean_order": ratio(F.col("monetary"), F.col("frequency"))}).drop("snapshot")
    for col, out, rev in (("recency", "r_score", True), ("frequency", "f_score", False), ("monetary", "m_score", False)):
        base = quartile(base, col, "customer", out, rev)
    last = keep_first(gift_windows(spark, sf_dir), ["customer"], [F.desc("date"), "program"]).select("customer", F.col("date").alias("gift_date"), "response", F.col("revenue_28d").alias("after_gift"))
    out = base.join(last, "customer", "left").withColumns({"segment": segment(F.col("r_score"), F.col("f_score"), F.col("m_score")), "gifted": F.col("gift_date").isNotNull(), "response": F.coalesce("response", F.lit("Tidak Dapat Gift")), "after_gift": F.coalesce("after_gift", F.lit(0.0))})
    return out.withColumn("action", next_action(F.col("segment"), F.col("gifted"), F.col("response")))


def _quart(col, rev=False):
    rn = f"(row_number() OVER (ORDER BY {col}, customer) - 1) * 4"
    n = "(count(*) OVER () - 1)"
    b = f"CASE WHEN {rn} <= {n} THEN 1 WHEN {rn} <= {n} * 2 THEN 2 WHEN {rn} <= {n} * 3 THEN 3 ELSE 4 END"
    return f"CASE WHEN min({col}) OVER () = max({col}) OVER () THEN 2 ELSE {'5 - (' + b + ')' if rev else b} END"


_ACTION = f"CASE WHEN gifted AND response IN ('Negative Impact', 'Repeat but Lower Value', 'No Repeat After Gift') THEN '{WEAK}' " + " ".join(f"WHEN segment = '{n}' THEN CASE WHEN gifted THEN '{b}' ELSE '{a}' END" for n, (a, b) in ACTIONS.items()) + " ELSE 'Monitor' END"
_RFM = f"""{_GW},
r0 AS (SELECT customer, max(date) AS last_date, min(date) AS first_date, count(DISTINCT event_id) AS frequency, CAST(sum(value) AS DOUBLE) AS monetary, count(DISTINCT sku) AS n_skus FROM buy GROUP BY 1),
r1 AS (SELECT *, CAST(date_diff('day', last_date, (SELECT max(date) + 1 FROM buy)) AS INTEGER) AS recency, monetary / nullif(CAST(frequency AS DOUBLE), 0) AS mean_order FROM r0),
r2 AS (SELECT *, {_quart('recency', True)} AS r_score, {_quart('frequency')} AS f_score, {_quart('monetary')} AS m_score FROM r1),
lg AS (SELECT customer, date AS gift_date, response, revenue_28d AS after_gift FROM (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY date DESC, program) AS rn FROM gw) WHERE rn = 1),
r3 AS (SELECT r2.*, gift_date, coalesce(response, 'Tidak Dapat Gift') AS response, coalesce(after_gift, 0) AS after_gift, gift_date IS NOT NULL AS gifted, CASE WHEN r_score >= 4 AND f_score >= 4 AND m_score >= 4 THEN 'Champions' WHEN f_score >= 4 AND m_score >= 3 THEN 'Loyal Customers' WHEN m_score >= 4 THEN 'Big Spenders' WHEN r_score >= 4 THEN 'Recent Customers' WHEN r_score >= 3 AND f_score >= 3 THEN 'Potential Loyalist' WHEN r_score <= 2 AND f_score >= 3 THEN 'At Risk' WHEN r_score = 1 AND f_score <= 2 THEN 'Lost Customers' ELSE 'Need Attention' END AS segment FROM r2 LEFT JOIN lg USING (customer)),
rfm AS (SELECT *, {_ACTION} AS action FROM r3)"""


@query("q_rfm", f"WITH {_RFM} SELECT * FROM rfm")
def q_rfm(spark, sf_dir):
    return rfm(spark, sf_dir)


@query("q_rfm_control", f"""WITH {_RFM}, g AS (SELECT segment, gifted, count(*) AS n, CAST(sum(CAST(monetary AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean_monetary, CAST(sum(frequency) AS DOUBLE) / count(*) AS mean_frequency FROM rfm GROUP BY 1, 2)
SELECT a.segment, a.n AS n_gifted, b.n AS n_control, a.mean_monetary AS monetary_gifted, b.mean_monetary AS monetary_control, a.mean_monetary - b.mean_monetary AS monetary_delta, a.mean_frequency - b.mean_frequency AS frequency_delta FROM g a JOIN g b ON a.segment = b.segment AND a.gifted AND NOT b.gifted""")
def rfm_control(spark, sf_dir):
    """Gifted against not gifted customers within a segment."""
    g = rfm(spark, sf_dir).groupBy("segment").agg(*(x for flag, name in ((True, "gifted"), (False, "control")) for x in (F.count(F.when(F.col("gifted") == flag, 1)).alias(f"n_{name}"), total(F.when(F.col("gifted") == flag, F.col("monetary").cast("decimal(18,2)"))).alias(f"s_{name}"), F.sum(F.when(F.col("gifted") == flag, F.col("frequency"))).alias(f"f_{name}"))))
    g = g.where("n_gifted > 0 and n_control > 0")
    a, b = ratio(F.col("s_gifted"), F.col("n_gifted")), ratio(F.col("s_control"), F.col("n_control"))
    return g.select("segment", "n_gifted", "n_control", a.alias("monetary_gifted"), b.alias("monetary_control"), (a - b).alias("monetary_delta"), (ratio(F.col("f_gifted"), F.col("n_gifted")) - ratio(F.col("f_control"), F.col("n_control"))).alias("frequency_delta"))


@query("q_check_cashback", f"WITH {BUY} SELECT customer, CAST(date_trunc('month', date) AS DATE) AS month, CAST(coalesce(sum(CASE WHEN value > 50 THEN value - 50 END), 0) AS DOUBLE) AS positive, CAST(abs(coalesce(sum(CASE WHEN value < 50 THEN value - 50 END), 0)) AS DOUBLE) AS negative, count(*) AS n FROM buy GROUP BY 1, 2")
def check_cashback(spark, sf_dir):
    """Positive and negative sums apart; the amounts are values above and below 50."""
    v = F.col("value") - F.lit(50).cast("decimal(4,2)")
    return purchases(spark, sf_dir).groupBy("customer", F.trunc("date", "month").alias("month")).agg(total(F.when(v > 0, v)).alias("positive"), F.abs(total(F.when(v < 0, v))).alias("negative"), F.count("*").alias("n"))


@query("q_value_segment", f"WITH {_GW}, q AS (SELECT quantile_cont(revenue_28d, 0.25) AS q25, quantile_cont(revenue_28d, 0.75) AS q75 FROM gw WHERE revenue_28d > 0) SELECT customer, date, program, revenue_28d, CASE WHEN revenue_28d = 0 THEN 'No Impact' WHEN revenue_28d >= q75 THEN 'High Impact' WHEN revenue_28d >= q25 THEN 'Mid Impact' ELSE 'Low Impact' END AS segment FROM gw, q")
def value_segment(spark, sf_dir):
    gw = gift_windows(spark, sf_dir)
    q = gw.where("revenue_28d > 0").agg(F.percentile("revenue_28d", F.lit(0.25)).alias("q25"), F.percentile("revenue_28d", F.lit(0.75)).alias("q75"))  # one row
    seg = F.when(F.col("revenue_28d") == 0, "No Impact").when(F.col("revenue_28d") >= F.col("q75"), "High Impact").when(F.col("revenue_28d") >= F.col("q25"), "Mid Impact").otherwise("Low Impact")
    return gw.join(F.broadcast(q)).select("customer", "date", "program", "revenue_28d", seg.alias("segment"))
