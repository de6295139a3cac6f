"""Daily sales: sums by period and dimension, sales against target, active outlets, incentive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.dates import month_key
from ..functions.numeric import mean_of_known, money, ratio, total
from ..operators.joins import full_outer, lookup
from ..operators.reshape import unpivot_months
from ..operators.stage import dealt
from ..operators.windows import change_pct
from ..sources.tables import invoice_lines, table
from .frames_sql import INV

YEAR = 1996
#: Outlet is active from this month value on, by division (scaled to the test tables' prices).
ACTIVE_FROM = {"PI": 125_000, "LM": 125_000, "ICI": 200_000, "EL": 250_000, "PP": 250_000}
QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def sums(df: DataFrame, *by) -> DataFrame:
    return df.groupBy(*by).agg(total(F.col("net")).alias("total_sales"), total(F.col("volume")).alias("total_volume"), total(F.col("qty")).alias("total_qty"), F.count("net").alias("n_lines"), F.count_distinct("invoice_code").alias("n_invoices"))


_SUMS = "CAST(sum(net) AS DOUBLE) AS total_sales, CAST(sum(volume) AS DOUBLE) AS total_volume, CAST(sum(qty) AS DOUBLE) AS total_qty, count(net) AS n_lines, count(DISTINCT invoice_code) AS n_invoices"


def _change(by, order):
    w = f"OVER ({'PARTITION BY ' + by if by else ''} ORDER BY {order})"
    return f"(total_sales - lag(total_sales) {w}) / nullif(lag(total_sales) {w}, 0) * 100"


@query("q_daily_sales", f"WITH {INV}, s AS (SELECT invoice_date, {_SUMS} FROM inv GROUP BY 1) SELECT *, {_change('', 'invoice_date')} AS change_pct FROM s")
def daily_sales(spark, sf_dir):
    return sums(invoice_lines(spark, sf_dir, by_invoice=True), "invoice_date").withColumn("change_pct", change_pct("total_sales", "invoice_date"))


@query("q_monthly_sales", f"WITH {INV}, s AS (SELECT CAST(date_trunc('month', invoice_date) AS DATE) AS month, strftime(invoice_date, '%m-%Y') AS month_key, {_SUMS} FROM inv GROUP BY 1, 2) SELECT *, {_change('', 'month')} AS change_pct FROM s")
def monthly_sales(spark, sf_dir):
    df = invoice_lines(spark, sf_dir, by_invoice=True).withColumns({"month": F.trunc("invoice_date", "month"), "month_key": month_key(F.col("invoice_date"))})
    return sums(df, "month", "month_key").withColumn("change_pct", change_pct("total_sales", "month"))


@query("q_branch_daily", f"WITH {INV}, s AS (SELECT branch, invoice_date, {_SUMS} FROM inv GROUP BY 1, 2) SELECT *, {_change('branch', 'invoice_date')} AS change_pct FROM s")
def branch_daily(spark, sf_dir):
    return sums(invoice_lines(spark, sf_dir, by_invoice=True), "branch", "invoice_date").withColumn("change_pct", change_pct("total_sales", "invoice_date", ["branch"]))


@query("q_salesman_daily", f"WITH {INV}, s AS (SELECT branch, salesman, invoice_date, {_SUMS} FROM inv GROUP BY 1, 2, 3) SELECT * FROM s")
def salesman_daily(spark, sf_dir):
    """Nearly as many groups as lines: an invoice's lines of a group become one row, and those rows are dealt out by the group."""
    by = ["branch", "salesman", "invoice_date"]
    lines = invoice_lines(spark, sf_dir, by_invoice=True)
    one = lines.groupBy(*by, "invoice_code").agg(*(F.sum(v).alias(v) for v in ("net", "volume", "qty")), F.count("net").alias("n_lines"))
    dealt_out = dealt(one, table(spark, sf_dir, "lineitem").count(), *by)
    return dealt_out.groupBy(*by).agg(*(total(F.col(v)).alias(n) for v, n in (("net", "total_sales"), ("volume", "total_volume"), ("qty", "total_qty"))), F.sum("n_lines").alias("n_lines"), F.count("invoice_code").alias("n_invoices"))


@query("q_sku_monthly", f"WITH {INV}, s AS (SELECT sku, CAST(date_trunc('month', invoice_date) AS DATE) AS month, {_SUMS} FROM inv GROUP BY 1, 2) SELECT *, {_change('sku', 'month')} AS change_pct FROM s")
def sku_monthly(spark, sf_dir):
    return sums(invoice_lines(spark, sf_dir, by_invoice=True).withColumn("month", F.trunc("invoice_date", "month")), "sku", "month").withColumn("change_pct", change_pct("total_sales", "month", ["sku"]))


def prepared(spark, sf_dir) -> DataFrame:
    """Invoice lines with looked-up product group, remapped category and channel, looked up on products and salesmen, not on lines."""
    ref = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("grp"), (F.col("p_size") % 6).cast("string")).alias("sku_group"))
    lines = invoice_lines(spark, sf_dir, by_invoice=True, products=lambda df: lookup(df, ref, "p_partkey"), salesmen=lambda df: df.withColumn("sales_category", rules.category_of(F.col("salesman"))))
    return lines.where(F.col("invoice_date").isNotNull()).withColumns({"channel": rules.channel_of(F.col("sales_category"), F.col("branch")), "in_scope": ~rules.excluded_actual(F.col("branch"))})


_N2 = r"TRY_CAST(regexp_extract(salesman, '(\d{2})$', 1) AS INTEGER)"
_CATEGORY = f"CASE WHEN {_N2} BETWEEN 60 AND 69 THEN 'Sales Cirebon' WHEN {_N2} BETWEEN 70 AND 79 THEN 'Sales Tasik' WHEN {_N2} BETWEEN 80 AND 89 THEN 'Sales Bogor' WHEN {_N2} BETWEEN 0 AND 19 THEN 'Sales Bandung' WHEN {_N2} BETWEEN 20 AND 29 THEN 'Sales PCK' ELSE 'Sales Other' END"


@query("q_invoice_prepared", f"WITH {INV} SELECT 'grp' || CAST(size6 AS VARCHAR) AS sku_group, sales_category, CASE WHEN branch = 'Project' THEN 'Project' WHEN branch = 'Agen' THEN 'Agen' ELSE 'Retail' END AS channel, branch NOT IN ('Project', 'Agen') AS in_scope, division, {_SUMS} FROM (SELECT inv.*, p_size % 6 AS size6, {_CATEGORY} AS sales_category FROM inv JOIN part ON product_code = p_partkey) GROUP BY 1, 2, 3, 4, 5")
def invoice_prepared(spark, sf_dir):
    return sums(prepared(spark, sf_dir), "sku_group", "sales_category", "channel", "in_scope", "division")


DIMS = ["branch", "salesman", "division", "sku"]


def wide_target(spark, sf_dir, value: str = "net") -> DataFrame:
    """Targets with a column for each month: last year's sales (or volume) times 1.05."""
    df = invoice_lines(spark, sf_dir).where(F.year("invoice_date") == YEAR - 1)
    cols = {f"Mo {m:02d}": F.sum(F.when(F.month("invoice_date") == m, F.col(value))) for m in range(1, 13)}
    return df.groupBy(*DIMS).agg(*((money(c * F.lit(1.05).cast("decimal(3,2)"))).alias(n) for n, c in cols.items()))


_TARGET = f"target AS (SELECT branch, salesman, division, sku, CAST(month(invoice_date) AS INTEGER) AS month_num, CAST(sum(net) * 1.05::DECIMAL(3,2) AS DECIMAL(18,2)) AS target FROM inv WHERE year(invoice_date) = {YEAR - 1} GROUP BY 1, 2, 3, 4, 5 HAVING CAST(sum(net) * 1.05::DECIMAL(3,2) AS DECIMAL(18,2)) <> 0)"


@query("q_target_unpivot", f"WITH {INV}, {_TARGET} SELECT branch, salesman, division, sku, month_num, CAST(target AS DOUBLE) AS target FROM target")
def target_unpivot(spark, sf_dir):
    return unpivot_months(wide_target(spark, sf_dir), DIMS).withColumn("target", F.col("target").cast("double"))


def sales_vs_target(spark, sf_dir) -> DataFrame:
    actual = invoice_lines(spark, sf_dir).where((F.year("invoice_date") == YEAR) & ~rules.excluded_actual(F.col("branch"))).groupBy(*DIMS, F.month("invoice_date").alias("month_num")).agg(F.sum("net").alias("net"), F.sum("volume").alias("volume"))
    target = unpivot_months(wide_target(spark, sf_dir), DIMS).where(~rules.excluded_target(F.col("branch")))
    both = full_outer(actual, target, [*DIMS, "month_num"])
    zero = lambda c: F.coalesce(c, F.lit(0).cast("decimal(18,2)")).cast("double")
    both = both.select(*DIMS, "month_num", zero("net").alias("net"), zero("volume").alias("volume"), zero("target").alias("target"))
    unit = F.when(F.col("division") == "ICI", "Volume").otherwise("Value")
    done = F.when(F.col("division") == "ICI", F.col("volume")).otherwise(F.col("net"))
    return both.withColumns({"unit": unit, "achieved": done}).withColumns({"gap": F.col("achieved") - F.col("target"), "achievement": ratio(F.col("achieved"), F.col("target"))})


_SVT = f"""act AS (SELECT branch, salesman, division, sku, CAST(month(invoice_date) AS INTEGER) AS month_num, sum(net) AS net, sum(volume) AS volume FROM inv WHERE year(invoice_date) = {YEAR} AND branch NOT IN ('Project', 'Agen') GROUP BY 1, 2, 3, 4, 5),
tgt AS (SELECT * FROM target WHERE branch <> 'Project'),
svt0 AS (SELECT coalesce(a.branch, t.branch) AS branch, coalesce(a.salesman, t.salesman) AS salesman, coalesce(a.division, t.division) AS division, coalesce(a.sku, t.sku) AS sku, coalesce(a.month_num, t.month_num) AS month_num, CAST(coalesce(a.net, 0) AS DOUBLE) AS net, CAST(coalesce(a.volume, 0) AS DOUBLE) AS volume, CAST(coalesce(t.target, 0) AS DOUBLE) AS target
 FROM act a FULL JOIN tgt t ON a.branch = t.branch AND a.salesman = t.salesman AND a.division = t.division AND a.sku = t.sku AND a.month_num = t.month_num),
svt AS (SELECT *, CASE WHEN division = 'ICI' THEN 'Volume' ELSE 'Value' END AS unit, CASE WHEN division = 'ICI' THEN volume ELSE net END AS achieved FROM svt0)"""


@query("q_sales_vs_target", f"WITH {INV}, {_TARGET}, {_SVT} SELECT *, achieved - target AS gap, achieved / nullif(target, 0) AS achievement FROM svt")
def q_sales_vs_target(spark, sf_dir):
    return sales_vs_target(spark, sf_dir)


def active_outlets(spark, sf_dir) -> DataFrame:
    """Active customers by salesman and month: customer sums first, then a threshold of the division."""
    df = invoice_lines(spark, sf_dir).where((F.year("invoice_date") == YEAR) & ~rules.excluded_target(F.col("branch")))
    by_customer = df.groupBy("division", "salesman", F.month("invoice_date").alias("month_num"), "customer_name").agg(F.sum("net").alias("net"))
    flag = F.lit(0)
    for d, least in ACTIVE_FROM.items():
        flag = F.when((F.col("division") == d) & (F.col("net") >= least), 1).otherwise(flag)
    return by_customer.withColumn("flag", flag).groupBy("division", "salesman", "month_num").agg(F.sum("flag").alias("total_ao"), F.count("*").alias("n_customers"))


_AO = f"""cm AS (SELECT division, salesman, CAST(month(invoice_date) AS INTEGER) AS month_num, customer_name, sum(net) AS net FROM inv WHERE year(invoice_date) = {YEAR} AND branch <> 'Project' GROUP BY 1, 2, 3, 4),
ao AS (SELECT division, salesman, month_num, CAST(sum(CASE WHEN division IN ('PI', 'LM') AND net >= 125000 OR division = 'ICI' AND net >= 200000 OR division IN ('EL', 'PP') AND net >= 250000 THEN 1 ELSE 0 END) AS BIGINT) AS total_ao, count(*) AS n_customers FROM cm GROUP BY 1, 2, 3)"""


@query("q_ao_flag", f"WITH {INV}, {_AO} SELECT * FROM ao")
def q_ao_flag(spark, sf_dir):
    return active_outlets(spark, sf_dir)


@query("q_incentive", f"""WITH {INV}, {_TARGET}, {_SVT}, {_AO},
s AS (SELECT salesman, month_num, CAST(sum(CAST(achieved AS DECIMAL(18,2))) AS DOUBLE) AS achieved, CAST(sum(CAST(target AS DECIMAL(18,2))) AS DOUBLE) AS target, count(DISTINCT CASE WHEN target > 0 THEN sku END) AS n_focus, CAST(sum(CASE WHEN target > 0 AND achieved / target >= 0.7 THEN 1 ELSE 0 END) AS BIGINT) AS n_reached FROM svt GROUP BY 1, 2),
a AS (SELECT salesman, month_num, CAST(sum(total_ao) AS BIGINT) AS total_ao, CAST(sum(n_customers) AS BIGINT) AS n_customers FROM ao GROUP BY 1, 2),
j AS (SELECT s.*, coalesce(total_ao, 0) AS total_ao, coalesce(n_customers, 0) AS n_customers, achieved / nullif(target, 0) AS pct_sales, CAST(n_reached AS DOUBLE) / nullif(CAST(n_focus AS DOUBLE), 0) AS pct_focus, CAST(total_ao AS DOUBLE) / nullif(CAST(n_customers AS DOUBLE), 0) AS pct_ao FROM s LEFT JOIN a USING (salesman, month_num))
SELECT *, (0.0::DOUBLE + coalesce(pct_sales, 0) + coalesce(pct_focus, 0) + coalesce(pct_ao, 0)) / nullif(CAST((pct_sales IS NOT NULL)::INT + (pct_focus IS NOT NULL)::INT + (pct_ao IS NOT NULL)::INT AS DOUBLE), 0) AS overall FROM j""")
def incentive(spark, sf_dir):
    svt = sales_vs_target(spark, sf_dir)
    reached = (F.col("target") > 0) & (F.try_divide("achieved", "target") >= 0.7)
    s = svt.groupBy("salesman", "month_num").agg(total(money(F.col("achieved"))).alias("achieved"), total(money(F.col("target"))).alias("target"), F.count_distinct(F.when(F.col("target") > 0, F.col("sku"))).alias("n_focus"), F.sum(F.when(reached, 1).otherwise(0)).alias("n_reached"))
    ao = active_outlets(spark, sf_dir).groupBy("salesman", "month_num").agg(F.sum("total_ao").alias("total_ao"), F.sum("n_customers").alias("n_customers"))
    out = s.join(ao, ["salesman", "month_num"], "left")
    out = out.withColumns({"pct_sales": ratio(F.col("achieved"), F.col("target")), "pct_focus": ratio(F.col("n_reached"), F.col("n_focus")), "pct_ao": ratio(F.col("total_ao"), F.col("n_customers"))})
    out = out.withColumn("overall", mean_of_known(F.col("pct_sales"), F.col("pct_focus"), F.col("pct_ao")))
    return out.withColumns({"total_ao": F.coalesce("total_ao", F.lit(0)), "n_customers": F.coalesce("n_customers", F.lit(0))})
