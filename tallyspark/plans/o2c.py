"""Order to cash: one row an order with its packing and invoices, classified, scored and summarised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import month_label
from ..functions.numeric import clip, ratio, total
from ..operators.joins import orphans
from ..operators.windows import average_ranks
from ..sources.tables import invoices, packing_slips, sales_orders
from .frames_sql import BILL, PACK, SO

QUERIES, SQL = {}, {}
TOLERANCE = 0.98
# Days that a stage may take.
SLA = {"Quotation / Draft": 7, "SO On Hold / Approval": 2, "SO Pending Packing": 3, "Partial Packing": 3, "Invoice Exists, Packing Slip Missing": 1, "Packed Not Invoiced": 1, "Partially Invoiced": 1, "Invoiced Waiting Payment": 999, "Invoice Past Due": 1, "Paid / Completed": 0, "Excluded / Closed": 0, "Needs Review": 1}
# Where a stage is stuck.
BOTTLENECK = {"Quotation / Draft": "Quotation Follow Up", "SO On Hold / Approval": "Approval / Credit Control", "SO Pending Packing": "SO to Packing", "Partial Packing": "SO to Packing", "Invoice Exists, Packing Slip Missing": "Data Mapping / Missing Packing Slip", "Packed Not Invoiced": "Packing to Invoice", "Partially Invoiced": "Packing to Invoice", "Invoice Past Due": "Invoice to Payment", "Invoiced Waiting Payment": "Invoice to Payment", "Paid / Completed": "Completed", "Excluded / Closed": "Closed"}
DONE = ("Paid / Completed", "Excluded / Closed")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def chain(c: Column, values: dict, default) -> Column:
    out = F.lit(default)
    for k, v in reversed(values.items()):
        out = F.when(c == k, v).otherwise(out)
    return out


def sql_chain(c: str, values: dict, default) -> str:
    lit = lambda v: str(v) if isinstance(v, int) else f"'{v}'"
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {lit(v)}" for k, v in values.items()) + f" ELSE {lit(default)} END"


def active_orders(spark, sf_dir) -> DataFrame:
    s = F.upper("so_status")
    return sales_orders(spark, sf_dir).where(~(s.contains("CANCEL") | s.contains("CLOS") | s.contains("DECLIN")))


def flow_base(spark, sf_dir) -> DataFrame:
    """Orders left-joined to their packing and invoice sums, with the as-of date of the data.  Excluded orders
    (cancelled, closed, declined) are left out, so their packing and invoices never join."""
    active = active_orders(spark, sf_dir)
    keys = active.select("so_code")
    pack = packing_slips(spark, sf_dir).join(keys, "so_code", "left_semi").groupBy("so_code").agg(F.min("printed_date").alias("first_packing"), F.max("printed_date").alias("last_packing"), total(F.col("net")).alias("packing_value"))
    bill = invoices(spark, sf_dir).join(keys, "so_code", "left_semi").groupBy("so_code").agg(F.min("invoice_date").alias("first_invoice"), F.max("invoice_date").alias("last_invoice"), F.min(F.when(F.col("paid_date").isNull(), F.col("due_date"))).alias("next_due"), F.min("paid_date").alias("first_paid"), F.max("paid_date").alias("last_paid"), total(F.col("net")).alias("invoice_value"), total(F.col("paid")).alias("paid_value"), F.min("invoice_status").alias("invoice_status"))
    df = active.join(pack, "so_code", "left").join(bill, "so_code", "left").fillna(0.0, subset=["packing_value", "invoice_value", "paid_value"]).withColumn("so_value", F.col("so_value").cast("double"))
    day = df.agg(F.greatest(F.max("order_date"), F.max("last_packing"), F.max("last_invoice"), F.max("last_paid")).alias("as_of"))  # one row
    return df.join(F.broadcast(day))


def classified(df: DataFrame) -> DataFrame:
    c = F.col
    s, inv = F.upper("so_status"), F.upper(F.coalesce("invoice_status", F.lit("")))
    df = df.withColumns({"is_draft": s.contains("DRAFT"), "is_onhold": s.contains("HOLD"), "is_done": s.contains("DONE") & inv.contains("DONE"), "has_packing": F.abs("packing_value") > 0, "has_invoice": F.abs("invoice_value") > 0})
    zero = F.lit(0.0)
    df = df.withColumns({"quotation_value": F.when(c("is_draft"), c("so_value")).otherwise(zero), "order_value": F.when(c("is_draft"), zero).otherwise(c("so_value"))})
    df = df.withColumns({
        "is_packed": F.when(c("order_value") > 0, c("packing_value") >= c("order_value") * TOLERANCE).otherwise(False),
        "is_invoiced": F.when(c("has_invoice") & c("is_done"), True).when(c("packing_value") > 0, c("invoice_value") >= c("packing_value") * TOLERANCE).otherwise(False),
        "is_paid": F.when(c("invoice_value") > 0, c("paid_value") >= c("invoice_value") * TOLERANCE).otherwise(False),
        "is_late": F.coalesce(c("next_due") < c("as_of"), F.lit(False)),
    })
    payment = F.when(c("is_paid"), "Paid / Completed").when(c("is_late"), "Invoice Past Due").otherwise("Invoiced Waiting Payment")
    stage = (
        F.when(c("is_draft"), "Quotation / Draft")
        .when(c("is_onhold"), "SO On Hold / Approval")
        .when(c("has_invoice") & c("is_done"), payment)
        .when(~c("has_packing"), F.when(c("has_invoice"), "Invoice Exists, Packing Slip Missing").otherwise("SO Pending Packing"))
        .when(~c("is_packed"), "Partial Packing")
        .when(~c("has_invoice"), "Packed Not Invoiced")
        .when(~c("is_invoiced"), "Partially Invoiced")
        .otherwise(payment)
    )
    return df.withColumn("stage", stage).withColumn("bottleneck", chain(c("stage"), BOTTLENECK, "Needs Review"))


def customer_ranks(spark, sf_dir) -> DataFrame:
    """(customer_code, customer_value, importance): value of a customer's live orders and its mean rank among all
    such orders, in percent.  Reads the orders alone."""
    so = active_orders(spark, sf_dir)
    value = F.when(F.upper("so_status").contains("DRAFT"), 0.0).otherwise(F.col("so_value").cast("double"))
    per = so.groupBy("customer_code").agg(F.sum(value.cast("decimal(18,2)")).cast("double").alias("customer_value"), F.count("*").alias("n"))
    ranks = average_ranks(per.groupBy("customer_value").agg(F.sum("n").alias("n")), "customer_value", "n")
    return per.join(ranks, "customer_value").select("customer_code", "customer_value", (F.col("rank") / F.col("n_all") * 100).alias("importance"))


def scored(df: DataFrame, ranks: DataFrame) -> DataFrame:
    """Stuck value, age, risk and the parts of the priority; ``ranks`` is a row a customer."""
    c = F.col
    gap = lambda a, b: clip(c(a) - c(b), low=0.0)
    st = c("stage")
    stuck = (
        F.when(st == "Quotation / Draft", c("quotation_value")).when(st == "SO On Hold / Approval", c("order_value"))
        .when(st.isin("SO Pending Packing", "Partial Packing", "Invoice Exists, Packing Slip Missing"), gap("order_value", "packing_value"))
        .when(st.isin("Packed Not Invoiced", "Partially Invoiced"), gap("packing_value", "invoice_value"))
        .when(st.isin("Invoice Past Due", "Invoiced Waiting Payment"), gap("invoice_value", "paid_value")).otherwise(0.0)
    )
    start = (
        F.when(st.isin("Quotation / Draft", "SO On Hold / Approval", "SO Pending Packing", "Partial Packing"), c("order_date"))
        .when(st == "Invoice Exists, Packing Slip Missing", F.coalesce("first_invoice", "order_date"))
        .when(st.isin("Packed Not Invoiced", "Partially Invoiced"), F.coalesce("last_packing", "first_packing"))
        .when(st == "Invoice Past Due", F.coalesce("next_due", "last_invoice"))
        .when(st == "Invoiced Waiting Payment", F.coalesce("last_invoice", "first_invoice"))
        .when(st == "Paid / Completed", F.coalesce("last_paid", "last_invoice"))
    )
    df = df.withColumns({"stuck_value": clip(stuck, low=0.0), "stage_start": start})
    done = st.isin(*DONE)
    df = df.withColumn("aging_days", F.when(done, 0).otherwise(clip(F.coalesce(F.datediff("as_of", "stage_start"), F.lit(0)), low=0)))
    df = df.withColumns({"order_to_packing": F.datediff("first_packing", "order_date"), "order_to_invoice": F.datediff("first_invoice", "order_date"), "invoice_to_paid": F.datediff("first_paid", "first_invoice"), "sla_days": chain(st, SLA, 1)})
    risk = (
        F.when(done, "Closed / Completed").when(st == "Invoice Past Due", "Critical")
        .when((st == "Invoiced Waiting Payment") & (c("next_due") >= c("as_of")), "On Time").when(st == "Invoiced Waiting Payment", "Warning")
        .when(c("aging_days") <= c("sla_days"), "On Time").when(c("aging_days") <= c("sla_days") * 2, "Warning").otherwise("Critical")
    )
    most = df.agg(F.max("stuck_value").alias("most_stuck"))  # one row
    df = df.withColumn("risk", risk).join(F.broadcast(most)).join(ranks, "customer_code", "left")
    df = df.withColumns({
        "value_score": F.when(c("most_stuck") > 0, F.log1p("stuck_value") / F.log1p("most_stuck") * 100).otherwise(0.0),
        "aging_score": F.coalesce(F.least(F.try_divide(c("aging_days").cast("double"), c("sla_days").cast("double")) * 50, F.when(c("sla_days") == 0, None).otherwise(F.lit(100.0))), F.lit(0.0)),
    })
    return df


def flow(spark, sf_dir) -> DataFrame:
    df = scored(classified(flow_base(spark, sf_dir)), customer_ranks(spark, sf_dir))
    score = F.floor((0.5 * F.col("value_score") + 0.3 * F.col("aging_score") + 0.2 * F.col("importance")) * 1000 + 0.5) / 1000
    return df.withColumn("priority", F.when(F.col("stage").isin(*DONE), 0.0).otherwise(score)).drop("value_score", "most_stuck")


_PAY = "CASE WHEN is_paid THEN 'Paid / Completed' WHEN is_late THEN 'Invoice Past Due' ELSE 'Invoiced Waiting Payment' END"
FLOW = f"""{SO}, {PACK}, {BILL},
aso AS (SELECT * FROM so WHERE so_status NOT IN ('Cancelled', 'Closed')),
pk AS (SELECT so_code, min(printed_date) AS first_packing, max(printed_date) AS last_packing, CAST(sum(net) AS DOUBLE) AS packing_value FROM pack WHERE so_code IN (SELECT so_code FROM aso) GROUP BY 1),
bl AS (SELECT so_code, min(invoice_date) AS first_invoice, max(invoice_date) AS last_invoice, min(CASE WHEN paid_date IS NULL THEN due_date END) AS next_due, min(paid_date) AS first_paid, max(paid_date) AS last_paid, CAST(sum(net) AS DOUBLE) AS invoice_value, CAST(sum(paid) AS DOUBLE) AS paid_value, min(invoice_status) AS invoice_status FROM bill WHERE so_code IN (SELECT so_code FROM aso) GROUP BY 1),
f0 AS (SELECT aso.* REPLACE (CAST(so_value AS DOUBLE) AS so_value), pk.* EXCLUDE (so_code, packing_value), bl.* EXCLUDE (so_code, invoice_value, paid_value), coalesce(packing_value, 0) AS packing_value, coalesce(invoice_value, 0) AS invoice_value, coalesce(paid_value, 0) AS paid_value FROM aso LEFT JOIN pk USING (so_code) LEFT JOIN bl USING (so_code)),
f1 AS (SELECT *, greatest(max(order_date) OVER (), max(last_packing) OVER (), max(last_invoice) OVER (), max(last_paid) OVER ()) AS as_of, contains(upper(so_status), 'DRAFT') AS is_draft, contains(upper(so_status), 'HOLD') AS is_onhold, contains(upper(so_status), 'DONE') AND coalesce(invoice_status, '') = 'Done' AS is_done, packing_value <> 0 AS has_packing, invoice_value <> 0 AS has_invoice FROM f0),
f2 AS (SELECT *, CASE WHEN is_draft THEN so_value ELSE 0.0 END AS quotation_value, CASE WHEN is_draft THEN 0.0 ELSE so_value END AS order_value FROM f1),
f3 AS (SELECT *, CASE WHEN order_value > 0 THEN packing_value >= order_value * 0.98::DOUBLE ELSE FALSE END AS is_packed, CASE WHEN has_invoice AND is_done THEN TRUE WHEN packing_value > 0 THEN invoice_value >= packing_value * 0.98::DOUBLE ELSE FALSE END AS is_invoiced, CASE WHEN invoice_value > 0 THEN paid_value >= invoice_value * 0.98::DOUBLE ELSE FALSE END AS is_paid, coalesce(next_due < as_of, FALSE) AS is_late FROM f2),
f4 AS (SELECT *, CASE WHEN is_draft THEN 'Quotation / Draft' WHEN is_onhold THEN 'SO On Hold / Approval' WHEN has_invoice AND is_done THEN {_PAY} WHEN NOT has_packing AND has_invoice THEN 'Invoice Exists, Packing Slip Missing' WHEN NOT has_packing THEN 'SO Pending Packing' WHEN NOT is_packed THEN 'Partial Packing' WHEN NOT has_invoice THEN 'Packed Not Invoiced' WHEN NOT is_invoiced THEN 'Partially Invoiced' ELSE {_PAY} END AS stage FROM f3),
f5 AS (SELECT *, {sql_chain('stage', BOTTLENECK, 'Needs Review')} AS bottleneck, {sql_chain('stage', SLA, 1)} AS sla_days,
 CASE WHEN stage = 'Quotation / Draft' THEN quotation_value WHEN stage = 'SO On Hold / Approval' THEN greatest(order_value, 0) WHEN stage IN ('SO Pending Packing', 'Partial Packing', 'Invoice Exists, Packing Slip Missing') THEN greatest(order_value - packing_value, 0) WHEN stage IN ('Packed Not Invoiced', 'Partially Invoiced') THEN greatest(packing_value - invoice_value, 0) WHEN stage IN ('Invoice Past Due', 'Invoiced Waiting Payment') THEN greatest(invoice_value - paid_value, 0) ELSE 0 END AS stuck_value,
 CASE WHEN stage IN ('Quotation / Draft', 'SO On Hold / Approval', 'SO Pending Packing', 'Partial Packing') THEN order_date WHEN stage = 'Invoice Exists, Packing Slip Missing' THEN coalesce(first_invoice, order_date) WHEN stage IN ('Packed Not Invoiced', 'Partially Invoiced') THEN coalesce(last_packing, first_packing) WHEN stage = 'Invoice Past Due' THEN coalesce(next_due, last_invoice) WHEN stage = 'Invoiced Waiting Payment' THEN coalesce(last_invoice, first_invoice) WHEN stage = 'Paid / Completed' THEN coalesce(last_paid, last_invoice) END AS stage_start FROM f4),
f6 AS (SELECT *, CAST(CASE WHEN stage = 'Paid / Completed' THEN 0 ELSE greatest(coalesce(date_diff('day', stage_start, as_of), 0), 0) END AS INTEGER) AS aging_days, CAST(date_diff('day', order_date, first_packing) AS INTEGER) AS order_to_packing, CAST(date_diff('day', order_date, first_invoice) AS INTEGER) AS order_to_invoice, CAST(date_diff('day', first_invoice, first_paid) AS INTEGER) AS invoice_to_paid FROM f5),
f7 AS (SELECT *, CASE WHEN stage = 'Paid / Completed' THEN 'Closed / Completed' WHEN stage = 'Invoice Past Due' THEN 'Critical' WHEN stage = 'Invoiced Waiting Payment' AND next_due >= as_of THEN 'On Time' WHEN stage = 'Invoiced Waiting Payment' THEN 'Warning' WHEN aging_days <= sla_days THEN 'On Time' WHEN aging_days <= sla_days * 2 THEN 'Warning' ELSE 'Critical' END AS risk,
 CAST(sum(CAST(order_value AS DECIMAL(18,2))) OVER (PARTITION BY customer_code) AS DOUBLE) AS customer_value, CASE WHEN max(stuck_value) OVER () > 0 THEN ln(1 + stuck_value) / ln(1 + max(stuck_value) OVER ()) * 100 ELSE 0 END AS value_score,
 coalesce(CASE WHEN sla_days = 0 THEN NULL ELSE least(CAST(aging_days AS DOUBLE) / sla_days * 50, 100) END, 0) AS aging_score FROM f6),
f8 AS (SELECT *, (rank() OVER (ORDER BY customer_value) + (count(*) OVER (PARTITION BY customer_value) - 1) / 2.0::DOUBLE) / count(*) OVER () * 100 AS importance FROM f7),
flow AS (SELECT * EXCLUDE (value_score), CASE WHEN stage = 'Paid / Completed' THEN 0 ELSE floor((0.5::DOUBLE * value_score + 0.3::DOUBLE * aging_score + 0.2::DOUBLE * importance) * 1000 + 0.5::DOUBLE) / 1000 END AS priority FROM f8)"""
_COLS = ["so_code", "customer_code", "division", "salesman", "order_date", "so_status", "so_value", "first_packing", "last_packing", "packing_value", "first_invoice", "last_invoice", "next_due", "invoice_value", "paid_value", "stage", "bottleneck", "stuck_value", "stage_start", "aging_days", "order_to_packing", "order_to_invoice", "invoice_to_paid", "sla_days", "risk", "customer_value", "aging_score", "importance"]


@query("q_o2c_flow", f"WITH {FLOW} SELECT {', '.join(_COLS)}, priority FROM flow")
def o2c_flow(spark, sf_dir):
    return flow(spark, sf_dir).select(*_COLS, "priority")


@query("q_o2c_stage", f"WITH {FLOW} SELECT stage, risk, count(*) AS n_orders, CAST(sum(CAST(so_value AS DECIMAL(18,2))) AS DOUBLE) AS so_value, CAST(sum(CAST(stuck_value AS DECIMAL(18,2))) AS DOUBLE) AS stuck_value, max(aging_days) AS max_aging, CAST(sum(aging_days) AS DOUBLE) / count(*) AS mean_aging FROM flow GROUP BY 1, 2")
def o2c_stage(spark, sf_dir):
    return by_group(flow(spark, sf_dir), "stage", "risk")


def by_group(df: DataFrame, *by, more=()) -> DataFrame:
    m = lambda c: total(F.col(c).cast("decimal(18,2)")).alias(c)
    return df.groupBy(*by).agg(F.count("*").alias("n_orders"), m("so_value"), m("stuck_value"), F.max("aging_days").alias("max_aging"), ratio(F.sum("aging_days"), F.count("*")).alias("mean_aging"), *more)


_GROUP = "count(*) AS n_orders, CAST(sum(CAST(so_value AS DECIMAL(18,2))) AS DOUBLE) AS so_value, CAST(sum(CAST(stuck_value AS DECIMAL(18,2))) AS DOUBLE) AS stuck_value, max(aging_days) AS max_aging, CAST(sum(aging_days) AS DOUBLE) / count(*) AS mean_aging"


@query("q_o2c_bottleneck", f"WITH {FLOW} SELECT bottleneck, {_GROUP}, count(*) FILTER (risk = 'Critical') AS n_critical FROM flow GROUP BY 1")
def o2c_bottleneck(spark, sf_dir):
    return by_group(flow(spark, sf_dir), "bottleneck", more=(F.count_if(F.col("risk") == "Critical").alias("n_critical"),))


@query("q_o2c_monthly", f"WITH {FLOW} SELECT strftime(order_date, '%Y-%m') AS month, {_GROUP} FROM flow GROUP BY 1")
def o2c_monthly(spark, sf_dir):
    return by_group(flow(spark, sf_dir).withColumn("month", month_label(F.col("order_date"))), "month")


@query("q_o2c_salesman", f"WITH {FLOW} SELECT salesman, {_GROUP} FROM flow GROUP BY 1")
def o2c_salesman(spark, sf_dir):
    return by_group(flow(spark, sf_dir), "salesman")


@query("q_o2c_customer", f"WITH {FLOW} SELECT customer_code, {_GROUP} FROM flow GROUP BY 1")
def o2c_customer(spark, sf_dir):
    return by_group(flow(spark, sf_dir), "customer_code")


_M = "CAST(sum(CAST({0} AS DECIMAL(18,2))) AS DOUBLE)"


@query("q_o2c_funnel", f"""WITH {FLOW}, a AS (SELECT {_M.format('quotation_value')} AS q, {_M.format('order_value')} AS o, {_M.format('packing_value')} AS p, {_M.format('invoice_value')} AS i, {_M.format('paid_value')} AS c, count(*) FILTER (is_draft) AS nq, count(*) FILTER (NOT is_draft) AS no, count(*) FILTER (has_packing) AS np, count(*) FILTER (has_invoice) AS ni, count(*) FILTER (is_paid) AS nc FROM flow)
SELECT * FROM (SELECT 'quotation' AS step, q AS value, nq AS n_orders FROM a UNION ALL SELECT 'order', o, no FROM a UNION ALL SELECT 'packing', p, np FROM a UNION ALL SELECT 'invoice', i, ni FROM a UNION ALL SELECT 'paid', c, nc FROM a)""")
def o2c_funnel(spark, sf_dir):
    """Sums and orders of each step, from one aggregate."""
    steps = {"quotation": ("quotation_value", "is_draft"), "order": ("order_value", None), "packing": ("packing_value", "has_packing"), "invoice": ("invoice_value", "has_invoice"), "paid": ("paid_value", "is_paid")}
    df = classified(flow_base(spark, sf_dir))
    aggs = []
    for name, (value, flag) in steps.items():
        test = F.col(flag) if flag else ~F.col("is_draft")
        aggs += [total(F.col(value).cast("decimal(18,2)")).alias(f"v_{name}"), F.count(F.when(test, 1)).alias(f"n_{name}")]
    one = df.agg(*aggs)
    rows = F.array(*(F.struct(F.lit(n).alias("step"), F.col(f"v_{n}").alias("value"), F.col(f"n_{n}").alias("n_orders")) for n in steps))
    return one.select(F.inline(rows))


@query("q_o2c_actions", f"WITH {FLOW} SELECT so_code, stage, risk, priority, stuck_value, aging_days FROM (SELECT *, CASE risk WHEN 'Critical' THEN 1 WHEN 'Warning' THEN 2 WHEN 'On Time' THEN 3 ELSE 4 END AS r FROM flow WHERE stage <> 'Paid / Completed') ORDER BY r, CAST(stuck_value AS DECIMAL(18,2)) DESC, aging_days DESC, so_code LIMIT 500")
def o2c_actions(spark, sf_dir):
    """The 500 orders to act on first (a report's length): by risk, stuck value, age."""
    df = flow(spark, sf_dir).where(~F.col("stage").isin(*DONE))
    rank = chain(F.col("risk"), {"Critical": 1, "Warning": 2, "On Time": 3}, 4)
    return df.orderBy(rank, F.desc(F.col("stuck_value").cast("decimal(18,2)")), F.desc("aging_days"), "so_code").limit(500).select("so_code", "stage", "risk", "priority", "stuck_value", "aging_days")


@query("q_o2c_quality", f"""WITH {FLOW}, ex AS (SELECT so_code FROM so WHERE so_status IN ('Cancelled', 'Closed'))
SELECT * FROM (SELECT 'packing_without_order' AS check_name, count(*) AS n FROM pack WHERE so_code NOT IN (SELECT so_code FROM flow) AND so_code NOT IN (SELECT so_code FROM ex)
UNION ALL SELECT 'invoice_without_order', count(*) FROM bill WHERE so_code NOT IN (SELECT so_code FROM flow) AND so_code NOT IN (SELECT so_code FROM ex)
UNION ALL SELECT 'excluded_orders', count(*) FROM ex UNION ALL SELECT 'negative_value', count(*) FILTER (so_value < 0) FROM flow
UNION ALL SELECT 'invoice_over_packing', count(*) FILTER (invoice_value > packing_value AND has_packing) FROM flow UNION ALL SELECT 'paid_over_invoice', count(*) FILTER (paid_value > invoice_value) FROM flow
UNION ALL SELECT 'packed_before_order', count(*) FILTER (first_packing < order_date) FROM flow UNION ALL SELECT 'no_customer', count(*) FILTER (customer_code IS NULL) FROM flow)""")
def o2c_quality(spark, sf_dir):
    so = sales_orders(spark, sf_dir)
    out = so.where(F.col("so_status").isin("Cancelled", "Closed"))
    df = classified(flow_base(spark, sf_dir))
    n = lambda frame, name: frame.agg(F.count("*").alias("n")).select(F.lit(name).alias("check_name"), "n")
    one = df.agg(*(F.count(F.when(t, 1)).alias(k) for k, t in {"negative_value": F.col("so_value") < 0, "invoice_over_packing": (F.col("invoice_value") > F.col("packing_value")) & F.col("has_packing"), "paid_over_invoice": F.col("paid_value") > F.col("invoice_value"), "packed_before_order": F.col("first_packing") < F.col("order_date"), "no_customer": F.col("customer_code").isNull()}.items()))
    rows = one.unpivot([], one.columns, "check_name", "n")
    return rows.unionByName(n(orphans(packing_slips(spark, sf_dir), "so_code", df, out), "packing_without_order")).unionByName(n(orphans(invoices(spark, sf_dir), "so_code", df, out), "invoice_without_order")).unionByName(n(out, "excluded_orders"))
