"""Small relational operators of the workspace: semi and anti joins, distinct, top, pages, boards, sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import total
from ..operators.joins import orphans
from ..operators.windows import keep_first
from ..sources.tables import invoice_lines, invoices, packing_slips, sales_orders, table
from .frames_sql import BILL, INV, PACK, SO

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("q_semi", f"WITH {SO}, {PACK} SELECT so_code, so_status FROM so WHERE so_code IN (SELECT so_code FROM pack)")
def semi(spark, sf_dir):
    return sales_orders(spark, sf_dir).join(packing_slips(spark, sf_dir), "so_code", "left_semi").select("so_code", "so_status")


@query("q_anti", f"WITH {SO}, {PACK}, {BILL} SELECT so_code, so_status FROM so WHERE so_code NOT IN (SELECT so_code FROM pack) AND so_code NOT IN (SELECT so_code FROM bill)")
def anti(spark, sf_dir):
    return orphans(sales_orders(spark, sf_dir), "so_code", packing_slips(spark, sf_dir), invoices(spark, sf_dir)).select("so_code", "so_status")


@query("q_distinct", f"WITH {INV} SELECT DISTINCT branch, division, salesman FROM inv")
def distinct(spark, sf_dir):
    return invoice_lines(spark, sf_dir).select("branch", "division", "salesman").distinct()


@query("q_topk", f"WITH {INV}, s AS (SELECT customer_code, sum(net) AS net FROM inv GROUP BY 1) SELECT customer_code, CAST(net AS DOUBLE) AS net FROM s ORDER BY s.net DESC, customer_code LIMIT 50")
def topk(spark, sf_dir):
    """The fifty largest customers (a report's length)."""
    s = invoice_lines(spark, sf_dir).groupBy("customer_code").agg(F.sum("net").alias("n"))
    return s.orderBy(F.desc("n"), "customer_code").limit(50).select("customer_code", F.col("n").cast("double").alias("net"))


@query("q_page", f"WITH {SO} SELECT so_code, salesman FROM so WHERE contains(lower(salesman), 'slp1') ORDER BY salesman, so_code LIMIT 200 OFFSET 200")
def page(spark, sf_dir):
    """Second page of 200 of a filtered, sorted list."""
    return sales_orders(spark, sf_dir).where(F.lower("salesman").contains("slp1")).orderBy("salesman", "so_code").offset(200).limit(200).select("so_code", "salesman")


@query("q_board_group", f"WITH {SO}, o AS (SELECT * FROM (VALUES (0, 'Open'), (1, 'Draft'), (2, 'On Hold'), (3, 'Done'), (4, 'Archived')) t(pos, option)) SELECT * FROM (SELECT pos, option, count(so_code) AS n FROM o LEFT JOIN so ON option = so_status GROUP BY 1, 2 UNION ALL SELECT 5, 'Unassigned', count(*) FROM so WHERE so_status NOT IN (SELECT option FROM o))")
def board_group(spark, sf_dir):
    """Cards by declared option in their order, empty ones too, and a bucket for the rest."""
    options = ["Open", "Draft", "On Hold", "Done", "Archived"]
    o = spark.createDataFrame(list(enumerate(options)), "pos int, option string")
    n = sales_orders(spark, sf_dir).withColumn("option", F.when(F.col("so_status").isin(options), F.col("so_status")).otherwise("Unassigned")).groupBy("option").agg(F.count("*").alias("n"))
    o = o.unionByName(spark.createDataFrame([(len(options), "Unassigned")], "pos int, option string"))
    return o.join(n, "option", "left").select("pos", "option", F.coalesce("n", F.lit(0)).alias("n"))


@query("q_dashboard_sums", "SELECT count(*) AS n_rows, CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_price, CAST(sum(p_size) AS BIGINT) AS sum_size FROM part")
def dashboard_sums(spark, sf_dir):
    return table(spark, sf_dir, "part").agg(F.count("*").alias("n_rows"), total(F.col("p_retailprice").cast("decimal(18,2)")).alias("sum_price"), F.sum(F.col("p_size").cast("long")).alias("sum_size"))


def insert_new(existing: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows to insert: the first of each key that is not there yet."""
    return keep_first(rows, keys, order).join(existing.select(*keys), keys, "left_anti")


@query("q_timeline", "SELECT CAST(date_trunc('month', least(l_shipdate, o_orderdate)) AS DATE) AS month, min(CAST(least(l_shipdate, o_orderdate) AS DATE)) AS first_day, max(CAST(greatest(l_shipdate, o_orderdate) AS DATE)) AS last_day, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def timeline(spark, sf_dir):
    """Spans put the right way round, by month of their start."""
    df = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    a, b = F.least("l_shipdate", "o_orderdate").cast("date"), F.greatest("l_shipdate", "o_orderdate").cast("date")
    return df.select(a.alias("a"), b.alias("b")).groupBy(F.trunc("a", "month").alias("month")).agg(F.min("a").alias("first_day"), F.max("b").alias("last_day"), F.count("*").alias("n"))
