"""Domain frames over the star-schema tables: invoice lines, orders, packing, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.numeric import money
from ..operators.stage import dealt

#: Division codes of the market segments in the test tables.
SEGMENTS = {"BUILDING": "PI", "AUTOMOBILE": "ICI", "MACHINERY": "PP", "FURNITURE": "EL", "HOUSEHOLD": "LM"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def division(c: Column) -> Column:
    out = F.lit("")
    for k, v in SEGMENTS.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def net_price() -> Column:
    return money(money(F.col("l_extendedprice")) * (1 - F.col("l_discount").cast("decimal(4,2)")))


def invoice_lines(spark: SparkSession, sf_dir: str, by_invoice: bool = False, products=lambda df: df, salesmen=lambda df: df) -> DataFrame:
    """One row per invoice line with its dimensions; ``products`` and ``salesmen`` add columns of their own to these frames.

    Orders meet their customers before the lines meet the orders, so lines are not shuffled by customer.  ``by_invoice``: orders
    come last and the lines of an invoice stay together, dealt out by the number of lines, for what counts invoices."""
    t = lambda n: table(spark, sf_dir, n)
    # rules are evaluated on the dimension tables, once for each of their rows
    customers = t("customer").select("c_custkey", "c_name", division(F.col("c_mktsegment")).alias("division"))
    held = ["s_suppkey", "p_partkey", "p_size"]
    sellers = salesmen(t("supplier").select("s_suppkey", F.col("s_name").alias("salesman"), rules.branch_of(F.col("s_name"), rules.DAILY).alias("branch")))
    goods = products(t("part").select("p_partkey", F.lower("p_brand").alias("sku"), F.col("p_type").alias("category"), F.col("p_name").alias("product_name"), "p_size"))
    orders = t("orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    to_orders = lambda df: df.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    to_rest = lambda df: df.join(goods, F.col("l_partkey") == F.col("p_partkey")).join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
    df = to_orders(dealt(to_rest(t("lineitem")), t("lineitem").count(), "l_orderkey")) if by_invoice else to_rest(to_orders(t("lineitem")))
    qty = money(F.col("l_quantity"))
    return df.select(
        F.col("l_shipdate").cast("date").alias("invoice_date"),
        F.col("l_orderkey").alias("invoice_code"),
        F.col("c_custkey").alias("customer_code"),
        F.col("c_name").alias("customer_name"),
        "division",
        *(c for c in sellers.columns if c not in held),
        *(c for c in goods.columns if c not in held),
        F.col("p_partkey").alias("product_code"),
        qty.alias("qty"),
        net_price().alias("net"),
        money(qty * F.col("p_size")).alias("volume"),
        F.col("l_returnflag").alias("status"),
    )


def sales_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sales orders; every eleventh key is cancelled, every thirteenth closed."""
    k = F.col("o_orderkey")
    status = (
        F.when(k % 11 == 3, "Cancelled").when(k % 13 == 5, "Closed").when(F.col("o_orderpriority").startswith("4"), "Draft").when(F.col("o_orderpriority").startswith("5"), "On Hold")
        .when(F.col("o_orderstatus") == "F", "Done").when(F.col("o_orderstatus") == "P", "Done-Partial").otherwise("Open")
    )
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        k.alias("so_code"),
        F.col("o_custkey").alias("customer_code"),
        division(F.col("c_mktsegment")).alias("division"),
        F.concat(F.lit("SLP"), F.lpad((k % 90).cast("string"), 2, "0")).alias("salesman"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        status.alias("so_status"),
        money(F.col("o_totalprice")).alias("so_value"),
        money(money(F.col("o_totalprice")) * F.when(k % 4 == 0, F.lit(0.5).cast("decimal(2,1)")).otherwise(F.lit(1.0).cast("decimal(2,1)"))).alias("delivery_value"),
    )


def packing_slips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("so_code"), F.col("l_shipdate").cast("date").alias("printed_date"), net_price().alias("net"))


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoiced lines: due after 30 days, paid 20 days after the date where the flag says so."""
    date = F.col("l_shipdate").cast("date")
    paid = F.col("l_returnflag") == "A"
    return table(spark, sf_dir, "lineitem").where("l_returnflag in ('A', 'N')").select(
        F.col("l_orderkey").alias("so_code"),
        F.col("l_orderkey").alias("invoice_code"),
        date.alias("invoice_date"),
        F.date_add(date, 30).alias("due_date"),
        F.when(paid, F.date_add(date, 20)).alias("paid_date"),
        net_price().alias("net"),
        F.when(paid, net_price()).otherwise(F.lit(0).cast("decimal(18,2)")).alias("paid"),
        F.when(F.col("l_returnflag") == "A", "Done").otherwise("Open").alias("invoice_status"),
    )


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", F.col("user_id").alias("customer"), F.col("ts").cast("date").alias("date"), money(F.col("value")).alias("value"), (F.col("event_id") % 37).alias("sku"))


def gifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'signup'").select("event_id", F.col("user_id").alias("customer"), F.col("ts").cast("date").alias("date"), (F.col("event_id") % 7).alias("program"), (F.col("user_id") % 5).alias("branch"))


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.concat(F.lit("S"), (F.col("user_id") % 20).cast("string")).alias("salesman"), F.col("ts").cast("date").alias("visit_date"), F.when(F.col("user_id") % 9 == 0, None).otherwise(F.concat(F.lit("B"), (F.col("user_id") % 4).cast("string"))).alias("branch"), F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("status"))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Internal price list: a name, a code, a price for every part."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("row_id"), F.upper(F.concat_ws(" ", "p_name", "p_brand", F.concat(F.col("p_size").cast("string"), F.lit("MM")))).alias("name"), F.concat(F.lit("P-"), F.col("p_partkey").cast("string")).alias("code"), F.col("p_brand").alias("brand"), money(F.col("p_retailprice")).alias("price"), F.col("p_size").alias("size"))


def vendor_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendor price list: every second part, spelled otherwise, some prices changed."""
    p = table(spark, sf_dir, "part").where("p_partkey % 2 = 0")
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.concat_ws("-", "p_name", "p_brand", F.concat(F.col("p_size").cast("string"), F.lit(" mm")))).otherwise(F.concat_ws("  ", "p_brand", "p_name", F.concat(F.col("p_size").cast("string"), F.lit("MM"))))
    price = money(money(F.col("p_retailprice")) * F.when(k % 10 == 0, F.lit(1.1).cast("decimal(3,2)")).when(k % 14 == 0, F.lit(0.95).cast("decimal(3,2)")).when(k % 202 == 0, F.lit(2.2).cast("decimal(3,2)")).otherwise(F.lit(1).cast("decimal(3,2)")))
    return p.select(k.alias("row_id"), name.alias("name"), F.when(k % 5 == 0, F.concat(F.lit("P"), k.cast("string"))).alias("code"), F.col("p_brand").alias("brand"), price.alias("price"), (k % 60).cast("double").alias("qty"))


VENDOR = "ACME"


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def vendor_sheet(spark: SparkSession, sf_dir: str, parts: DataFrame | None = None) -> DataFrame:
    """The vendor's list as a sheet: every second part; some names hold two variants, some two products, some rows are
    blank.  Cells: product, code, variant, brand, remark, price, quantity.  ``parts``: the table, where it is at hand."""
    p = (table(spark, sf_dir, "part") if parts is None else parts).where("p_partkey % 2 = 0")
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    plain = F.when(k % 3 == 0, F.concat_ws("-", "p_name", "p_brand", F.concat(size, F.lit(" mm")))).otherwise(F.concat_ws("  ", "p_brand", "p_name", F.concat(size, F.lit("MM"))))
    name = F.when(k % 14 == 2, F.concat_ws(" ", "p_name", "p_brand", F.concat(size, F.lit("MM W/K")))).when(k % 22 == 4, F.concat_ws(" ", F.replace("p_name", F.lit(" "), F.lit("/LOOSE ")), "p_brand", F.concat(size, F.lit("MM")))).otherwise(plain)
    factor = F.when(k % 10 == 0, F.lit(1.1).cast("decimal(3,2)")).when(k % 14 == 0, F.lit(0.95).cast("decimal(3,2)")).when(k % 202 == 0, F.lit(2.2).cast("decimal(3,2)")).otherwise(F.lit(1).cast("decimal(3,2)"))
    cells = [name, F.when(k % 5 == 0, F.concat(F.lit("P"), k.cast("string"))), F.when(k % 4 == 0, F.col("p_type")), F.col("p_brand"), F.when(k % 6 == 2, F.concat_ws(" ", "p_type", "p_name")), money(money(F.col("p_retailprice")) * factor), k % 60]
    return p.select(k.cast("long").alias("row_idx"), F.when(k % 50 == 8, F.array(*(F.lit("") for _ in cells))).otherwise(F.array(*map(_text, cells))).alias("cells"))


def internal_sheet(spark: SparkSession, sf_dir: str, parts: DataFrame | None = None) -> DataFrame:
    """The internal list as a sheet: all parts, two rows for two variants, three for prices graded by quantity.
    Cells: name, code, variant, brand, description, price, quantity rule.  ``parts``: the table, where it is at hand."""
    p = table(spark, sf_dir, "part") if parts is None else parts
    k, j = F.col("p_partkey"), F.col("j")
    kind = F.when(k % 14 == 2, 2).when(k % 10 == 0, 3).otherwise(1)
    rows = p.select("*", kind.alias("rows"), F.explode(F.sequence(F.lit(0), kind - 1)).alias("j"))
    pair, graded = F.col("rows") == 2, F.col("rows") == 3
    name = F.upper(F.concat_ws(" ", "p_name", "p_brand", F.concat(F.col("p_size").cast("string"), F.lit("MM")), F.when(pair & (j == 0), "W").when(pair, "K")))
    factor = F.when(graded & (j == 1), F.lit(0.9).cast("decimal(3,2)")).when(graded & (j == 2), F.lit(0.8).cast("decimal(3,2)")).otherwise(F.lit(1).cast("decimal(3,2)"))
    rule = F.when(graded & (j == 0), "max 9").when(graded & (j == 1), "10 - 29").when(graded, ">= 30")
    cells = [name, F.when(k % 7 != 0, F.concat(F.lit("P-"), k.cast("string"))), F.when(k % 3 != 0, F.col("p_type")), F.col("p_brand"), F.when((k % 6).isin(2, 4), F.concat_ws(" ", "p_name", "p_type")), money(money(F.col("p_retailprice")) * factor), rule]
    return rows.select((k.cast("long") * 4 + j).alias("row_idx"), F.array(*map(_text, cells)).alias("cells"))


def learned_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of earlier runs, with clashes: for this vendor and for all, by name and by code; one names a product that is gone."""
    p = table(spark, sf_dir, "part").where("p_partkey % 2 = 0 and p_partkey % 3 <> 0 and p_partkey % 14 <> 2 and p_partkey % 22 <> 4 and p_partkey % 50 <> 8")
    k = F.col("p_partkey")
    tidy = lambda *parts: F.upper(F.replace(F.concat_ws(" ", *parts), F.lit("#"), F.lit(" ")))
    key, size = tidy("p_brand", "p_name", F.concat(F.col("p_size").cast("string"), F.lit("MM"))), F.concat(F.col("p_size").cast("string"), F.lit("MM"))
    ours, gone = tidy("p_name", "p_brand", size), F.lit("NO SUCH PRODUCT")
    rule = lambda when, vendor, name, code, to: F.when(when, F.struct(F.lit(vendor).alias("vendor_name"), name.alias("vendor_key"), code.alias("vendor_code"), to.alias("internal_key")))
    none, code = F.lit(None).cast("string"), F.concat(F.lit("p-"), k.cast("string"))
    rules = F.array(
        rule(k % 40 == 0, "", key, none, gone), rule(k % 80 == 0, VENDOR, key, none, ours), rule(k % 25 == 0, "", F.concat(F.lit("OLD "), key), code, ours),
        rule(k % 50 == 0, VENDOR, F.concat(F.lit("OLDER "), key), code, gone), rule(k % 16 == 0, "OTHER", key, code, ours),
    )
    return p.select(F.explode(F.array_compact(rules)).alias("r")).select("r.*")
