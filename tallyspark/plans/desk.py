"""Desk work around the audit and the sales tables: cleaning, lists, look-ups, review, exports, page words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.dates import file_date, parse_date
from ..operators.aggs import first_seen
from ..operators.geometry import words_to_cells
from ..operators.joins import fan_lookup, resolve
from ..operators.profile import price_derived
from ..operators.windows import carry_forward
from ..sources.tables import catalogue, invoice_lines, table, vendor_list
from .audit import _ITEMS, EXTREME, audited, price_items
from .basics import insert_new
from .frames_sql import CAT, INV, VEND
from .names import _NAMED, RULES, named

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# -- cleaning ---------------------------------------------------------------------------------
_RAW = "CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN ' none ' WHEN 3 THEN 'NaN' ELSE ' ' || p_name || ' / ' || p_brand || ' ' END"


@query("q_text_cleaners", f"WITH t AS (SELECT p_partkey AS row_id, {_RAW} AS raw FROM part), n AS (SELECT *, CASE WHEN upper(trim(raw)) NOT IN ('', 'NONE', 'NAN', 'NULL') THEN trim(raw) END AS null_text FROM t) SELECT row_id, trim(coalesce(raw, '')) AS blank_text, null_text, coalesce(null_text, 'Unknown') AS unknown_text, regexp_replace(lower(trim(raw)), '[^a-z0-9]', '', 'g') AS norm_key FROM n")
def text_cleaners(spark, sf_dir):
    """The three policies for missing text, and keys of letters and digits."""
    raw = F.expr(_RAW)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), T.blank_text(raw).alias("blank_text"), T.null_text(raw).alias("null_text"), T.unknown_text(raw).alias("unknown_text"), T.norm_key(raw).alias("norm_key"))


_BRAND = "CASE p_partkey % 9 WHEN 0 THEN 'none' WHEN 1 THEN NULL ELSE p_name || '-wtp/' || upper(p_type) || ' ici_' || lower(p_brand) END"


@query("q_brand_labels", f"WITH t AS (SELECT p_partkey AS row_id, {_BRAND} AS raw FROM part) SELECT row_id, CASE WHEN coalesce(lower(trim(raw)), '') IN ('', 'nan', 'none') THEN 'Unknown' ELSE array_to_string(list_transform(regexp_extract_all(trim(raw), '[^\\s\\-_/]+|[\\s\\-_/]'), lambda x: CASE WHEN upper(x) IN ('WTP', 'SC', 'ICI') THEN upper(x) ELSE upper(x[1]) || lower(x[2:]) END), '') END AS label FROM t")
def brand_labels(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), T.brand_label(F.expr(_BRAND)).alias("label"))


_PROGRAMME = "CASE event_id % 9 WHEN 0 THEN 'Bonus helm toko' WHEN 1 THEN 'cashback Juli' WHEN 2 THEN 'Reward Setahun' WHEN 3 THEN 'Diskon depo Bandung' WHEN 4 THEN 'Program Pipa baru' WHEN 5 THEN 'Extra Discount' WHEN 6 THEN 'sell out toko' WHEN 7 THEN 'Lain-lain' END"
_GIFT_SQL = " ".join(f"WHEN regexp_matches(u, '{a}')" + (f" AND regexp_matches(u, '{b}')" if b else "") + f" THEN '{label}'" for a, b, label in T.GIFT_TYPES)


@query("q_gift_types", f"WITH t AS (SELECT event_id, {_PROGRAMME} AS name, upper(coalesce({_PROGRAMME}, '')) AS u FROM events) SELECT name, CASE {_GIFT_SQL} ELSE 'Other Program' END AS gift_type, count(*) AS n FROM t GROUP BY 1, 2")
def gift_types(spark, sf_dir):
    name = F.expr(_PROGRAMME)
    return table(spark, sf_dir, "events").groupBy(name.alias("name"), T.gift_type(name).alias("gift_type")).agg(F.count("*").alias("n"))


_ENUMS = "CASE p_partkey % 3 WHEN 0 THEN p_name || ' ' || p_size || '/' || (p_size + 1) || ' MM' WHEN 1 THEN p_name || ' W/K PIPE' ELSE p_name || ' A/12' END"


@query("q_candidate_names", f"WITH t AS (SELECT p_partkey AS row_id, {_ENUMS} AS raw, CASE p_partkey % 3 WHEN 0 THEN [p_name || ' ' || p_size || ' MM', p_name || ' ' || (p_size + 1) || ' MM'] WHEN 1 THEN [p_name || ' W PIPE', p_name || ' K PIPE'] ELSE [] END AS more FROM part) SELECT row_id, unnest(list_concat([raw], more)) AS candidate FROM t")
def candidate_names(spark, sf_dir):
    """A name and its readings where it enumerates parts of one kind."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), F.explode(T.candidate_names(F.expr(_ENUMS))).alias("candidate"))


# -- dates, numbers, fields ---------------------------------------------------------------------
_DATE_FORMS = ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm:ss")
_STRF = ("%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%Y-%m-%d %H:%M:%S", "%d/%m/%Y %H:%M:%S", "%m/%d/%Y %H:%M:%S")
_DATE_TEXT = "CASE o_orderkey % 8 " + " ".join(f"WHEN {n} THEN strftime(o_orderdate, '{f}')" for n, f in enumerate(_STRF)) + " WHEN 6 THEN '31.12.1999' END"


@query("q_dates_parsed", f"WITH t AS (SELECT o_orderkey, {_DATE_TEXT} AS raw FROM orders) SELECT o_orderkey, CAST(coalesce({', '.join(f'''try_strptime(raw, '{f}')''' for f in _STRF)}) AS DATE) AS day FROM t")
def dates_parsed(spark, sf_dir):
    """Dates written in six ways; day before month where both readings are dates, null where none is."""
    raw = F.lit(None).cast("string")
    for n, f in enumerate(_DATE_FORMS):
        raw = F.when(F.col("o_orderkey") % 8 == n, F.date_format("o_orderdate", f)).otherwise(raw)
    raw = F.when(F.col("o_orderkey") % 8 == 6, "31.12.1999").otherwise(raw)
    return table(spark, sf_dir, "orders").select("o_orderkey", parse_date(raw).alias("day"))


@query("q_file_dates", "SELECT strftime(o_orderdate, '%-d %B %Y') AS stamp, count(*) AS n FROM orders GROUP BY 1")
def file_dates(spark, sf_dir):
    """The date in a file's name."""
    name = F.concat(F.lit("Laporan Harian "), F.date_format("o_orderdate", "d MMMM yyyy"), F.lit(" v2.xlsx"))
    return table(spark, sf_dir, "orders").groupBy(file_date(name).alias("stamp")).agg(F.count("*").alias("n"))


@query("q_rounding", "WITH t AS (SELECT event_id, CAST(CAST(value AS DECIMAL(18,2)) * 100 AS BIGINT) AS c FROM events) SELECT event_id, CAST((abs(c) + 1) // 2 * sign(c) AS DOUBLE) / 100 AS half_up, CAST((abs(c) // 2 + CASE WHEN abs(c) % 2 = 1 AND abs(c) // 2 % 2 = 1 THEN 1 ELSE 0 END) * sign(c) AS DOUBLE) / 100 AS half_even FROM t")
def rounding(spark, sf_dir):
    """Half of an amount to the cent: halves away from zero, and to the even cent."""
    half = F.col("value").cast("decimal(18,2)") * F.lit(0.5).cast("decimal(2,1)")
    return table(spark, sf_dir, "events").select("event_id", F.round(half, 2).cast("double").alias("half_up"), F.bround(half, 2).cast("double").alias("half_even"))


_PROPS = "CASE event_id % 10 WHEN 0 THEN '' WHEN 1 THEN 'oops' WHEN 2 THEN NULL ELSE props END"


@query("q_json_fields", f"WITH t AS (SELECT event_id, {_PROPS} AS raw FROM events) SELECT event_id, coalesce(TRY_CAST(regexp_extract(raw, '\"k\": (\\d+)', 1) AS INTEGER), -1) AS k FROM t")
def json_fields(spark, sf_dir):
    """A field of a JSON text, with a value to fall back on where the text is no JSON or lacks it."""
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.get_json_object(F.expr(_PROPS), "$.k").try_cast("int"), F.lit(-1)).alias("k"))


@query("q_price_derived", f"WITH {VEND}, p AS (SELECT 'list_price' AS candidate, CAST(price * 1.1::DECIMAL(2,1) AS DOUBLE) / nullif(CAST(price AS DOUBLE), 0) AS r FROM vend UNION ALL SELECT 'qty', CAST(qty AS DOUBLE) / nullif(CAST(price AS DOUBLE), 0) FROM vend), m AS (SELECT candidate, list_sort(list(r))[count(r) // 2 + 1] AS m, count(r) AS n, count(*) AS c FROM p GROUP BY 1) SELECT candidate, n >= greatest(5, c * 0.5) AND m <> 0 AND count(*) FILTER (abs(r - m) / m < 0.03) / n >= 0.6 AS derived FROM p JOIN m USING (candidate) GROUP BY candidate, m, n, c")
def q_price_derived(spark, sf_dir):
    v = vendor_list(spark, sf_dir).withColumn("list_price", F.col("price") * F.lit(1.1).cast("decimal(2,1)"))
    out = [price_derived(v, c, "price").withColumn("candidate", F.lit(c)) for c in ("list_price", "qty")]
    return out[0].unionByName(out[1])


# -- lists, filters, windows ----------------------------------------------------------------------
@query("q_list_joins", """WITH v AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN ' none' WHEN o_orderkey % 6 = 1 THEN NULL ELSE o_orderpriority END AS p, strftime(o_orderdate, '%Y-%m') AS m FROM orders),
s AS (SELECT o_custkey, list_sort(list(DISTINCT p) FILTER (p IS NOT NULL AND p <> ' none')) AS l FROM v GROUP BY 1),
f AS (SELECT o_custkey, m, min(o_orderkey) AS k FROM v GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY k) AS place, count(*) OVER (PARTITION BY o_custkey) AS n FROM f),
g AS (SELECT o_custkey, string_agg(m, ' + ' ORDER BY place) FILTER (place <= 12) AS t, max(n) AS n FROM r GROUP BY 1)
SELECT o_custkey AS customer, array_to_string(l, ', ') AS commas, array_to_string(l[1:3], ' | ') AS bars, CASE WHEN n > 12 THEN t || ' + ... (' || n || ' items)' ELSE t END AS months FROM s JOIN g USING (o_custkey)""")
def list_joins(spark, sf_dir):
    """Lists of a customer's priorities (sorted) and months (as first seen)."""
    o = table(spark, sf_dir, "orders")
    p = F.when(F.col("o_orderkey") % 6 == 0, " none").when(F.col("o_orderkey") % 6 == 1, None).otherwise(F.col("o_orderpriority"))
    sets = o.groupBy(F.col("o_custkey").alias("customer")).agg(T.join_list(p).alias("commas"), T.join_list(p, " | ", 3).alias("bars"))
    months = o.select(F.col("o_custkey").alias("customer"), "o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("m"))
    return sets.join(first_seen(months, ["customer"], "m", ["o_orderkey"], "months"), "customer")


_MIXED = "CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE CAST(c_custkey % 50 AS {0}) END"


@query("q_mixed_sort", f"WITH t AS (SELECT c_custkey, c_name, {_MIXED.format('VARCHAR')} AS cell FROM customer WHERE contains(lower(c_name), 'er#0')) SELECT * FROM t ORDER BY TRY_CAST(cell AS DOUBLE) NULLS LAST, cell, c_custkey LIMIT 100")
def mixed_sort(spark, sf_dir):
    """First page of a filtered list: numbers by value, then texts."""
    t = table(spark, sf_dir, "customer").where(F.lower("c_name").contains("er#0")).select("c_custkey", "c_name", F.expr(_MIXED.format("STRING")).alias("cell"))
    return t.orderBy(F.col("cell").try_cast("double").asc_nulls_last(), "cell", "c_custkey").limit(100)


@query("q_carry_forward", "SELECT event_id, last_value(CASE WHEN event_type IN ('signup', 'purchase') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS category FROM events")
def q_carry_forward(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("title", F.when(F.col("event_type").isin("signup", "purchase"), F.col("event_type")))
    return e.select("event_id", carry_forward("title", "event_id", ["user_id"]).alias("category"))


@query("q_calendar", "SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n_cards, count(*) FILTER (o_orderstatus = 'O') AS n_open FROM orders GROUP BY 1")
def calendar(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n_cards"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"))


@query("q_salesman_months", f"WITH {INV} SELECT strftime(invoice_date, '%m-%Y') AS month, count(DISTINCT salesman) AS n_salesmen, count(*) AS n_lines FROM inv GROUP BY 1")
def salesman_months(spark, sf_dir):
    return invoice_lines(spark, sf_dir).groupBy(F.date_format("invoice_date", "MM-yyyy").alias("month")).agg(F.count_distinct("salesman").alias("n_salesmen"), F.count("*").alias("n_lines"))


# -- look-ups -------------------------------------------------------------------------------------
_SKU = "SELECT sku, count(*) AS n, CAST(sum(net) AS DOUBLE) AS net FROM inv GROUP BY 1"


@query("q_lookup_fan_out", f"WITH {INV}, s AS ({_SKU}), r AS (SELECT DISTINCT lower(p_brand) AS sku, p_type AS sku_group FROM part) SELECT sku, n, net, sku_group FROM s LEFT JOIN r USING (sku)")
def lookup_fan_out(spark, sf_dir):
    """A reference with several rows a key multiplies the rows."""
    ref = table(spark, sf_dir, "part").select(F.lower("p_brand").alias("sku"), F.col("p_type").alias("sku_group")).distinct()
    return fan_lookup(_by_sku(spark, sf_dir), ref, "sku").select("sku", "n", "net", "sku_group")


@query("q_lookup_upper", f"WITH {INV}, s AS ({_SKU}), r AS (SELECT upper(p_brand) AS k, max(p_size) AS largest FROM part GROUP BY 1) SELECT sku, n, net, largest FROM s LEFT JOIN r ON upper(trim(sku)) = k")
def lookup_upper(spark, sf_dir):
    ref = table(spark, sf_dir, "part").groupBy(F.concat(F.lit("  "), F.upper("p_brand"), F.lit(" ")).alias("sku")).agg(F.max("p_size").alias("largest"))
    return fan_lookup(_by_sku(spark, sf_dir), ref, "sku", upper=True).select("sku", "n", "net", "largest")


def _by_sku(spark, sf_dir) -> DataFrame:
    return invoice_lines(spark, sf_dir).groupBy("sku").agg(F.count("*").alias("n"), F.sum("net").cast("double").alias("net"))


@query("q_insert_new", "WITH o AS (SELECT o_custkey AS customer, strftime(o_orderdate, '%Y-%m') AS month, o_orderkey, o_orderstatus FROM orders) SELECT customer, month, min(o_orderkey) AS o_orderkey FROM o WHERE (customer, month) NOT IN (SELECT (customer, month) FROM o WHERE o_orderstatus = 'F') GROUP BY 1, 2")
def q_insert_new(spark, sf_dir):
    """First row of each customer and month that has no finished order yet."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderkey", "o_orderstatus")
    return insert_new(o.where("o_orderstatus = 'F'"), o, ["customer", "month"], ["o_orderkey"]).select("customer", "month", "o_orderkey")


@query("q_reference_fallback", f"WITH {_NAMED}, ref AS (SELECT CASE WHEN ni.row_id % 3 = 0 THEN ni.row_id ELSE -1 - ni.row_id END AS ref_id, CASE ni.row_id % 3 WHEN 1 THEN ni.norm WHEN 2 THEN nv.norm END AS ref_norm, ni.price AS price FROM ni LEFT JOIN nv USING (row_id)), n AS (SELECT ref_norm, arg_max(ref_id, ref_id) AS ref_id, arg_max(price, ref_id) AS price FROM ref WHERE ref_norm IS NOT NULL GROUP BY 1), p AS (SELECT nv.row_id AS v, nv.norm AS v_norm, ni.row_id AS i, ni.norm AS i_norm FROM nv LEFT JOIN ni ON nv.row_id = ni.row_id AND nv.row_id % 7 <> 0) SELECT v, coalesce(a.ref_id, b.ref_id, c.ref_id) AS ref_id, CAST(coalesce(a.price, b.price, c.price) AS DOUBLE) AS ref_price FROM p LEFT JOIN ref a ON p.i = a.ref_id LEFT JOIN n b ON p.i_norm = b.ref_norm LEFT JOIN n c ON p.v_norm = c.ref_norm")
def reference_fallback(spark, sf_dir):
    """Reference price of each vendor row: by the internal row's id, else its name, else the vendor's own name."""
    v = named(vendor_list(spark, sf_dir)).select(F.col("row_id").alias("v"), F.col("norm").alias("v_norm"))
    i = named(catalogue(spark, sf_dir)).select(F.col("row_id").alias("i"), F.col("norm").alias("i_norm"), "price")
    kind = F.col("i") % 3
    ref = i.join(v.withColumnRenamed("v", "i"), "i", "left").select(F.when(kind == 0, F.col("i")).otherwise(-1 - F.col("i")).alias("ref_id"), F.when(kind == 1, F.col("i_norm")).when(kind == 2, F.col("v_norm")).alias("ref_norm"), "price")
    rows = v.withColumn("i", F.when(F.col("v") % 7 != 0, F.col("v"))).join(i.drop("price"), "i", "left")
    out = resolve(rows, ref, [("i", "ref_id"), ("i_norm", "ref_norm"), ("v_norm", "ref_norm")], "ref_id", "ref")
    return out.select("v", F.col("ref.ref_id").alias("ref_id"), F.col("ref.price").cast("double").alias("ref_price"))


@query("q_product_search", f"WITH {_NAMED} SELECT row_id, norm FROM ni WHERE contains(norm, 'COLD WIDGET') ORDER BY row_id LIMIT 30")
def q_product_search(spark, sf_dir):
    return product_search(named(catalogue(spark, sf_dir)), "cold-widget ").select("row_id", "norm")


def product_search(rows: DataFrame, words: str) -> DataFrame:
    """The first thirty rows (a list's length) whose normal name holds the normal form of the words."""
    return rows.where(F.col("norm").contains(T.clean_value(F.lit(words), RULES))).orderBy("row_id").limit(30)


# -- review and export ------------------------------------------------------------------------------
@query("q_review_queue", f"WITH {_ITEMS} SELECT v, norm, candidates FROM rs JOIN nv ON nv.row_id = v WHERE status = 'NEED_REVIEW' ORDER BY v LIMIT 60")
def review_queue(spark, sf_dir):
    """The first sixty open rows in file order: as many as a reviewer is asked at once."""
    v, _, results = audited(spark, sf_dir)
    queue = results.where("status = 'NEED_REVIEW'").orderBy("v").limit(60)
    return queue.join(v.select(F.col("row_id").alias("v"), "norm"), "v").select("v", "norm", "candidates")


@query("q_match_status_items", f"WITH {_ITEMS} SELECT it.v, it.i, it.status, rs.status AS match_status FROM it LEFT JOIN rs ON it.v = rs.v")
def match_status_items(spark, sf_dir):
    v, i, results = audited(spark, sf_dir)
    return price_items(v, i, results).join(results.select("v", F.col("status").alias("match_status")), "v", "left").select("v", "i", "status", "match_status")


@query("q_run_statistics", f"WITH {_ITEMS}, al AS (SELECT 'match' AS run, status AS what, CAST(count(*) AS DOUBLE) AS value FROM rs GROUP BY 2 UNION ALL SELECT 'match', 'from ' || source, count(*) FROM rs GROUP BY source UNION ALL SELECT 'price', status, count(*) FROM it GROUP BY status UNION ALL SELECT 'match', 'total', count(*) FROM rs UNION ALL SELECT 'price', 'total', count(*) FROM it) SELECT * FROM al")
def run_statistics(spark, sf_dir):
    """Counts of a matching run by class and source, and of the price run by status."""
    v, i, results = audited(spark, sf_dir)

    def counted(df, run, label):
        return df.groupBy(label.alias("what")).agg(F.count("*").cast("double").alias("value")).select(F.lit(run).alias("run"), "what", "value")

    labels = F.explode(F.array(F.col("status"), F.concat(F.lit("from "), "source"), F.lit("total")))
    match = counted(results.select(labels.alias("l")), "match", F.col("l"))
    price = counted(price_items(v, i, results).select(F.explode(F.array(F.col("status"), F.lit("total"))).alias("l")), "price", F.col("l"))
    return match.unionByName(price)


@query("q_validation_export", f"WITH {_ITEMS} SELECT vendor_label AS vendor_product, internal_label AS internal_product, nv.code AS vendor_code, ni.code AS internal_code, vendor_price, internal_price, vendor_price AS updated_price, diff, CASE WHEN diff_pct > 0 THEN diff_pct END AS increase_pct, CASE WHEN diff_pct < 0 THEN abs(diff_pct) END AS decrease_pct, it.status AS price_status, rs.status AS match_status, rs.confidence, CASE WHEN abs(diff_pct) >= 80 THEN 'Cek Manual - Perubahan Ekstrem' ELSE '' END AS price_alert FROM it LEFT JOIN rs ON it.v = rs.v LEFT JOIN nv ON nv.row_id = it.v LEFT JOIN ni ON it.i = ni.row_id")
def validation_export(spark, sf_dir):
    """All price items as they are handed over: names, both codes, both prices, change, class of the match, alert."""
    v, i, results = audited(spark, sf_dir)
    pct = F.col("diff_pct")
    codes = lambda df, key, name: df.select(F.col("row_id").alias(key), F.col("code").alias(name))
    df = price_items(v, i, results).join(results.select("v", F.col("status").alias("match_status"), "confidence"), "v", "left").join(codes(v, "v", "vendor_code"), "v", "left").join(codes(i, "i", "internal_code"), "i", "left")
    return df.select(F.col("vendor_label").alias("vendor_product"), F.col("internal_label").alias("internal_product"), "vendor_code", "internal_code", "vendor_price", "internal_price", F.col("vendor_price").alias("updated_price"), "diff", F.when(pct > 0, pct).alias("increase_pct"), F.when(pct < 0, F.abs(pct)).alias("decrease_pct"), F.col("status").alias("price_status"), "match_status", "confidence", F.when(F.abs(pct) >= EXTREME, "Cek Manual - Perubahan Ekstrem").otherwise("").alias("price_alert"))


# -- words on pages -----------------------------------------------------------------------------------
@query("q_page_cells", "WITH l AS (SELECT o_custkey AS page, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_quantity) AS r, count(*) OVER (PARTITION BY o_custkey) AS n, l_orderkey, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT page, r - 1 AS row_idx, 'no' || l_orderkey || CASE WHEN n = 1 THEN ' ' ELSE '|' END || CAST(l_quantity AS INTEGER) AS cells FROM l")
def page_cells(spark, sf_dir):
    """Cells out of words with places: each customer's lines are set as a page of two columns, the second half a point
    lower.  A page of one line shows no column edge."""
    r = F.row_number().over(W.partitionBy("o_custkey").orderBy("l_orderkey", "l_linenumber", "l_quantity"))
    df = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").cast("long").alias("page"), r.cast("double").alias("r"), "l_orderkey", "l_quantity")
    word = lambda x0, x1, down, text: F.struct(F.lit(float(x0)).alias("x0"), F.lit(float(x1)).alias("x1"), (F.col("r") * 12 + down).alias("y0"), text.alias("text"))
    words = df.select("page", F.explode(F.array(word(10, 60, 0.0, F.concat(F.lit("no"), F.col("l_orderkey").cast("string"))), word(120, 150, 0.5, F.col("l_quantity").cast("int").cast("string")))).alias("w")).select("page", "w.*")
    return words_to_cells(words).select("page", "row_idx", F.array_join("cells", "|").alias("cells"))
