"""Loading: CSV scans, managed tables, and what the columns of sheets mean."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.columns import HINTS, ROLES, assign_roles, cells_long, cross_similarity, date_ratios, profiles, role_scores, tracker_roles
from ..operators.page_tables import align_blocks, fill_merged, scanned_headers, table_rows
from ..operators.stage import shared_folder, staged
from ..sources.csv_matrix import read_csv_matrix
from ..sources.sheets import load_table
from ..sources.tables import internal_sheet, table, vendor_sheet
from .audit import INTERNAL_COLUMNS, VENDOR_COLUMNS

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("q_csv_scan", "SELECT CAST(c_custkey AS VARCHAR) AS key, c_name || chr(10) || 'of \"' || c_mktsegment || '\", so called' AS name, CAST(c_nationkey AS VARCHAR) AS nation FROM customer")
def csv_scan(spark, sf_dir):
    """Customers written as CSV, with line ends, quotes and commas inside a field, and read again as a matrix."""
    c = table(spark, sf_dir, "customer")
    path = f"{shared_folder(spark)}/customers-{uuid.uuid4().hex}"
    name = F.concat("c_name", F.lit('\nof "'), "c_mktsegment", F.lit('", so called'))
    c.select(F.col("c_custkey").cast("string"), name.alias("name"), F.col("c_nationkey").cast("string")).write.option("quoteAll", True).option("escape", '"').csv(path)
    m = read_csv_matrix(spark, path)
    return m.select(F.get("cells", F.lit(0)).alias("key"), F.get("cells", F.lit(1)).alias("name"), F.get("cells", F.lit(2)).alias("nation"))


@query("q_managed_tables", "SELECT c_custkey AS k, c_mktsegment AS segment, count(*) AS n, max(o_orderkey) AS last_order FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def managed_tables(spark, sf_dir):
    """Orders and customers loaded into tables clustered by customer, joined and counted without an exchange."""
    db = f"tallyspark_{spark.sparkContext.applicationId.replace('-', '_')}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {db} LOCATION '{shared_folder(spark)}/{db}-{uuid.uuid4().hex}'")
    load_table(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey"), f"{db}.orders", ["k"], 8)
    load_table(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment")), f"{db}.customers", ["k"], 8)
    both = spark.table(f"{db}.orders").join(spark.table(f"{db}.customers"), "k")
    return both.groupBy("k", "segment").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last_order"))


def sheets(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Filled cells of the vendor's and the internal sheet."""

    def one(matrix, name, columns):
        heads = spark.createDataFrame([(name, [c.name for c in columns])], "sheet string, headers array<string>")
        return staged(cells_long(matrix.withColumn("sheet", F.lit(name)), heads), f"{name}-cells")

    return one(vendor_sheet(spark, sf_dir), "vendor", VENDOR_COLUMNS), one(internal_sheet(spark, sf_dir), "internal", INTERNAL_COLUMNS)


_MONEY = "CAST(p_retailprice AS DECIMAL(18,2))"


def _cells_sql() -> str:
    plain = "CASE WHEN k % 3 = 0 THEN p_name || '-' || p_brand || '-' || size || ' mm' ELSE p_brand || '  ' || p_name || '  ' || size || 'MM' END"
    name = f"CASE WHEN k % 14 = 2 THEN p_name || ' ' || p_brand || ' ' || size || 'MM W/K' WHEN k % 22 = 4 THEN replace(p_name, ' ', '/LOOSE ') || ' ' || p_brand || ' ' || size || 'MM' ELSE {plain} END"
    factor = "CASE WHEN k % 10 = 0 THEN 1.10::DECIMAL(3,2) WHEN k % 14 = 0 THEN 0.95::DECIMAL(3,2) WHEN k % 202 = 0 THEN 2.20::DECIMAL(3,2) ELSE 1.00::DECIMAL(3,2) END"
    grade = "CASE WHEN n = 3 AND j = 1 THEN 0.90::DECIMAL(3,2) WHEN n = 3 AND j = 2 THEN 0.80::DECIMAL(3,2) ELSE 1.00::DECIMAL(3,2) END"
    vendor = [name, "CASE WHEN k % 5 = 0 THEN 'P' || k END", "CASE WHEN k % 4 = 0 THEN p_type END", "p_brand", "CASE WHEN k % 6 = 2 THEN p_type || ' ' || p_name END", f"CAST(CAST({_MONEY} * {factor} AS DECIMAL(18,2)) AS VARCHAR)", "CAST(k % 60 AS VARCHAR)"]
    own = ["upper(p_name || ' ' || p_brand || ' ' || size || 'MM' || CASE WHEN n = 2 AND j = 0 THEN ' W' WHEN n = 2 THEN ' K' ELSE '' END)", "CASE WHEN k % 7 <> 0 THEN 'P-' || k END", "CASE WHEN k % 3 <> 0 THEN p_type END", "p_brand", "CASE WHEN k % 6 IN (2, 4) THEN p_name || ' ' || p_type END", f"CAST(CAST({_MONEY} * {grade} AS DECIMAL(18,2)) AS VARCHAR)", "CASE WHEN n = 3 THEN ['max 9', '10 - 29', '>= 30'][j + 1] END"]
    heads = lambda columns: "[" + ", ".join(f"'{c.name}'" for c in columns) + "]"
    unrolled = lambda side, rows, cells, columns, row: f"SELECT '{side}' AS sheet, {row} AS row_idx, unnest(range({len(cells)}))::INTEGER AS col, unnest({heads(columns)}) AS header, trim(unnest([{', '.join(cells)}])) AS v FROM {rows}"
    return f"""pt AS (SELECT *, p_partkey AS k, CAST(p_size AS VARCHAR) AS size FROM part), pi AS (SELECT *, unnest(range(n)) AS j FROM (SELECT *, CASE WHEN k % 14 = 2 THEN 2 WHEN k % 10 = 0 THEN 3 ELSE 1 END AS n FROM pt)),
ce AS MATERIALIZED (SELECT * FROM ({unrolled('vendor', '(SELECT * FROM pt WHERE k % 2 = 0 AND k % 50 <> 8)', vendor, VENDOR_COLUMNS, 'k')} UNION ALL {unrolled('internal', 'pi', own, INTERNAL_COLUMNS, 'k * 4 + j')}) WHERE v <> '')"""


_CROSS = """wd AS (SELECT sheet, col, word, count(*) AS n FROM (SELECT sheet, col, unnest(regexp_split_to_array(upper(v), '[^\\p{L}\\p{N}]+')) AS word FROM ce) WHERE length(word) > 2 GROUP BY 1, 2, 3),
cr AS (SELECT a.sheet, a.col, b.sheet AS other_sheet, b.col AS other_col, CAST(sum(a.n) AS DOUBLE) / (SELECT sum(n) FROM wd t WHERE t.sheet = a.sheet AND t.col = a.col) AS similarity FROM wd a JOIN wd b ON a.word = b.word AND a.sheet <> b.sheet GROUP BY 1, 2, 3, 4)"""


@query("q_cross_similarity", f"WITH {_cells_sql()}, {_CROSS} SELECT sheet, col, other_sheet, other_col, round(similarity, 9) AS similarity FROM cr")
def q_cross_similarity(spark, sf_dir):
    """How much of each column's words occurs in each column of the other sheet."""
    v, i = sheets(spark, sf_dir)
    both = cross_similarity(v, i).unionByName(cross_similarity(i, v))
    return both.withColumn("similarity", F.round("similarity", 9))


def _roles_sql() -> str:
    """Roles dealt out one after the other, a step each."""
    number = "(regexp_matches(v, '^[0-9]+(\\.[0-9]+)?$') OR regexp_matches(v, '^P-?[0-9]+$') OR regexp_matches(v, '^(>= [0-9]+|[0-9]+ - [0-9]+)$'))"
    rule = "regexp_matches(v, '^(>=|<=|>|<|=|between|antara)\\s*\\d*|^\\s*\\d+\\s*[-–]\\s*\\d+\\s*$', 'i')"
    stats = f"""st AS (SELECT sheet, col, header, count(DISTINCT upper(v))::DOUBLE / count(*) AS u, sum(length(v))::DOUBLE / count(*) AS l, count(*) FILTER ({number})::DOUBLE / count(*) AS num, count(*) FILTER ({rule})::DOUBLE / count(*) AS op FROM ce GROUP BY 1, 2, 3),
sx AS (SELECT st.*, CASE WHEN num > 0.85 THEN 'numeric' WHEN num < 0.15 THEN 'text' ELSE 'mixed' END AS kind, coalesce(similarity, 0) AS x, CASE {' '.join(f"WHEN regexp_matches(header, '{p}', 'i') THEN '{r}'" for r, p in HINTS.items())} ELSE '' END AS hint FROM st LEFT JOIN cr ON cr.sheet = st.sheet AND cr.col = st.col AND cr.other_col = 0)"""
    bound = "num * 0.8 + CASE WHEN l <= 6 THEN 0.3 ELSE 0 END"
    judged = {"product": "CASE WHEN kind = 'text' THEN 1 ELSE 0 END * (u * 2 + least(l, 40) / 40 + x * 2)", "price": "num * 2 + u * 0.3 + CASE WHEN l BETWEEN 3 AND 15 THEN 0.3 ELSE 0 END", "code": "CASE WHEN kind <> 'numeric' THEN 0.3 ELSE 0 END + u * 1.5 + CASE WHEN l BETWEEN 3 AND 15 THEN 0.7 ELSE 0 END", "qtyRule": "op * 3", "qtyFrom": bound, "qtyTo": bound, "qty": "num * 1.2 + CASE WHEN l <= 6 THEN 0.4 ELSE 0 END", "category": "CASE WHEN kind = 'text' THEN 1 ELSE 0 END * ((1 - u) * 1.5 + CASE WHEN l <= 25 THEN 0.3 ELSE 0 END)"}
    value = "CASE WHEN regexp_matches(v, '^P-?[0-9]+$') THEN CAST(replace(v, 'P', '') AS DOUBLE) WHEN regexp_matches(v, '^[0-9]+(\\.[0-9]+)?$') THEN CAST(v AS DOUBLE) END"
    derived = f"""nu AS (SELECT sheet, row_idx, col, {value} AS x FROM ce WHERE {value} IS NOT NULL),
ra AS (SELECT a.sheet, a.col, a.x / b.x AS r FROM nu a JOIN r1 p ON p.sheet = a.sheet AND p.col <> a.col JOIN nu b ON b.sheet = p.sheet AND b.col = p.col AND b.row_idx = a.row_idx AND b.x <> 0),
md AS (SELECT sheet, col, list_sort(list(r))[len(list(r)) // 2 + 1] AS m, count(*) AS n FROM ra GROUP BY 1, 2),
dv AS (SELECT sheet, col FROM ra JOIN md USING (sheet, col) JOIN (SELECT sheet, count(DISTINCT row_idx) AS rows FROM ce GROUP BY 1) USING (sheet) GROUP BY sheet, col, m, n, rows HAVING n >= greatest(5, rows * 0.5) AND m <> 0 AND count(*) FILTER (abs(r - m) / m < 0.03)::DOUBLE / n >= 0.6)"""
    steps, taken = [], ["SELECT '' AS sheet, -1 AS col, '' AS role, '' AS header"]
    barred = " WHERE kind <> 'numeric' OR (sheet, col) NOT IN (SELECT (sheet, col) FROM dv)"
    for k, (role, bar) in enumerate(ROLES.items()):
        steps.append(f"r{k} AS (SELECT sheet, col, role, header FROM (SELECT sheet, col, '{role}' AS role, header, {judged[role]} + CASE WHEN hint = '{role}' THEN 1.5 ELSE 0 END AS score FROM sx ANTI JOIN ({' UNION ALL '.join(taken)}) USING (sheet, col){barred if role == 'code' else ''}) QUALIFY row_number() OVER (PARTITION BY sheet ORDER BY score DESC, col) = 1 AND score >= {bar})")
        taken.append(f"SELECT sheet, col, role, header FROM r{k}")
        steps += [derived] * (role == "price")
    return f"{stats}, {', '.join(steps)} {' UNION ALL '.join(taken[1:])}"


@query("q_sheet_roles", f"WITH {_cells_sql()}, {_CROSS}, {_roles_sql()}")
def q_sheet_roles(spark, sf_dir):
    """The role of every column of both sheets, each judged with the other's product column at hand."""
    v, i = sheets(spark, sf_dir)
    near = cross_similarity(v, i).unionByName(cross_similarity(i, v)).where("other_col = 0").select("sheet", "col", F.col("similarity").alias("cross"))
    cells = v.unionByName(i)
    stats = staged(role_scores(profiles(cells).join(near, ["sheet", "col"], "left")), "column-profiles")
    return assign_roles(stats, cells)


# Roles of a visit list with the words that hint at them, in order.
VISIT_HINTS = {"salesman": ["salesman", "sales", "name"], "visit_date": ["visit date", "tanggal"], "branch": ["branch", "cabang"], "status": ["status", "result"]}


@query("q_tracker_roles", "SELECT 'orders' AS sheet, unnest(['salesman', 'status', 'visit_date']) AS role, unnest([0, 1, 2]) AS col")
def q_tracker_roles(spark, sf_dir):
    """Roles of an order list's columns: two by their headers, the date by what the cells read as."""
    o = table(spark, sf_dir, "orders")
    cells = F.array(F.col("o_custkey").cast("string"), F.col("o_orderstatus"), F.date_format("o_orderdate", "dd/MM/yyyy"), F.col("o_totalprice").cast("string"))
    heads = spark.createDataFrame([("orders", ["Sales Name", "Order Status", "When", "Total"])], "sheet string, headers array<string>")
    filled = cells_long(o.select(F.lit("orders").alias("sheet"), F.col("o_orderkey").alias("row_idx"), cells.alias("cells")), heads)
    return tracker_roles(date_ratios(filled), VISIT_HINTS)


# -- tables of pages: the parts of a brand are set as a page ---------------------------------------------
def _price(c):
    return c.cast("decimal(18,2)").cast("string")


@query("q_merged_cells", f"SELECT p_brand AS page, p_partkey * 3 + j AS row_idx, CASE j WHEN 0 THEN p_name || '||' WHEN 1 THEN p_name || '|' || p_size || '|' || CAST({_MONEY} AS VARCHAR) ELSE '||' END AS cells FROM part, range(3) r(j)")
def merged_cells(spark, sf_dir):
    """A name over its sizes and prices: a row with the name alone, one with the numbers, a blank one; the name fills down."""
    p = table(spark, sf_dir, "part")
    row = lambda j, *cells: F.struct((F.col("p_partkey").cast("long") * 3 + j).alias("row_idx"), F.array(*cells).alias("cells"))
    no = F.lit("")
    rows = p.select(F.col("p_brand").alias("page"), F.explode(F.array(row(0, F.col("p_name"), no, no), row(1, no, F.col("p_size").cast("string"), _price(F.col("p_retailprice"))), row(2, no, no, no))).alias("r")).select("page", "r.*")
    return fill_merged(rows).withColumn("cells", F.array_join("cells", "|"))


@query("q_block_alignment", f"SELECT p_brand AS page, CAST(p_partkey % 2 AS INTEGER) AS block, CAST(p_partkey AS BIGINT) AS row_idx, CASE WHEN p_partkey % 2 = 0 OR NOT EXISTS (SELECT 1 FROM part q WHERE q.p_brand = part.p_brand AND q.p_partkey % 2 = 0) THEN CASE WHEN p_partkey % 2 = 0 THEN p_name || '|' || CAST({_MONEY} AS VARCHAR) ELSE CAST({_MONEY} AS VARCHAR) || '|' || p_name END ELSE p_name || '|' || CAST({_MONEY} AS VARCHAR) END AS cells FROM part")
def block_alignment(spark, sf_dir):
    """Two blocks a page, the second with its columns the other way round, under the columns of the first."""
    k, price = F.col("p_partkey"), _price(F.col("p_retailprice"))
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("page"), (k % 2).cast("int").alias("block"), k.cast("long").alias("row_idx"), F.when(k % 2 == 0, F.array("p_name", price)).otherwise(F.array(price, F.col("p_name"))).alias("cells"))
    return align_blocks(rows).withColumn("cells", F.array_join("cells", "|"))


@query("q_table_rows", f"""WITH r AS (SELECT p_brand AS page, CAST(p_partkey AS BIGINT) + 1 AS row_idx, p_name || '|' || p_size || '|' || CAST({_MONEY} AS VARCHAR) AS cells, CASE WHEN row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) = 1 THEN 'x' ELSE '' END AS stray, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT page, row_idx, 'old and new things' AS category, cells || CASE WHEN 1.0 / CASE WHEN n >= 3 THEN n ELSE n + 1 END >= 0.1 THEN '|' || stray ELSE '' END AS cells FROM r
UNION ALL SELECT page, 0, 'old and new things', 'old and new things||' || CASE WHEN 1.0 / (n + 1) >= 0.1 THEN '|' ELSE '' END FROM r WHERE n < 3 AND stray = 'x'""")
def q_table_rows(spark, sf_dir):
    """A page of parts below a title, with one stray cell in a column of its own."""
    p = table(spark, sf_dir, "part")
    first = p.groupBy("p_brand").agg(F.min("p_partkey").alias("first"))
    stray = F.when(F.col("p_partkey") == F.col("first"), "x").otherwise("")
    lines = p.join(first, "p_brand").select(F.col("p_brand").alias("page"), (F.col("p_partkey").cast("long") + 1).alias("row_idx"), F.array(F.col("p_name"), F.col("p_size").cast("string"), _price(F.col("p_retailprice")), stray).alias("cells"))
    titles = first.select(F.col("p_brand").alias("page"), F.lit(0).cast("long").alias("row_idx"), F.array(F.lit("old and new things"), F.lit(""), F.lit(""), F.lit("")).alias("cells"))
    return table_rows(lines.unionByName(titles)).withColumn("cells", F.array_join("cells", "|"))


@query("q_scanned_headers", "SELECT p_brand AS page, CAST(1 AS BIGINT) AS header_row, 'Name|Column 2|Price' AS headers FROM part GROUP BY p_brand HAVING min(p_partkey) % 2 = 0")
def q_scanned_headers(spark, sf_dir):
    """Pages of parts below a title; those whose first part is even have a header, the others none."""
    p = table(spark, sf_dir, "part").withColumn("page", F.col("p_brand"))
    first = p.groupBy("page").agg(F.min("p_partkey").alias("first"))
    row = lambda at, *cells: F.struct(F.lit(at).cast("long").alias("row_idx"), F.array(*cells).alias("cells"))
    no = F.lit("")
    tops = first.select("page", F.explode(F.array_compact(F.array(row(0, F.lit("Old and new things"), no, no), F.when(F.col("first") % 2 == 0, row(1, F.lit("Name"), no, F.lit("Price")))))).alias("r")).select("page", "r.*")
    lines = p.select("page", (F.col("p_partkey").cast("long") + 2).alias("row_idx"), F.array(F.col("p_name"), F.col("p_size").cast("string"), _price(F.col("p_retailprice"))).alias("cells"))
    return scanned_headers(tops.unionByName(lines)).withColumn("headers", F.array_join("headers", "|"))
