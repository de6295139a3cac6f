"""Product names: tokens, weights, similarity, quantity rules, profiling of loose sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numeric import parse_number
from ..operators.profile import cleaning_rules, column_stats, header_row
from ..sources.tables import catalogue, table, vendor_list
from .frames_sql import CAT, VEND

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


RULES = ("dash", "slash", "paren", "symbol", "multispace")


def named(df: DataFrame) -> DataFrame:
    """Rows with their normal name and tokens."""
    norm = T.clean_value(F.col("name"), RULES)
    return df.withColumn("norm", norm).withColumn("tokens", T.tokenize(F.col("norm")))


def _norm(c):
    return f"upper(trim(regexp_replace(regexp_replace(regexp_replace({c}, '[-–—]', ' ', 'g'), '[^\\p{{L}}\\p{{N}}\\s.,+%]', ' ', 'g'), '\\s{{2,}}', ' ', 'g')))"


def _tokens(c):
    split = f"regexp_replace(regexp_replace({c}, '(\\d)(\\p{{L}})', '\\1 \\2', 'g'), '(\\p{{L}})(\\d)', '\\1 \\2', 'g')"
    return f"list_filter(list_transform(regexp_split_to_array({split}, '\\s+'), lambda x: regexp_replace(x, '^[.,]+|[.,]+$', '', 'g')), lambda x: length(x) > 0)"


_NAMED = f"{CAT}, {VEND}, nv AS (SELECT *, {_tokens('norm')} AS tokens FROM (SELECT *, {_norm('name')} AS norm FROM vend)), ni AS (SELECT *, {_tokens('norm')} AS tokens FROM (SELECT *, {_norm('name')} AS norm FROM cat))"


@query("q_tokens", f"WITH {_NAMED} SELECT row_id, norm, array_to_string(tokens, '|') AS tokens, len(tokens) AS n FROM nv")
def tokens(spark, sf_dir):
    return named(vendor_list(spark, sf_dir)).select("row_id", "norm", F.array_join("tokens", "|").alias("tokens"), F.size("tokens").cast("long").alias("n"))


@query("q_token_class", f"WITH {_NAMED}, t AS (SELECT unnest(tokens) AS token FROM nv) SELECT token, CASE WHEN regexp_matches(token, '^\\d+([.,]\\d+)?$') THEN 'numeric' WHEN regexp_matches(token, '^\\d+([.,]\\d+)?[\\p{{L}}%]+$') THEN 'measure' WHEN regexp_matches(token, '\\d') AND regexp_matches(token, '\\p{{L}}') THEN 'code' ELSE 'word' END AS class, count(*) AS n FROM t GROUP BY 1, 2")
def token_class(spark, sf_dir):
    t = named(vendor_list(spark, sf_dir)).select(F.explode("tokens").alias("token"))
    return t.groupBy("token", T.token_class(F.col("token")).alias("class")).agg(F.count("*").alias("n"))


def idf(*frames: DataFrame) -> DataFrame:
    """(token, df, idf): ln(1 + N / df) over the rows of all frames, scaled to mean 1."""
    rows = frames[0].select("tokens")
    for f in frames[1:]:
        rows = rows.unionByName(f.select("tokens"))
    n = rows.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))  # one row
    df = rows.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    raw = df.join(F.broadcast(n)).withColumn("raw", F.log(1 + F.col("n") / F.col("df")))
    mean = raw.agg(F.avg("raw").alias("mean"))  # one row
    return raw.join(F.broadcast(mean)).select("token", "df", (F.col("raw") / F.col("mean")).alias("idf"))


@query("q_idf", f"WITH {_NAMED}, r AS (SELECT tokens FROM nv UNION ALL SELECT tokens FROM ni), d AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(tokens)) AS token FROM r) GROUP BY 1), w AS (SELECT *, ln(1 + (SELECT count(*) FROM r) / CAST(df AS DOUBLE)) AS raw FROM d) SELECT token, df, round(raw / avg(raw) OVER (), 6) AS idf FROM w")
def q_idf(spark, sf_dir):
    return idf(named(vendor_list(spark, sf_dir)), named(catalogue(spark, sf_dir))).select("token", "df", F.round("idf", 6).alias("idf"))


@query("q_slash_variants", "WITH s AS (SELECT p_partkey AS row_id, p_name || ' ' || CAST(p_size AS VARCHAR) || CASE WHEN p_partkey % 3 = 0 THEN ' W/K' WHEN p_partkey % 3 = 1 THEN ' 1/2' ELSE '-A/B/C' END AS name FROM part) SELECT row_id, unnest(CASE row_id % 3 WHEN 0 THEN [regexp_replace(name, ' W/K$', ' W'), regexp_replace(name, ' W/K$', ' K')] WHEN 1 THEN [name] ELSE [regexp_replace(name, '-A/B/C$', ' A'), regexp_replace(name, '-A/B/C$', ' B'), regexp_replace(name, '-A/B/C$', ' C')] END) AS variant FROM s")
def slash_variants(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.when(k % 3 == 0, " W/K").when(k % 3 == 1, " 1/2").otherwise("-A/B/C"))
    return table(spark, sf_dir, "part").select(k.alias("row_id"), F.explode(T.slash_variants(name)).alias("variant"))


@query("q_code_clean", f"WITH {CAT} SELECT row_id, regexp_replace(upper(code), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS code FROM cat")
def code_clean(spark, sf_dir):
    return catalogue(spark, sf_dir).select("row_id", T.clean_code(F.col("code")).alias("code"))


_PAIRS = f"{_NAMED}, pr AS (SELECT v.row_id, v.norm AS a, i.norm AS b, v.tokens AS ta, i.tokens AS tb FROM nv v JOIN ni i ON v.row_id = i.row_id)"


def true_pairs(spark, sf_dir) -> DataFrame:
    v, i = named(vendor_list(spark, sf_dir)), named(catalogue(spark, sf_dir))
    return v.select("row_id", F.col("norm").alias("a"), F.col("tokens").alias("at")).join(i.select("row_id", F.col("norm").alias("b"), F.col("tokens").alias("bt")), "row_id")


@query("q_lev_ratio", f"WITH {_PAIRS} SELECT row_id, 1.0::DOUBLE - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) AS ratio FROM pr")
def lev_ratio(spark, sf_dir):
    return true_pairs(spark, sf_dir).select("row_id", T.lev_ratio(F.col("a"), F.col("b")).alias("ratio"))


_BI = "list_transform(generate_series(1, length({0}) - 1), lambda i: substring({0}, CAST(i AS INTEGER), 2))"


@query("q_dice", f"WITH {_PAIRS}, x AS (SELECT row_id, a, b, unnest({_BI.format('a')}) AS g FROM pr), y AS (SELECT row_id, unnest({_BI.format('b')}) AS g FROM pr), xc AS (SELECT row_id, g, count(*) AS n FROM x GROUP BY 1, 2), yc AS (SELECT row_id, g, count(*) AS n FROM y GROUP BY 1, 2), s AS (SELECT xc.row_id, sum(least(xc.n, yc.n)) AS shared FROM xc JOIN yc ON xc.row_id = yc.row_id AND xc.g = yc.g GROUP BY 1) SELECT pr.row_id, CASE WHEN a = b THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * coalesce(shared, 0)::DOUBLE / (length(a) - 1 + length(b) - 1) END AS dice FROM pr LEFT JOIN s ON pr.row_id = s.row_id")
def dice(spark, sf_dir):
    return true_pairs(spark, sf_dir).select("row_id", T.dice(F.col("a"), F.col("b")).alias("dice"))


@query("q_jaccard", f"WITH {_PAIRS} SELECT row_id, len(list_distinct(list_intersect(ta, tb)))::DOUBLE / len(list_distinct(list_concat(ta, tb))) AS jaccard FROM pr")
def jaccard(spark, sf_dir):
    return true_pairs(spark, sf_dir).select("row_id", T.jaccard(F.col("at"), F.col("bt")).alias("jaccard"))


def otsu(scores: DataFrame, col: str, fallback: float = 0.5) -> DataFrame:
    """One row (threshold): largest between-class variance of a 40-bin histogram, first of equals."""
    bins = scores.select(F.greatest(F.lit(0), F.least(F.lit(39), F.floor(F.col(col) * 40))).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    w, every = W.orderBy("bin").rowsBetween(W.unboundedPreceding, 0), W.partitionBy()
    b = bins.withColumns({"wb": F.sum("n").over(w), "sb": F.sum(F.col("bin") * F.col("n")).over(w), "all": F.sum("n").over(every), "sum": F.sum(F.col("bin") * F.col("n")).over(every)})
    wf = F.col("all") - F.col("wb")
    diff = F.col("sb") / F.col("wb") - F.try_divide((F.col("sum") - F.col("sb")).cast("double"), wf.cast("double"))
    b = b.withColumn("between", F.when(wf > 0, F.col("wb") * wf * diff * diff))
    best = b.agg(F.max("all").alias("all"), F.min_by("bin", F.struct(-F.coalesce(F.col("between"), F.lit(-1.0)), "bin")).alias("bin"), F.max("between").alias("most"))
    return best.select(F.when(F.coalesce(F.col("all"), F.lit(0)) < 4, fallback).when(F.col("most").isNull(), (fallback * 40 + 1) / 40).otherwise((F.col("bin") + 1) / 40).alias("threshold"))


@query("q_otsu", f"WITH {_PAIRS}, s AS (SELECT 1.0::DOUBLE - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) AS ratio FROM pr), h AS (SELECT greatest(0, least(39, CAST(floor(ratio * 40) AS INTEGER))) AS bin, count(*) AS n FROM s GROUP BY 1), c AS (SELECT *, CAST(sum(n) OVER w AS DOUBLE) AS wb, CAST(sum(bin * n) OVER w AS DOUBLE) AS sb, CAST(sum(n) OVER () AS DOUBLE) AS al, CAST(sum(bin * n) OVER () AS DOUBLE) AS su FROM h WINDOW w AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), v AS (SELECT bin, wb * (al - wb) * (sb / wb - (su - sb) / (al - wb)) * (sb / wb - (su - sb) / (al - wb)) AS between_var FROM c WHERE al > wb) SELECT (bin + 1)::DOUBLE / 40 AS threshold FROM v ORDER BY between_var DESC, bin LIMIT 1")
def q_otsu(spark, sf_dir):
    return otsu(lev_ratio(spark, sf_dir), "ratio")


_RULES_SQL = "CASE p_partkey % 5 WHEN 0 THEN '>= ' || CAST(p_size AS VARCHAR) WHEN 1 THEN 'between ' || CAST(p_size AS VARCHAR) || ' and ' || CAST(p_size + 9 AS VARCHAR) WHEN 2 THEN '<= ' || CAST(p_size AS VARCHAR) WHEN 3 THEN CAST(p_size AS VARCHAR) || ' - ' || CAST(p_size + 4 AS VARCHAR) ELSE '' END"


@query("q_qty_rules", f"WITH r AS (SELECT p_partkey AS row_id, {_RULES_SQL} AS rule, p_size FROM part) SELECT row_id, rule, CASE row_id % 5 WHEN 2 THEN NULL ELSE p_size::DOUBLE END AS qty_min, CASE row_id % 5 WHEN 1 THEN (p_size + 9)::DOUBLE WHEN 2 THEN p_size::DOUBLE WHEN 3 THEN (p_size + 4)::DOUBLE END AS qty_max, CASE row_id % 5 WHEN 2 THEN '<= ' || p_size WHEN 1 THEN p_size || ' - ' || (p_size + 9) WHEN 3 THEN p_size || ' - ' || (p_size + 4) ELSE '>= ' || p_size END AS label FROM r")
def qty_rules(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    rule = F.when(k % 5 == 0, F.concat(F.lit(">= "), s)).when(k % 5 == 1, F.concat(F.lit("between "), s, F.lit(" and "), (F.col("p_size") + 9).cast("string"))).when(k % 5 == 2, F.concat(F.lit("<= "), s)).when(k % 5 == 3, F.concat(s, F.lit(" - "), (F.col("p_size") + 4).cast("string"))).otherwise("")
    low = F.when(k % 5 == 4, s)
    return table(spark, sf_dir, "part").select(k.alias("row_id"), rule.alias("rule"), T.qty_rule(rule, low, F.lit(None).cast("string")).alias("q")).select("row_id", "rule", F.col("q.min").alias("qty_min"), F.col("q.max").alias("qty_max"), F.col("q.label").alias("label"))


@query("q_parse_numeric", "SELECT p_partkey AS row_id, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size * 1000 AS DOUBLE) WHEN 1 THEN CAST(p_size + 1000 AS DOUBLE) + 0.25 WHEN 2 THEN -CAST(p_size AS DOUBLE) ELSE NULL END AS value FROM part")
def parse_numeric(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    written = F.when(k % 4 == 0, F.concat(F.lit("Rp "), s.cast("string"), F.lit(".000"))).when(k % 4 == 1, F.concat(F.lit("1."), F.lpad(s.cast("string"), 3, "0"), F.lit(",25"))).when(k % 4 == 2, F.concat(F.lit("("), s.cast("string"), F.lit(")"))).otherwise("-")
    return table(spark, sf_dir, "part").select(k.alias("row_id"), parse_number(written).alias("value"))


def sheet(spark, sf_dir) -> DataFrame:
    """The vendor list as a string matrix with two title rows and a header."""
    v = vendor_list(spark, sf_dir)
    cells = F.array("name", F.coalesce("code", F.lit("")), F.col("price").cast("string"), F.col("qty").cast("string"))
    data = v.select((F.col("row_id") + 3).alias("row_idx"), cells.alias("cells"))
    head = spark.createDataFrame([(0, ["PRICE LIST", "", "", ""]), (1, ["", "", "", ""]), (2, ["Product", "Code", "Price", "Qty"])], "row_idx long, cells array<string>")
    return head.unionByName(data)


@query("q_sheet_header", "SELECT 2 AS header_row, unnest(['Product', 'Code', 'Price', 'Qty']) AS column_name, CAST(unnest(range(4)) AS INTEGER) AS position")
def sheet_header(spark, sf_dir):
    h, names = header_row(sheet(spark, sf_dir))
    return spark.createDataFrame([(h, n, i) for i, n in enumerate(names)], "header_row int, column_name string, position int")


@query("q_column_stats", f"""WITH {VEND}, c AS (SELECT unnest([struct_pack(k := 'name', v := name), struct_pack(k := 'code', v := coalesce(code, '')), struct_pack(k := 'price', v := CAST(price AS VARCHAR))]) AS x FROM vend), f AS (SELECT x.k AS column_name, trim(x.v) AS v FROM c WHERE trim(x.v) <> '')
SELECT column_name, count(*) AS n, CAST(count(DISTINCT lower(v)) AS DOUBLE) / count(*) AS uniqueness, CAST(sum(length(v)) AS DOUBLE) / count(*) AS mean_length, CAST(count(*) FILTER (regexp_matches(v, '^[A-Za-z]{{0,2}}[0-9.]+$')) AS DOUBLE) / count(*) AS numeric_ratio, 1 - CAST(count(DISTINCT lower(v)) AS DOUBLE) / count(*) AS duplicate_ratio FROM f GROUP BY 1""")
def q_column_stats(spark, sf_dir):
    v = vendor_list(spark, sf_dir).select("name", F.coalesce("code", F.lit("")).alias("code"), F.col("price").cast("string").alias("price"))
    return column_stats(v).select("column_name", "n", "uniqueness", "mean_length", "numeric_ratio", "duplicate_ratio")


@query("q_cleaning_rules", f"WITH {VEND} SELECT * FROM (SELECT 'multispace' AS rule, count(*) FILTER (regexp_matches(name, '\\s{{2,}}')) AS occurrences FROM vend UNION ALL SELECT 'dash', count(*) FILTER (regexp_matches(name, '[-–—]')) FROM vend UNION ALL SELECT 'symbol', count(*) FILTER (regexp_matches(name, '[^\\p{{L}}\\p{{N}}\\s.,+%\\-–—/\\\\()\\[\\]{{}}]')) FROM vend UNION ALL SELECT 'case', count(*) FILTER (regexp_matches(name, '[a-z]') AND regexp_matches(name, '[A-Z]')) FROM vend) WHERE occurrences > 0")
def q_cleaning_rules(spark, sf_dir):
    return cleaning_rules(vendor_list(spark, sf_dir), "name").where(F.col("rule").isin("multispace", "dash", "symbol", "case"))
