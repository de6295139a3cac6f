"""Price audit: datasets from sheets, matching of vendor to internal rows, price comparison, anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_code, qty_in_range
from ..operators import matching
from ..operators.dataset import MappedColumn, dataset
from ..operators.joins import in_range
from ..operators.stage import saved, spread, staged, together
from ..sources.tables import VENDOR, catalogue, internal_sheet, learned_rules, table, vendor_list, vendor_sheet
from . import audit_sql as S
from .frames_sql import VEND
from .names import _NAMED, idf, named

QUERIES, SQL = {}, {}
EXTREME, Z_HIGH, Z_MEDIUM, MIN_GROUP = 80.0, 3.0, 2.0, 5
#: Classes of a match that prices are compared for, and the price that is compared.
ACCEPTED = ("MATCHED", "PARTIAL", "MANUAL")
PRICE = "basicPrice"
VENDOR_COLUMNS = [MappedColumn(k, n, f) for k, (n, f) in enumerate((("Product", "productName"), ("Item Code", "productCode"), ("Type", "productVariant"), ("Brand", "brand"), ("Remark", "description"), ("Price", PRICE), ("Qty", "qty")))]
INTERNAL_COLUMNS = [MappedColumn(k, n, f) for k, (n, f) in enumerate((("Name", "productName"), ("Code", "productCode"), ("Type", "productVariant"), ("Brand", "brand"), ("Text", "description"), ("Price", PRICE), ("Qty Rule", "qtyRule")))]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def sides(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    v, i = named(vendor_list(spark, sf_dir)), named(catalogue(spark, sf_dir))
    return v, i, idf(v, i)


def datasets(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Vendor and internal dataset rows (row_id is their key), written once.  The table is dealt out: few bytes, much cleaning."""
    parts = staged(spread(table(spark, sf_dir, "part"), "p_partkey"), "parts")
    made = lambda sheet, columns, name: staged(dataset(sheet(spark, sf_dir, parts), columns).withColumnRenamed("key", "row_id").withColumn("price", F.try_element_at("prices", F.lit(PRICE))).drop("data"), name)
    return tuple(together(lambda: made(vendor_sheet, VENDOR_COLUMNS, "vendor"), lambda: made(internal_sheet, INTERNAL_COLUMNS, "internal")))


def with_rules(spark, sf_dir) -> list:
    """Both datasets and the rules of earlier runs, made side by side."""
    return together(lambda: datasets(spark, sf_dir), lambda: staged(learned_rules(spark, sf_dir), "rules"))


_IDF = S.IDF


@query("q_candidates_top60", f"WITH {_NAMED}, {_IDF}, a AS (SELECT row_id AS v, unnest(list_distinct(tokens)) AS token FROM nv), b AS (SELECT row_id AS i, unnest(list_distinct(tokens)) AS token FROM ni), p AS (SELECT v, i, sum(w) AS weight FROM a JOIN b USING (token) JOIN wt USING (token) GROUP BY 1, 2), r AS (SELECT v, i, CAST(weight AS DOUBLE) AS weight, CAST(row_number() OVER (PARTITION BY v ORDER BY weight DESC, i) AS INTEGER) AS place FROM p) SELECT * FROM r WHERE place <= 60")
def candidates_top60(spark, sf_dir):
    return matching.candidates(*sides(spark, sf_dir)).select("v", "i", F.col("weight").cast("double").alias("weight"), "place")


_ROWS = "row_id AS key, name, norm, array_to_string(tokens, '|') AS tokens, code, variant, brand, price"


@query("q_dataset_rows", f"WITH {S.DATA} SELECT 'vendor' AS side, {_ROWS}, qty, NULL::DOUBLE AS qty_min, NULL::DOUBLE AS qty_max, NULL AS qty_label, descr AS description FROM nv UNION ALL SELECT 'internal', {_ROWS}, NULL, qty_min, qty_max, qty_label, descr FROM ni")
def dataset_rows(spark, sf_dir):
    """Both sheets as dataset rows: blank rows gone, variants apart, prices and quantity ranges read."""
    v, i = datasets(spark, sf_dir)
    cols = [F.col("row_id").alias("key"), "name", "norm", F.array_join("tokens", "|").alias("tokens"), "code", "variant", "brand", "price", "qty", "qty_min", "qty_max", "qty_label", "description"]
    return v.select(F.lit("vendor").alias("side"), *cols).unionByName(i.select(F.lit("internal").alias("side"), *cols))


_R6 = lambda c: f"round({c}, 6) AS {c}"


@query("q_match_scores", f"WITH {', '.join((S.DATA, S.IDF, S.RULES, S.READ, S.SCORES))} SELECT v, i, place, {_R6('score')}, {', '.join(f'round(coalesce(s_{n}, 0), 6) AS s_{n}' for n in matching.SIGNALS)} FROM pr")
def match_scores(spark, sf_dir):
    """Score and signals of every candidate pair of the vendor rows that no rule settles."""
    (v, i), rules = with_rules(spark, sf_dir)
    w, (_, rest) = together(lambda: staged(idf(v, i), "weights"), lambda: matching.unruled(v, i, rules, VENDOR))
    shown = lambda x: F.struct(x["i"].alias("i"), x["place"].alias("place"), *(F.round(x[c], 6).alias(c) for c in ("score", *(f"s_{n}" for n in matching.SIGNALS))))
    return matching.scored(rest, i, w, lambda listed: F.transform(listed, shown)).select("v", F.inline("listed"))


@query("q_rule_precedence", f"WITH {S.DATA}, {S.RULES} SELECT v, i FROM hit")
def rule_precedence(spark, sf_dir):
    """Vendor rows that a rule of an earlier run settles: clashing rules, the most special wins."""
    v, i = datasets(spark, sf_dir)
    return matching.rule_hits(v, learned_rules(spark, sf_dir), i, VENDOR)


def learned_pairs(spark, sf_dir) -> DataFrame:
    """Approved pairs of earlier runs: every 40th vendor row by name, every 25th by code."""
    v = named(vendor_list(spark, sf_dir))
    return v.where("row_id % 40 = 0").select(F.col("norm").alias("vendor_name"), F.lit(None).cast("string").alias("vendor_code"), F.col("row_id").alias("i")).unionByName(v.where("row_id % 25 = 0").select(F.lit(None).cast("string").alias("vendor_name"), clean_code(F.col("code")).alias("vendor_code"), F.col("row_id").alias("i")))


@query("q_master_lookup", f"WITH {_NAMED}, n AS (SELECT norm, min(row_id) AS i FROM nv WHERE row_id % 40 = 0 GROUP BY 1), c AS (SELECT code, min(row_id) AS i FROM nv WHERE row_id % 25 = 0 AND code IS NOT NULL GROUP BY 1) SELECT nv.row_id AS v, coalesce(n.i, c.i) AS i FROM nv LEFT JOIN n ON nv.norm = n.norm LEFT JOIN c ON nv.code = c.code WHERE coalesce(n.i, c.i) IS NOT NULL")
def master_lookup(spark, sf_dir):
    return matching.master_lookup(named(vendor_list(spark, sf_dir)), learned_pairs(spark, sf_dir))


def audited(spark, sf_dir, fresh: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vendor rows, internal rows and the results of a matching run, as a session keeps them: prices, review, statistics
    and export read the saved results of the run."""

    def run():
        (v, i), rules = with_rules(spark, sf_dir)
        return v, i, staged(matching.match_run(v, i, idf(v, i), rules, VENDOR), "match-results")

    return saved(table(spark, sf_dir, "part"), "match-session", run, fresh)


@query("q_match_results", f"WITH {S.RUN} SELECT v, i, round(score, 4) AS score, round(margin, 4) AS margin, status, confidence, source, candidates FROM rs")
def q_match_results(spark, sf_dir):
    """A matching run, from the sheets to the classes."""
    return audited(spark, sf_dir, fresh=True)[2].select("v", "i", F.round("score", 4).alias("score"), F.round("margin", 4).alias("margin"), "status", "confidence", "source", "candidates")


def price_items(vendor: DataFrame, internal: DataFrame, results: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """All vendor rows, matched or not, and the internal rows whose name nobody matched.  Where the matched name has
    prices graded by quantity, the first grade that holds the vendor's quantity gives the price."""
    accepted = results.where(F.col("status").isin(*ACCEPTED) & F.col("i").isNotNull()).select("v", "i")
    v = vendor.select(F.col("row_id").alias("v"), F.coalesce("name", F.lit("")).alias("vendor_label"), F.col("price").alias("vendor_price"), "qty")
    i = internal.select(F.col("row_id").alias("i"), F.coalesce("name", F.lit("")).alias("name"), F.col("price").alias("own_price"), "norm", "qty_label")
    left = v.join(accepted, "v", "left").join(i, "i", "left")
    grades = internal.where("qty_min is not null or qty_max is not null").select("norm", F.col("row_id").alias("g"), F.col("price").alias("g_price"), F.col("qty_label").alias("g_label"), "qty_min", "qty_max")
    hit = left.where("qty is not null").select("v", "norm", "qty").join(grades, "norm").where(qty_in_range(F.col("qty"), F.col("qty_min"), F.col("qty_max")))
    graded = hit.groupBy("v").agg(F.min(F.struct("g", "g_price", "g_label")).alias("grade"))
    label = lambda name, grade: F.concat(name, F.when(grade.isNotNull(), F.concat(F.lit(" ("), grade, F.lit(")"))).otherwise(""))
    rows = left.join(graded, "v", "left")
    of_grade = F.col("grade").isNotNull()
    rows = rows.withColumns({"internal_price": F.when(of_grade, F.col("grade.g_price")).otherwise(F.col("own_price")), "shown": F.when(of_grade, F.col("grade.g_label")).otherwise(F.col("qty_label"))})
    diff = F.col("vendor_price") - F.col("internal_price")
    pct = F.try_divide(diff, F.col("internal_price")) * 100
    close = F.when(pct.isNotNull(), F.abs(pct) <= tolerance).otherwise(diff == 0)
    status = F.when(F.col("i").isNull(), "NOT_IN_INTERNAL").when(diff.isNull(), "MISSING").when(close | (diff == 0), "SAME").when(diff > 0, "HIGHER").otherwise("LOWER")
    items = rows.select("v", "i", "vendor_label", F.when(F.col("i").isNull(), "").otherwise(label(F.col("name"), F.col("shown"))).alias("internal_label"), "vendor_price", "internal_price", F.round(diff, 2).alias("diff"), F.round(pct, 2).alias("diff_pct"), status.alias("status"))
    matched = left.where("norm is not null").select("norm").distinct()
    no = lambda kind: F.lit(None).cast(kind)
    rest = i.join(matched, "norm", "left_anti").select(no("long").alias("v"), "i", F.lit("").alias("vendor_label"), label(F.col("name"), F.col("qty_label")).alias("internal_label"), no("double").alias("vendor_price"), F.col("own_price").alias("internal_price"), no("double").alias("diff"), no("double").alias("diff_pct"), F.lit("NOT_IN_VENDOR").alias("status"))
    return items.unionByName(rest)


_ITEMS = S.ITEMS


def items_of(spark, sf_dir) -> DataFrame:
    return price_items(*audited(spark, sf_dir))


@query("q_price_validation", f"WITH {_ITEMS} SELECT * FROM it")
def price_validation(spark, sf_dir):
    return items_of(spark, sf_dir)


def ranged_prices(spark, sf_dir) -> DataFrame:
    """Three quantity bands for every part: up to 9, 10 to 29, 30 and more."""
    c = catalogue(spark, sf_dir)
    bands = F.array(*(F.struct(F.lit(n).alias("band"), F.lit(lo).cast("double").alias("qty_min"), F.lit(hi).cast("double").alias("qty_max"), F.lit(k).cast("decimal(3,2)").alias("factor")) for n, lo, hi, k in ((0, None, 9.0, 1.0), (1, 10.0, 29.0, 0.9), (2, 30.0, None, 0.8))))
    return c.select(F.col("row_id"), "price", F.explode(bands).alias("b")).select("row_id", F.col("b.band").alias("band"), F.col("b.qty_min").alias("qty_min"), F.col("b.qty_max").alias("qty_max"), (F.col("price") * F.col("b.factor")).cast("decimal(18,2)").alias("band_price"))


@query("q_qty_range_price", f"WITH {VEND}, b AS (SELECT * FROM (VALUES (0, NULL, 9.0, 1.00::DECIMAL(3,2)), (1, 10.0, 29.0, 0.90::DECIMAL(3,2)), (2, 30.0, NULL, 0.80::DECIMAL(3,2))) t(band, lo, hi, f)), c AS (SELECT p_partkey AS row_id, band, lo, hi, CAST(CAST(p_retailprice AS DECIMAL(18,2)) * f AS DECIMAL(18,2)) AS band_price FROM part, b) SELECT v.row_id, v.qty, c.band, CAST(band_price AS DOUBLE) AS band_price, CAST(v.price AS DOUBLE) AS price, CAST(v.price - band_price AS DOUBLE) AS diff FROM vend v JOIN c ON v.row_id = c.row_id AND (lo IS NULL OR qty >= lo) AND (hi IS NULL OR qty <= hi) QUALIFY row_number() OVER (PARTITION BY v.row_id ORDER BY band) = 1")
def qty_range_price(spark, sf_dir):
    """Vendor price against the internal price of the band that holds the quantity (the first, if several do)."""
    best = in_range(vendor_list(spark, sf_dir).select("row_id", "qty", "price"), ranged_prices(spark, sf_dir), "row_id", "qty", "qty_min", "qty_max", "band")
    return best.select("row_id", "qty", "band", F.col("band_price").cast("double").alias("band_price"), F.col("price").cast("double").alias("price"), (F.col("price") - F.col("band_price")).cast("double").alias("diff"))


def anomalies(items: DataFrame, category: str | None = None) -> DataFrame:
    """Items with z-score and severity against their category, if at least two have enough members, else all."""
    pct = F.col("diff_pct")
    whole = items.agg(F.avg("diff_pct").alias("g_mean"), F.stddev_pop("diff_pct").alias("g_sd"))  # one row
    df = items.join(F.broadcast(whole))
    mean, sd = F.col("g_mean"), F.col("g_sd")
    if category is not None:
        by = items.where(pct.isNotNull() & (F.trim(category) != "")).groupBy(category).agg(F.avg("diff_pct").alias("c_mean"), F.stddev_pop("diff_pct").alias("c_sd"), F.count("*").alias("c_n")).where(F.col("c_n") >= MIN_GROUP)
        enough = by.agg((F.count("*") >= 2).alias("by_category"))  # one row
        df = df.join(by, category, "left").join(F.broadcast(enough))
        use = F.col("by_category") & F.col("c_n").isNotNull()
        mean, sd = F.when(use, F.col("c_mean")).otherwise(mean), F.when(use, F.col("c_sd")).otherwise(sd)
    z = F.when((sd > 0) & pct.isNotNull(), (pct - mean) / sd)
    severity = F.when(pct.isNull(), "none").when(F.abs(pct) >= EXTREME, "high").when(F.abs(z) >= Z_HIGH, "high").when(F.abs(z) >= Z_MEDIUM, "medium").otherwise("none")
    return df.withColumns({"z": z, "severity": severity}).select(*items.columns, "z", "severity")


_ANOM = f"{_ITEMS}, st AS (SELECT avg(diff_pct) AS m, stddev_pop(diff_pct) AS sd FROM it), an AS (SELECT it.*, CASE WHEN sd > 0 THEN (diff_pct - m) / sd END AS z, CASE WHEN diff_pct IS NULL THEN 'none' WHEN abs(diff_pct) >= 80 THEN 'high' WHEN sd > 0 AND abs((diff_pct - m) / sd) >= 3 THEN 'high' WHEN sd > 0 AND abs((diff_pct - m) / sd) >= 2 THEN 'medium' ELSE 'none' END AS severity FROM it, st)"


@query("q_anomalies", f"WITH {_ANOM} SELECT v, i, status, severity, round(z, 6) AS z FROM an WHERE v IS NOT NULL")
def q_anomalies(spark, sf_dir):
    return anomalies(staged(items_of(spark, sf_dir), "price-items")).where("v is not null").select("v", "i", "status", "severity", F.round("z", 6).alias("z"))


@query("q_anomaly_top15", f"WITH {_ANOM} SELECT v, diff_pct, severity FROM an WHERE severity <> 'none' ORDER BY abs(diff_pct) DESC, v LIMIT 15")
def anomaly_top15(spark, sf_dir):
    """The fifteen largest anomalies (a report's length)."""
    return anomalies(staged(items_of(spark, sf_dir), "price-items")).where("severity <> 'none'").orderBy(F.desc(F.abs("diff_pct")), "v").limit(15).select("v", "diff_pct", "severity")
