"""What the columns of many sheets mean: profiles in one aggregation, similarity to the columns of other sheets through
an inverted index, roles dealt out by a fold over each sheet's scored columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import parse_number

# Roles in the order in which they are dealt out, with the least score of each; words in a header that hint
# at a role, the first that fits counts; what a quantity rule looks like.
ROLES = {"product": 0.8, "price": 0.8, "code": 1.6, "qtyRule": 1.6, "qtyFrom": 1.6, "qtyTo": 1.6, "qty": 1.6, "category": 1.6}
HINTS = {
    "qtyRule": "rule|aturan|syarat",
    "qtyFrom": r"from|dari|min\b",
    "qtyTo": r"\bto\b|sampai|hingga|s\.?d\.?|max\b",
    "price": "price|harga|amount|nilai|rp|idr|cost",
    "code": "code|kode|sku|part|artikel|item ?no",
    "qty": "qty|quantity|jumlah|stok|stock",
    "category": "categor|kategori|group|kelompok|jenis",
    "product": "name|nama|product|produk|item|barang|deskripsi|description",
}
HINT_BONUS = 1.5
RULE_VALUE = r"(?i)^(>=|<=|>|<|=|between|antara)\s*\d*|^\s*\d+\s*[-–]\s*\d+\s*$"


def cells_long(matrix: DataFrame, headers: DataFrame) -> DataFrame:
    """(sheet, row_idx, col, header, v) of the filled cells of matrices (sheet, row_idx, cells); headers: sheet, headers.
    The names, one row a column, are broadcast: cells stay where they are."""
    one = matrix.select("sheet", "row_idx", F.posexplode("cells").alias("col", "v")).withColumn("v", F.trim("v")).where("v <> ''")
    names = headers.select("sheet", F.posexplode("headers").alias("col", "header"))
    return one.join(F.broadcast(names), ["sheet", "col"])


def profiles(cells: DataFrame) -> DataFrame:
    """One row a column of a sheet, from one aggregation over all cells."""
    v, n = F.col("v"), F.count("*").cast("double")
    number = parse_number(v).isNotNull() & v.rlike(r"\d") & (F.length(F.regexp_replace(v, r"[^\p{L}]", "")) <= 2)
    share = lambda test: F.count(F.when(test, 1)) / n
    out = cells.groupBy("sheet", "col", "header").agg(F.count("*").alias("n"), (F.count_distinct(F.upper("v")) / n).alias("uniqueness"), (F.sum(F.length("v")) / n).alias("mean_length"), share(number).alias("numeric_ratio"), share(v.rlike(RULE_VALUE)).alias("operator_ratio"))
    return out.withColumn("data_type", F.when(F.col("numeric_ratio") > 0.85, "numeric").when(F.col("numeric_ratio") < 0.15, "text").otherwise("mixed"))


def cross_similarity(cells: DataFrame, others: DataFrame) -> DataFrame:
    """(sheet, col, other_sheet, other_col, similarity): the share of a column's words (over two letters, with repeats) that
    occur in the other column.  Words meet in an inverted index, word to columns, so all pairs take one pass; the index, which
    grows with the cells, is shuffled and never broadcast."""
    words = lambda df: df.select("sheet", "col", F.explode(F.filter(F.split(F.upper("v"), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 2)).alias("word"))
    mine = words(cells).groupBy("sheet", "col", "word").agg(F.count("*").alias("n"))
    index = words(others).select(F.col("sheet").alias("other_sheet"), F.col("col").alias("other_col"), "word").distinct()
    total = mine.groupBy("sheet", "col").agg(F.sum("n").cast("double").alias("total"))
    met = mine.join(index.hint("merge"), "word").groupBy("sheet", "col", "other_sheet", "other_col").agg(F.sum("n").alias("met"))
    return met.join(total, ["sheet", "col"]).select("sheet", "col", "other_sheet", "other_col", (F.col("met") / F.col("total")).alias("similarity"))


def role_scores(stats: DataFrame) -> DataFrame:
    """stats (with cross, the similarity to the other file's products) plus scores: an array in the order of ROLES.
    Fixed values: what a role is judged by."""
    text = F.when(F.col("data_type") == "text", 1.0).otherwise(0.0)
    unique, length, number = F.col("uniqueness"), F.col("mean_length"), F.col("numeric_ratio")
    bonus = lambda test, x: F.when(test, x).otherwise(0.0)
    bound = number * 0.8 + bonus(length <= 6, 0.3)
    judged = {
        "product": text * (unique * 2 + F.least(length, F.lit(40.0)) / 40 + F.coalesce("cross", F.lit(0.0)) * 2),
        "price": number * 2 + unique * 0.3 + bonus(length.between(3, 15), 0.3),
        "code": bonus(F.col("data_type") != "numeric", 0.3) + unique * 1.5 + bonus(length.between(3, 15), 0.7),
        "qtyRule": F.col("operator_ratio") * 3, "qtyFrom": bound, "qtyTo": bound,
        "qty": number * 1.2 + bonus(length <= 6, 0.4),
        "category": text * ((1 - unique) * 1.5 + bonus(length <= 25, 0.3)),
    }
    hint = F.coalesce(*(F.when(F.col("header").rlike(f"(?i){p}"), r) for r, p in HINTS.items()), F.lit(""))
    return stats.withColumn("scores", F.array(*(judged[r] + bonus(hint == r, HINT_BONUS) for r in ROLES)))


def _dealt(columns: Column, given: Column, roles: list[str]) -> Column:
    """Deals roles out, one after the other: the best scored column that is free and not barred, ties to the first.
    columns: array of (col, scores, barred: roles it cannot take); given, result: array of (role, col, sure)."""

    def step(given: Column, role: Column) -> Column:
        k = F.array_position(F.array(*map(F.lit, ROLES)), role)
        free = F.filter(columns, lambda c: ~F.exists(given, lambda g: g["sure"] & (g["col"] == c["col"])) & ~F.array_contains(c["barred"], role))
        best = F.array_max(F.transform(free, lambda c: F.struct(F.element_at(c["scores"], k.cast("int")).alias("score"), (-c["col"]).alias("at"))))
        bar = F.element_at(F.array(*map(F.lit, ROLES.values())), k.cast("int"))
        entry = F.transform(F.array(best), lambda b: F.struct(role.alias("role"), (-b["at"]).alias("col"), (b["score"] >= bar).alias("sure")))
        return F.concat(given, F.filter(entry, lambda e: e["col"].isNotNull()))

    return F.aggregate(F.array(*map(F.lit, roles)), given, step)


def assign_roles(stats: DataFrame, cells: DataFrame) -> DataFrame:
    """(sheet, role, col, header) of every sheet.  A number column that keeps a fixed ratio to the price is no code."""
    none = F.array().cast("array<struct<role:string,col:int,sure:boolean>>")
    # a sheet has as many entries as columns
    by_sheet = stats.groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct("col", "scores", "data_type"))).alias("columns"))
    plain = F.transform("columns", lambda c: F.struct(c["col"].alias("col"), c["scores"].alias("scores"), F.array().cast("array<string>").alias("barred")))
    first = by_sheet.withColumn("given", _dealt(plain, none, ["product", "price"]))
    price = first.select("sheet", F.filter("given", lambda g: g["role"] == "price")[0]["col"].alias("price"))
    derived = price_derived_columns(cells, price).groupBy("sheet").agg(F.collect_list("col").alias("derived"))
    no_code = lambda c: F.when((c["data_type"] == "numeric") & F.array_contains("derived", c["col"]), F.array(F.lit("code"))).otherwise(F.array().cast("array<string>"))
    judged = F.transform("columns", lambda c: F.struct(c["col"].alias("col"), c["scores"].alias("scores"), no_code(c).alias("barred")))
    rest = first.join(derived, "sheet", "left").withColumn("derived", F.coalesce("derived", F.array().cast("array<int>")))
    every = rest.select("sheet", F.explode(_dealt(judged, F.col("given"), list(ROLES)[2:])).alias("g")).where("g.sure").select("sheet", "g.role", "g.col")
    return every.join(stats.select("sheet", "col", "header"), ["sheet", "col"]).select("sheet", "role", "col", "header")


def price_derived_columns(cells: DataFrame, price: DataFrame) -> DataFrame:
    """(sheet, col) of the columns whose ratio to the price column (sheet, price) crowds around its upper median: ratios in
    half of the rows and five at the least, three of five of them within 3 percent."""
    a = cells.select("sheet", "row_idx", "col", parse_number(F.col("v")).alias("x")).where("x is not null")
    b = a.join(price, "sheet").where("col = price").select("sheet", "row_idx", F.col("x").alias("p")).where("p <> 0")
    r = a.join(price, "sheet").where("col <> price").select("sheet", "row_idx", "col", "x").join(b, ["sheet", "row_idx"]).select("sheet", "col", (F.col("x") / F.col("p")).alias("r"))
    mid = r.groupBy("sheet", "col").agg(F.expr("percentile_disc(0.500000000001) WITHIN GROUP (ORDER BY r)").alias("m"), F.count("*").alias("n"))
    rows = cells.groupBy("sheet").agg(F.count_distinct("row_idx").alias("rows"))
    close = r.join(mid, ["sheet", "col"]).groupBy("sheet", "col", "m", "n").agg(F.count(F.when(F.abs(F.col("r") - F.col("m")) / F.col("m") < 0.03, 1)).alias("close"))
    return close.join(rows, "sheet").where((F.col("n") >= F.greatest(F.lit(5.0), F.col("rows") * 0.5)) & (F.col("m") != 0) & (F.col("close") / F.col("n") >= 0.6)).select("sheet", "col")


# -- columns of loose tables ----------------------------------------------------------------------
def date_ratios(cells: DataFrame) -> DataFrame:
    """(sheet, col, header, dates): the share of filled cells that read as a day, in one aggregation."""
    head = F.substring("v", 1, 10)
    # only cells that hold a format's sign are parsed: Spark's parser raises and catches an error for every cell that does not fit
    day = F.coalesce(*(F.when(F.contains(head, F.lit(sign)), F.try_to_timestamp(head, F.lit(f))) for f, sign in (("yyyy-MM-dd", "-"), ("dd/MM/yyyy", "/"), ("dd-MM-yyyy", "-"), ("d/M/yyyy", "/"))))
    return cells.groupBy("sheet", "col", "header").agg((F.count(day) / F.count("*")).alias("dates"))


def tracker_roles(columns: DataFrame, hints: dict[str, list[str]], date_role: str = "visit_date", least: float = 0.6) -> DataFrame:
    """(sheet, role, col): each role, in the order of ``hints``, takes the free column whose header holds its earliest
    keyword, ties to the first; without a date column the free one takes the role that reads as dates most often, in more than
    ``least`` of its cells.  columns: sheet, col, header, dates."""
    name = F.lower(F.trim("header"))
    ranks = [F.coalesce(*(F.when(F.contains(name, F.lit(w)), k) for k, w in enumerate(words)), F.lit(-1)) for words in hints.values()]
    by_sheet = columns.withColumn("ranks", F.array(*ranks)).groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct("col", "ranks", "dates"))).alias("columns"))  # as many as a sheet has columns
    none = F.array().cast("array<struct<role:string,col:int>>")
    roles = F.array(*(F.struct(F.lit(r).alias("role"), F.lit(k).alias("k")) for k, r in enumerate(hints)))
    free = lambda given: F.filter("columns", lambda c: ~F.exists(given, lambda g: g["col"] == c["col"]))

    def step(given: Column, role: Column) -> Column:
        fits = F.filter(free(given), lambda c: F.get(c["ranks"], role["k"]) >= 0)
        best = F.array_min(F.transform(fits, lambda c: F.struct(F.get(c["ranks"], role["k"]).alias("rank"), c["col"].alias("col"))))
        return F.concat(given, F.filter(F.array(F.struct(role["role"].alias("role"), best["col"].alias("col"))), lambda e: e["col"].isNotNull()))

    def with_date(given: Column) -> Column:
        best = F.array_max(F.transform(F.filter(free(given), lambda c: c["dates"] > least), lambda c: F.struct(c["dates"].alias("dates"), (-c["col"]).alias("at"))))
        entry = F.filter(F.array(F.struct(F.lit(date_role).alias("role"), (-best["at"]).alias("col"))), lambda e: e["col"].isNotNull())
        return F.when(F.exists(given, lambda g: g["role"] == date_role), given).otherwise(F.concat(given, entry))

    dealt = by_sheet.select("sheet", "columns", F.aggregate(roles, none, step).alias("given"))
    return dealt.select("sheet", F.explode(with_date(F.col("given"))).alias("g")).select("sheet", "g.role", "g.col")


def measure_column(columns: list[str], exact: list[str], keywords: list[str], exclude: list[str] = ()) -> str | None:
    """A column by its exact name (letters and digits, any case), else the first whose name holds a keyword and none of
    the excluded words."""
    tidy = lambda s: " ".join("".join(ch if ch.isalnum() else " " for ch in s.lower()).split())
    by_name = {tidy(c): c for c in columns}
    named = next((by_name[tidy(e)] for e in exact if tidy(e) in by_name), None)
    fits = (c for c in columns if not any(x.lower() in c.lower() for x in exclude) and any(k.lower() in c.lower() for k in keywords))
    return named or next(fits, None)
