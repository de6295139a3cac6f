"""Cleaning, tokens and similarity of product names as Column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import parse_number


# -- cleaners: three policies for missing text ------------------------------------------------
def blank_text(c: Column) -> Column:
    """Null becomes the empty string."""
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def null_text(c: Column) -> Column:
    """'', NONE, NAN and NULL become null."""
    t = F.trim(c.cast("string"))
    return F.when(F.upper(t).isin("", "NONE", "NAN", "NULL"), None).otherwise(t)


def unknown_text(c: Column, default: str = "Unknown") -> Column:
    return F.coalesce(null_text(c), F.lit(default))


def norm_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]", "")


def nfkc(c: Column) -> Column:
    """Unicode compatibility form; Spark has no function for it."""

    def normal(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFKC")

    return F.pandas_udf(normal, "string")(c)


# Noise classes that cleaning looks for, as Java patterns.
DETECTORS = {
    "invisible": r"[\p{Cf}\p{Cc}]",
    "multispace": r"\s{2,}",
    "trim": r"^\s|\s$",
    "dash": "[-–—]",
    "slash": r"[/\\]",
    "paren": r"[()\[\]{}]",
    "symbol": r"[^\p{L}\p{N}\s.,+%\-–—/\\()\[\]{}]",
    "case": r"(?s)^(?=.*[a-z])(?=.*[A-Z])",
    "dupword": r"(?i)\b(\S+)\s+\1\b",
}


def clean_value(c: Column, rules=(), unicode: bool = False) -> Column:
    """Normal form of a value; ``rules`` are names of DETECTORS that fired for the column."""
    v = F.coalesce(c, F.lit(""))
    if unicode:
        v = nfkc(v)
    if "invisible" in rules:
        v = F.regexp_replace(v, r"[\p{Cf}\p{Cc}]", "")
    for rule, pattern in (("dash", "[-–—]"), ("slash", r"[/\\]"), ("paren", r"[()\[\]{}]"), ("symbol", r"[^\p{L}\p{N}\s.,+%]")):
        if rule in rules:
            v = F.regexp_replace(v, pattern, " ")
    v = F.upper(F.trim(F.regexp_replace(v, r"\s{2,}", " ")))
    if "dupword" in rules:
        w = F.split(v, " ")
        v = F.array_join(F.filter(w, lambda x, i: (i == 0) | (x != F.element_at(w, F.greatest(i, F.lit(1))))), " ")
    return v


def tokenize(c: Column) -> Column:
    """Words, cut between digits and letters, without edge points and commas."""
    t = F.regexp_replace(c, r"(\d)(\p{L})", "$1 $2")
    t = F.regexp_replace(t, r"(\p{L})(\d)", "$1 $2")
    words = F.transform(F.split(t, r"\s+"), lambda x: F.regexp_replace(x, r"^[.,]+|[.,]+$", ""))
    return F.filter(words, lambda x: F.length(x) > 0)


def token_class(t: Column) -> Column:
    return F.when(t.rlike(r"^\d+([.,]\d+)?$"), "numeric").when(t.rlike(r"^\d+([.,]\d+)?[\p{L}%]+$"), "measure").when(t.rlike(r"\d") & t.rlike(r"\p{L}"), "code").otherwise("word")


def clean_code(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), r"[^\p{L}\p{N}]", "")


# -- generators of variants ---------------------------------------------------------------------
# Longest part of a variant cluster; fewest and most parts of an enumeration, longest part.
CLUSTER_PART = 6
LIST_PARTS = (2, 8)
LIST_PART = 12


def _let(value: Column, then) -> Column:
    """then(value), where value is computed once however often ``then`` uses it."""
    return F.transform(F.array(value), then)[0]


def slash_variants(c: Column) -> Column:
    """Array of names: 'EU 309 W/K' stands for two; dates and fractions stay.

    The name's last unbroken run of letters, digits and slashes is cut at the slashes; from the right, parts count as
    variants until one is empty or too long (of that one the last letters count)."""
    name = F.trim(c)

    def split_up(parts: Column) -> Column:
        bad = F.array_max(F.transform(parts, lambda x, k: F.when(~F.length(x).between(1, CLUSTER_PART), k)))
        whole = F.when(bad.isNull(), parts).otherwise(F.slice(parts, bad + 2, F.size(parts)))
        short = F.when(F.length(F.get(parts, bad)) > CLUSTER_PART, F.concat(F.array(F.right(F.get(parts, bad), F.lit(CLUSTER_PART))), whole)).otherwise(whole)
        return _let(short, named)

    def named(found: Column) -> Column:
        rest = F.left(name, F.length(name) - F.length(F.array_join(found, "/")))
        base = F.trim(F.regexp_replace(rest, r"[\s-]+$", ""))
        numbers = F.forall(found, lambda x: x.rlike(r"^\d+$"))
        return F.when((F.size(found) < 2) | (base == "") | numbers, F.array(name)).otherwise(F.transform(found, lambda x: F.concat_ws(" ", base, x)))

    return F.when(~F.contains(name, F.lit("/")), F.array(name)).otherwise(_let(F.split(F.regexp_extract(name, r"[\p{L}\p{N}/]+$", 0), "/"), split_up))


def candidate_names(c: Column) -> Column:
    """The name itself and, where it enumerates like parts, one name for each part."""
    name, sep, word = F.trim(c), r"\s*[/|]\s*", r"[\p{L}\d.,]+"

    def put(found: Column) -> Column:
        parts = F.split(found, sep)
        with_digit = F.size(F.filter(parts, lambda x: x.rlike(r"\d")))
        alike = with_digit.isin(0) | (with_digit == F.size(parts))
        short = F.array_max(F.transform(parts, F.length)) <= LIST_PART
        made = F.transform(parts, lambda x: F.overlay(name, x, F.instr(name, found), F.length(found)))
        return F.when((found != "") & F.size(parts).between(*LIST_PARTS) & alike & short, F.array_distinct(F.concat(F.array(name), made))).otherwise(F.array(name))

    return F.when(name == "", F.array().cast("array<string>")).when(~name.rlike("[/|]"), F.array(name)).otherwise(_let(F.regexp_extract(name, f"{word}({sep}{word})+", 0), put))


# -- similarity ---------------------------------------------------------------------------------
def lev_ratio(a: Column, b: Column) -> Column:
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / n)


def bigrams(c: Column) -> Column:
    return F.when(F.length(c) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2))))


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of character bigrams, counted as multisets."""
    x, y = bigrams(a), bigrams(b)
    shared = F.aggregate(F.array_distinct(x), F.lit(0), lambda s, g: s + F.least(F.size(F.filter(x, lambda t: t == g)), F.size(F.filter(y, lambda t: t == g))))
    return F.when(a == b, F.lit(1.0)).when((F.length(a) < 2) | (F.length(b) < 2), F.lit(0.0)).otherwise(2.0 * shared / (F.size(x) + F.size(y)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


# -- quantity rules -------------------------------------------------------------------------------
# What a rule's text says, in order of precedence.
QTY_WORDS = (("least", r">=|^>|(?i:min)"), ("most", r"<=|^<|(?i:max)"), ("span", "(?i)between|antara"))


def qty_rule(rule: Column, low: Column, high: Column) -> Column:
    """struct(min, max, label) of a price's quantity range, null where none is stated.

    The text gives an operator and up to two numbers, the columns stand in for missing ones; strict signs exclude
    their number by one step."""
    text = F.trim(F.coalesce(rule, F.lit("")))
    numbers = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\d+(?:[.,]\d+)?"), 0), parse_number), lambda x: x.isNotNull())
    op = F.coalesce(*(F.when(text.rlike(p), k) for k, p in QTY_WORDS), F.when(F.size(numbers) > 1, "span"), F.lit("columns"))
    parsed = F.struct(op.alias("op"), F.get(numbers, 0).alias("a"), F.get(numbers, 1).alias("b"), parse_number(low).alias("low"), parse_number(high).alias("high"))
    strict = lambda sign: F.when(text.rlike(rf"^{sign}\s*\d") & ~F.contains(text, F.lit(f"{sign}=")), 1.0).otherwise(0.0)

    def ends(q: Column) -> Column:
        lo = F.when(q["op"] == "least", F.coalesce(q["a"], q["low"]) + strict(">")).when(q["op"] == "span", F.coalesce(q["a"], q["low"])).when(q["op"] == "columns", q["low"])
        hi = F.when(q["op"] == "most", F.coalesce(q["a"], q["high"], q["low"]) - strict("<")).when(q["op"] == "span", F.coalesce(q["b"], q["high"])).when(q["op"] == "columns", q["high"])
        return F.struct(lo.cast("double").alias("min"), hi.cast("double").alias("max"), (q["op"] == "span").alias("span"))

    def labelled(r: Column) -> Column:
        shown = lambda x: F.regexp_replace(x.cast("string"), r"\.0$", "")
        lo, hi = r["min"], r["max"]
        label = F.when(hi.isNull(), F.concat(F.lit(">= "), shown(lo))).when(lo.isNull() & ~r["span"], F.concat(F.lit("<= "), shown(hi))).otherwise(F.concat(shown(F.coalesce(lo, F.lit(0.0))), F.lit(" - "), shown(hi)))
        return F.when(lo.isNotNull() | hi.isNotNull(), F.struct(lo.alias("min"), hi.alias("max"), label.alias("label")))

    said = (text != "") | F.coalesce(low, high).isNotNull()
    return F.when(said, _let(parsed, lambda q: _let(ends(q), labelled)))


def qty_in_range(qty: Column, low: Column, high: Column) -> Column:
    return (low.isNull() | (qty >= low)) & (high.isNull() | (qty <= high))


# -- classifiers ------------------------------------------------------------------------------------
# Gift types by words in the programme's name, in order.
GIFT_TYPES = (
    ("HELM|TUMBLER|KAOS|PAYUNG|BLENDER|RICE COOKER|OVEN|SPANDUK|GLOSSY|MUG|TOPI|JAKET", None, "Physical Gift"),
    ("CASHBACK", None, "Cashback Incentive"),
    ("SETAHUN|REWARD|PUSAKA|SUPER BOOSTER|DOUBLE REWARD|TAHUNAN|LOYALTY", None, "Loyalty Reward Program"),
    ("BANDUNG|TASIK|CIREBON|KARAWANG|BOGOR|JABAR|PARETO|NON PARETO|AREA|CABANG|DEPO", "DISCOUNT|DISKON|POTONGAN|DISC", "Channel Discount Program"),
    ("PROGRAM PIPA|PROGRAM FITTING|PROGRAM TALANG|PROGRAM PVC|PROGRAM HDPE|PROGRAM PIPAMAS", None, "Product Sales Program"),
    ("DISCOUNT|DISKON|POTONGAN|SUPPORT DISC|TAMBAHAN DISCOUNT|EXTRA DISCOUNT|DISC", None, "Discount Program"),
    ("SELL IN|SELL OUT|DISTRIBUTOR|DISTRIBUSI", None, "Distributor Program"),
)


def gift_type(c: Column) -> Column:
    name = F.upper(F.coalesce(c, F.lit("")))
    out = F.lit("Other Program")
    for first, second, label in reversed(GIFT_TYPES):
        test = name.rlike(first) if second is None else name.rlike(first) & name.rlike(second)
        out = F.when(test, label).otherwise(out)
    return out


# Brand words that stay in capitals.
UPPER_WORDS = ("WTP", "SC", "ICI")


def brand_label(c: Column) -> Column:
    """Display form of a brand: each word capitalised, some in capitals, separators kept; nothing gives 'Unknown'."""
    words = F.split(F.trim(c), r"(?<=[\s\-_/])|(?=[\s\-_/])")
    shown = F.transform(words, lambda x: F.when(F.upper(x).isin(*UPPER_WORDS), F.upper(x)).otherwise(F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 30)))))
    return F.when(F.coalesce(F.lower(F.trim(c)), F.lit("")).isin("", "nan", "none"), "Unknown").otherwise(F.array_join(shown, ""))


def join_list(c: Column, sep: str = ", ", most: int | None = None) -> Column:
    """Aggregate: distinct values without words for nothing, sorted, joined; null if there are none."""
    items = F.array_sort(F.collect_set(null_text(c)))
    return F.when(F.size(items) > 0, F.array_join(items if most is None else F.slice(items, 1, most), sep))
