from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import numeric, rules, text
from tallyspark.functions.dates import overlap_days, parse_date


def one(spark, *cols):
    return spark.range(1).select(*cols).collect()[0]


def rows(spark, values, schema):
    return spark.createDataFrame(values, schema)


def test_slash_variants(spark):
    want = {"EU 309 W/K": ["EU 309 W", "EU 309 K"], "EU 309 W/K/L": ["EU 309 W", "EU 309 K", "EU 309 L"], "ABC X1/Y2": ["ABC X1", "ABC Y2"], "EY1511-K/W": ["EY1511 K", "EY1511 W"]} | {s: [s] for s in ("PIPA PVC 1/2", "REPORT 10/07/2026", "W/K", "PLAIN NAME")}
    df = rows(spark, [(k,) for k in want], "s string")
    assert {r.s: r.v for r in df.select("s", text.slash_variants(F.col("s")).alias("v")).collect()} == want


def test_qty_rules(spark):
    cases = [((">= 10", None, None), (10, None, ">= 10")), ((">=", "10", None), (10, None, ">= 10")), (("between 5 and 9", None, None), (5, 9, "5 - 9")), (("between", "5", "9"), (5, 9, "5 - 9")), (("<= 4", None, None), (None, 4, "<= 4")), ((None, "1", "4"), (1, 4, "1 - 4")), ((None, "10", None), (10, None, ">= 10")), (("", None, None), None), (("> 10", None, None), (11, None, ">= 11")), (("< 10", None, None), (None, 9, "<= 9"))]
    df = rows(spark, [c for c, _ in cases], "r string, a string, b string")
    got = [r.q and tuple(r.q) for r in df.select(text.qty_rule(F.col("r"), F.col("a"), F.col("b")).alias("q")).collect()]
    assert got == [w for _, w in cases]
    inside = one(spark, text.qty_in_range(F.lit(7), F.lit(5), F.lit(9)), text.qty_in_range(F.lit(4), F.lit(5), F.lit(9)), text.qty_in_range(F.lit(100), F.lit(10), F.lit(None).cast("int")))
    assert list(inside) == [True, False, True]


def test_parse_number(spark):
    want = {"1.234,56": 1234.56, "1,234.56": 1234.56, "Rp 1.000": 1000, "3.139,000": 3139000, "(500)": -500, "-": None, "1.5": 1.5, "": None, "abc": None, "12,5": 12.5, "1,000": 1000, None: None}
    df = rows(spark, [(k,) for k in want], "s string")
    assert {r.s: r.v for r in df.select("s", numeric.parse_number(F.col("s")).alias("v")).collect()} == want


def test_tokens_and_similarity(spark):
    r = one(spark, text.tokenize(F.lit("EU309 40KG, (X) 1.5")), text.token_class(F.lit("40")), text.token_class(F.lit("20MM")), text.token_class(F.lit("EU309")), text.token_class(F.lit("FAN")), text.clean_code(F.lit("eu-309 é")))
    assert list(r) == [["EU", "309", "40", "KG", "(X)", "1.5"], "numeric", "measure", "code", "word", "EU309É"]
    r = one(spark, text.dice(F.lit("night"), F.lit("nacht")), text.dice(F.lit("aaaa"), F.lit("aa")), text.dice(F.lit("a"), F.lit("b")), text.lev_ratio(F.lit(""), F.lit("")), text.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")))
    assert list(r) == [0.25, 0.5, 0.0, 1.0, 1.0]
    assert one(spark, text.clean_value(F.lit(" a–b  b (c)/c"), ("dash", "paren", "slash", "dupword")))[0] == "A B C"
    assert one(spark, text.clean_value(F.lit("ＡＢ"), (), unicode=True))[0] == "AB"
    assert one(spark, text.candidate_names(F.lit("PIPE 10/20 X")))[0] == ["PIPE 10/20 X", "PIPE 10 X", "PIPE 20 X"]
    assert one(spark, text.gift_type(F.lit("Program discount area Bogor")))[0] == "Channel Discount Program"


def test_null_policies(spark):
    r = one(spark, text.blank_text(F.lit(None)), text.null_text(F.lit(" nan ")), text.unknown_text(F.lit("")), numeric.clip(F.lit(None).cast("double"), low=0.0), numeric.ratio(F.lit(1), F.lit(0)), numeric.ratio0(F.lit(1), F.lit(0)), numeric.delta_pct(F.lit(5), F.lit(0)), numeric.mean_of_known(F.lit(1.0), F.lit(None).cast("double"), F.lit(3.0)))
    assert list(r) == ["", None, "Unknown", None, None, 0.0, 0.0, 2.0]


def test_dates(spark):
    want = {"2026-01-02": date(2026, 1, 2), "13/02/2026": date(2026, 2, 13), "02/13/2026": date(2026, 2, 13), "2026-01-02 03:04:05": date(2026, 1, 2), "x": None}
    df = rows(spark, [(k,) for k in want], "s string")
    assert {r.s: r.d for r in df.select("s", parse_date(F.col("s")).alias("d")).collect()} == want
    d = lambda s: F.lit(s).cast("date")
    assert one(spark, overlap_days(d("2026-01-01"), d("2026-01-31"), d("2026-01-20"), d("2026-03-01")))[0] == 12


@pytest.mark.parametrize("rule, want", [(rules.DAILY, ["Bandung", "Tasik", "Dist Sumatera", "Project", "Agen", "Tasik", "Project"]), (rules.MONITORING, ["Bandung", "PCK", "Dist Sumatera", "Project", "Agen", "PCK", "Project"]), (rules.MARKETING, ["Bandung", "Tasik", "Dist Sumatera", "Project", "Project", "Tasik", "Project"])])
def test_branches(spark, rule, want):
    df = rows(spark, [(i, s) for i, s in enumerate(["ELSLP05", "ELSLP71", "pislp37", "PISLP33", "PISLP55", "ICCOS07", "NONE"])], "i int, s string")
    assert [r.b for r in df.orderBy("i").select(rules.branch_of(F.col("s"), rule).alias("b")).collect()] == want


def test_divisions_and_remap(spark):
    r = one(spark, rules.division_of(F.lit("Pipa Pompa")), rules.division_of(F.lit(None).cast("string")), rules.category_remap(F.lit("Maspion Ex Fan"), F.lit("Bogor"), F.lit("PP")), rules.category_remap(F.lit("Maspion Ex Fan"), F.lit("Tasik"), F.lit("pp")), rules.category_remap(F.lit("Sekai Ex Fan"), F.lit("Cirebon"), F.lit("")), rules.channel_of(F.lit("Sales Other"), F.lit("Dist Sumatera")))
    assert list(r) == ["PP", "", "Maspion", "Maspion Ex Fan", "Sekai", "Agen"]
