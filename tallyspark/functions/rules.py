"""Business dimension rules as chains of conditions.  Codes are configuration: pass your own tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BranchRule:
    """Sales code to branch: fixed codes, then ranges of the numeric suffix, then a default."""

    early: tuple = ((30, 39, "Project"), (50, 59, "Agen"))
    codes: dict = field(default_factory=dict)
    first: tuple = ()
    ranges: tuple = ((0, 19, "Bandung"), (20, 29, "PCK"), (40, 49, "Project"), (60, 69, "Cirebon"), (70, 79, "Tasik"), (80, 89, "Bogor"))
    default: str = "Project"
    suffix: str = r"(\d{2})$"


# Sales codes with a branch of their own.
_CODES = {
    "Bandung": ("ELCOS01", "PICOS01", "PICOS21", "PPCOS01"),
    "Cirebon": ("ELCOS06", "PICOS06", "PPCOS06", "SPV06"),
    "Bogor": ("ELCOS08", "ICCOS08", "PPCOS08", "ICSPV08", "PPSPV08"),
    "Tasik": ("ICCOS07", "PPCOS07", "ELCOS07", "PICOS07"),
}
_DIST = (("PISLP37", "Dist Sumatera"), ("PISLP38", "Dist Kalimantan"))
DAILY = BranchRule(first=_DIST, codes=_CODES)
MONITORING = BranchRule(first=_DIST, codes={**{k: v for k, v in _CODES.items() if k != "Tasik"}, "PCK": _CODES["Tasik"]}, ranges=tuple((a, b, "PCK" if n == "Tasik" else n) for a, b, n in BranchRule.ranges), suffix=r"(\d+)$")
MARKETING = BranchRule(early=(), first=_DIST, codes={**_CODES, "Project": ("PISLP33", "PISLP35", "PISLP39", "PISLP51", "PISLP52", "PISLP53")}, ranges=tuple(r for r in BranchRule.ranges if r[2] != "Project"))
REPORT = BranchRule(codes={"Bandung": _CODES["Bandung"], "Cirebon": _CODES["Cirebon"][:3], "Bogor": _CODES["Bogor"][:3], "Tasik": ("ICCOS07",)})


def branch_of(salesman: Column, rule: BranchRule = DAILY) -> Column:
    s = F.upper(F.trim(F.coalesce(salesman, F.lit(""))))
    n = F.regexp_extract(s, rule.suffix, 1).try_cast("int")
    out = F.lit(rule.default)
    for low, high, name in reversed(rule.ranges):
        out = F.when(n.between(low, high), name).otherwise(out)
    for name, codes in reversed(rule.codes.items()):
        out = F.when(s.isin(*codes), name).otherwise(out)
    for low, high, name in reversed(rule.early):
        out = F.when(n.between(low, high), name).otherwise(out)
    for code, name in reversed(rule.first):
        out = F.when(s == code, name).otherwise(out)
    return out


def category_of(salesman: Column) -> Column:
    """Place in the sales hierarchy."""
    s = F.upper(F.trim(F.coalesce(salesman, F.lit(""))))
    n = F.regexp_extract(s, r"(\d{2})$", 1).try_cast("int")
    out = F.when(s.contains("SPV"), "Supervisor").when(s.contains("COS"), "Cosales")
    out = out.when(s.startswith("PISLP") & n.between(30, 39), "Sales Project").when(s.startswith("PISLP") & n.between(50, 59), "Sales Agen")
    for low, high, name in ((60, 69, "Cirebon"), (70, 79, "Tasik"), (80, 89, "Bogor"), (0, 19, "Bandung"), (20, 29, "PCK")):
        out = out.when(n.between(low, high), f"Sales {name}")
    return out.otherwise("Sales Other")


def channel_of(category: Column, branch: Column) -> Column:
    b = F.upper(F.trim(branch))
    return F.when((category == "Sales Project") | (b == "PROJECT"), "Project").when((category == "Sales Agen") | (b == "AGEN") | b.startswith("DIST "), "Agen").otherwise("Retail")


# Spellings of the divisions.
DIVISIONS = {"EL": ("EL", "ELEKTRIK", "ELECTRIK"), "ICI": ("IC", "ICI"), "PI": ("PI", "PIPAMAS", "PIPA"), "PP": ("PP", "POMPA", "PIPAPOMPA"), "LM": ("LM",)}


def division_of(c: Column) -> Column:
    raw = F.trim(F.coalesce(c, F.lit("")))
    key = F.regexp_replace(F.upper(raw), "[. ]", "")
    out = F.upper(raw)
    for name, spellings in DIVISIONS.items():
        out = F.when(key.isin(*spellings), name).otherwise(out)
    return out


def excluded_actual(branch: Column) -> Column:
    return F.upper(F.trim(F.coalesce(branch, F.lit("")))).isin("PROJECT", "DIST KALIMANTAN", "DIST SUMATERA", "AGEN")


def excluded_target(branch: Column) -> Column:
    return F.upper(F.trim(F.coalesce(branch, F.lit("")))).isin("PROJECT", "DIST KALIMANTAN", "DIST SUMATERA")


def category_remap(category: Column, branch: Column, division: Column) -> Column:
    """Fan categories that some branches book under a shorter name."""
    c, d = F.upper(F.trim(category)), F.upper(F.trim(division))
    short = (branch == "Cirebon") | (branch.isin("Bandung", "Tasik", "Bogor") & (d == "EL"))
    return (
        F.when((c == "MASPION EX FAN") & ~(branch.isin("Bandung", "Tasik") & (d == "PP")), "Maspion")
        .when(short & (c == "PANASONIC EX FAN"), "Panasonic Fan")
        .when(short & (c == "SEKAI EX FAN"), "Sekai")
        .otherwise(category)
    )


def sku_of(brand: Column, category: Column, group: Column, group_bogor: Column, branch: Column) -> Column:
    pip = F.lower(F.trim(brand)).isin("mtn", "pipamas", "tangit")
    blank = lambda c: F.when(F.trim(c) == "", None).otherwise(c)
    own = F.when(pip, F.when(branch == "Bogor", group_bogor).otherwise(group)).otherwise(blank(category))
    return F.lower(F.trim(F.coalesce(blank(own), brand)))
