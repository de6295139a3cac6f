"""Datasets out of string matrices: a mapping of columns to fields, cleaned names, variants, prices, quantity ranges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numeric import parse_number
from .profile import cleaning_rules
from .stage import spread, staged

# Fields that hold prices.
PRICE_FIELDS = ("basicPrice", "invoicePrice", "invoicePriceVat", "nettPrice")
#: A row's variants are numbered in so many low bits of its key.
VARIANT_BITS = 20


def _number(c):
    """parse_number, which most values do not need: plain digits have nothing to tidy."""
    return F.when(F.trim(c).rlike(r"^\d+(\.\d{1,2})?\z"), F.trim(c).try_cast("double")).otherwise(parse_number(c))


@dataclass(frozen=True)
class MappedColumn:
    """A column of a sheet: where it stands, its header, the field it means, its name if renamed."""

    index: int
    name: str
    field: str | None = None
    rename: str | None = None
    ignore: bool = False

    @property
    def key(self) -> str:
        return self.field or self.rename or self.name


def dataset(matrix: DataFrame, mapping: list[MappedColumn], rules: list[str] | None = None) -> DataFrame:
    """Rows of (row_idx, cells) as dataset rows, one for each slash variant of the name.

    A row is left out if its name is blank and every mapped cell is empty.  Cleaning rules are those that occur among
    the names (at most nine names come to the driver).  Each spelling of a name is cleaned once, however many rows have it.
    key: the row's number and the variant's; data: mapped cells by key; prices: those that parse, null if none does;
    qty_*: range of a graded price."""
    used = [m for m in mapping if not m.ignore]
    at: dict[str, int] = {}
    for m in used:
        at.setdefault(m.field or "", m.index)
    raw = lambda i: F.coalesce(F.get("cells", F.lit(i)), F.lit(""))
    cell = lambda f: raw(at[f]) if f in at else F.lit(None).cast("string")
    filled = lambda f: F.when(F.trim(cell(f)) != "", F.trim(cell(f)))
    name = F.trim(F.coalesce(cell("productName"), F.lit("")))
    spellings = staged(matrix.select(name.alias("spelling")).distinct(), "spellings")
    if rules is None:
        rules = [r.rule for r in cleaning_rules(spellings, "spelling").collect()]
    named = spread(spellings, "spelling").select("spelling", F.posexplode(T.slash_variants(F.col("spelling"))).alias("part", "name"))
    named = named.withColumn("norm", F.when(F.col("name") != "", T.clean_value(F.col("name"), rules)))
    named = staged(named.withColumn("tokens", F.coalesce(T.tokenize(F.col("norm")), F.array().cast("array<string>"))), "names")
    by_key = {m.key: m.index for m in used}
    data = F.create_map(*(x for k, i in by_key.items() for x in (F.lit(k), raw(i)))) if by_key else F.lit(None).cast("map<string,string>")
    empty = F.forall(F.array(*map(raw, by_key.values())), lambda x: x == "") if by_key else F.lit(True)
    said = [(f, _number(cell(f))) for f in PRICE_FIELDS if f in at]
    prices = F.map_filter(F.create_map(*(x for f, p in said for x in (F.lit(f), p))), lambda k, v: v.isNotNull()) if said else F.lit(None).cast("map<string,double>")
    ranged = any(f in at for f in ("qtyRule", "qtyFrom", "qtyTo"))
    span = T.qty_rule(cell("qtyRule"), cell("qtyFrom"), cell("qtyTo")) if ranged else F.lit(None).cast("struct<min:double,max:double,label:string>")
    rows = matrix.where(~((name == "") & empty)).select(
        "row_idx", data.alias("data"), filled("productCode").alias("code"), filled("productVariant").alias("variant"), filled("brand").alias("brand"), filled("category").alias("category"),
        F.when(cell("description") != "", cell("description")).alias("description"), F.when(F.size(prices) > 0, prices).alias("prices"), _number(cell("qty")).alias("qty"), span.alias("span"), name.alias("spelling"),
    )
    return rows.join(named, "spelling").select(
        (F.shiftleft(F.col("row_idx").cast("long"), VARIANT_BITS) + F.col("part")).alias("key"), "row_idx", F.when(F.col("name") != "", F.col("name")).alias("name"), "norm", "tokens",
        "code", "variant", "brand", "category", "description", "prices", "qty", F.col("span.min").alias("qty_min"), F.col("span.max").alias("qty_max"), F.col("span.label").alias("qty_label"), "data",
    )
