"""Schema detection over loose sheets: header row, column statistics, roles, cleaning rules, file roles."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import parse_number
from ..functions.text import DETECTORS


def header_row(matrix: DataFrame, look: int = 15) -> tuple[int, list[str]]:
    """(row, names): the row among the first ``look`` that most looks like a header.  Rows are (row_idx, cells);
    only the first look + 10 rows come to the driver."""
    rows = [list(r.cells) for r in matrix.orderBy("row_idx").limit(look + 10).collect()]
    if not rows:
        return 0, []
    width = max(map(len, rows))
    rows = [[(c or "").strip() for c in r] + [""] * (width - len(r)) for r in rows]

    def numeric(c):
        return bool(re.search(r"\d", c)) and not re.search(r"[A-Za-z]{2,}", c)

    best, at = None, 0
    for i, r in enumerate(rows[:look]):
        full = [c for c in r if c]
        if len(full) < 2:
            continue
        below = rows[i + 1 : i + 11]
        fill = len(full) / width
        text = sum(not numeric(c) for c in full) / len(full)
        unique = len({c.lower() for c in full}) / len(full)
        below_fill = sum(bool(c) for b in below for c in b) / max(len(below) * width, 1)
        again = sum(c in {b[j] for b in below} for j, c in enumerate(r) if c) / len(full)
        score = 2 * fill + 2 * text + 2 * unique + below_fill - 3 * again
        if best is None or score > best:
            best, at = score, i
    return at, [c or f"Column {j + 1}" for j, c in enumerate(rows[at])]


def column_stats(df: DataFrame) -> DataFrame:
    """One row per string column, from one pass over the unpivoted cells."""
    cells = df.unpivot([], df.columns, "column_name", "v").withColumn("v", F.trim("v")).where("v <> ''")
    n = F.count("*").cast("double")
    v = F.col("v")
    number = parse_number(v).isNotNull() & v.rlike(r"\d") & (F.length(F.regexp_replace(v, r"[^\p{L}]", "")) <= 2)
    s = cells.groupBy("column_name").agg(F.count("*").alias("n"), (F.count_distinct(F.lower("v")) / n).alias("uniqueness"), (F.sum(F.length("v")) / n).alias("mean_length"), (F.count(F.when(number, 1)) / n).alias("numeric_ratio"), (1 - F.count_distinct(F.lower("v")) / n).alias("duplicate_ratio"), (F.count(F.when(v.rlike("[<>=]"), 1)) / n).alias("operator_ratio"))
    return s.withColumn("data_type", F.when(F.col("numeric_ratio") > 0.85, "numeric").when(F.col("numeric_ratio") < 0.15, "text").otherwise("mixed"))


# Words in a header that hint at the role of the column.
HINTS = {"product": ("product", "name", "item", "nama", "barang"), "price": ("price", "harga", "net"), "code": ("code", "kode", "sku"), "qty": ("qty", "quantity", "jumlah"), "category": ("category", "kategori", "group")}


def assign_roles(stats: list[dict]) -> dict[str, str]:
    """Role to column, greedy in the order product, price, code, qty, category; each column once."""

    def score(role, s):
        u, num, length = s["uniqueness"], s["numeric_ratio"], min(s["mean_length"] / 20, 1)
        base = {"product": u + (1 - num) + length, "price": num + (1 - s["operator_ratio"]) * 0.3, "code": u + (0.6 if 0.1 < num < 0.95 else 0) + (0.4 if s["mean_length"] < 14 else 0), "qty": num + s["duplicate_ratio"], "category": s["duplicate_ratio"] + (1 - num)}[role]
        return base + (1.5 if any(h in s["column_name"].lower() for h in HINTS[role]) else 0)

    out: dict[str, str] = {}
    for role in ("product", "price", "code", "qty", "category"):
        bar = 0.8 if role in ("product", "price") else 1.6
        for s in stats:
            x = score(role, s)
            if s["column_name"] not in out.values() and x > bar:
                bar, out[role] = x, s["column_name"]
    return out


def cleaning_rules(df: DataFrame, col: str) -> DataFrame:
    """(rule, occurrences) of the noise classes that occur, in one pass over all values."""
    values = df.where(F.trim(col) != "")
    one = values.agg(*(F.count(F.when(F.col(col).rlike(p), 1)).alias(r) for r, p in DETECTORS.items()))
    return one.unpivot([], one.columns, "rule", "occurrences").where("occurrences > 0")


def require(df: DataFrame, columns) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def ensure(df: DataFrame, defaults: dict) -> DataFrame:
    """Adds optional columns: name to (type, default)."""
    return df.withColumns({c: F.lit(v).cast(t) for c, (t, v) in defaults.items() if c not in df.columns})


def resolve(columns, candidates) -> str | None:
    """First candidate that is a column, exactly or by its letters and digits."""
    key = lambda s: re.sub("[^a-z0-9]", "", s.lower())
    for c in candidates:
        if c in columns:
            return c
    by = {key(c): c for c in columns}
    return next((by[key(c)] for c in candidates if key(c) in by), None)


def detect_file_role(name: str, content: str, roles: dict) -> tuple[str | None, int]:
    """Best (role, score): 5 for a name prefix, 3 for a word in the name (1 more for each further word), 1 for
    the content; an excluded word rules a role out.  roles: name to {prefixes, words, exclude}."""
    best, low, text = (None, 0), name.lower(), content.lower()
    for role, spec in roles.items():
        score = 0
        if not any(x.lower() in low for x in spec.get("exclude", ())):
            if any(low.startswith(p.lower()) for p in spec.get("prefixes", ())):
                score = 5
            hits = [w for w in spec.get("words", ()) if w.lower() in low]
            score = max(score, 3 + len(hits) - 1 if hits else 0)
            if score == 0 and any(w.lower() in text for w in spec.get("words", ())) or score and any(w.lower() in text for w in spec.get("words", ())):
                score += 1
        if score > best[1]:
            best = (role, score)
    return best


def price_derived(df: DataFrame, candidate: str, price: str) -> DataFrame:
    """One row, ``derived``: do the ratios of two number columns crowd around their upper median?

    Asks for ratios in at least half of the rows and five at the least, three of five of them within 3 percent."""
    a, b = F.col(candidate).cast("double"), F.col(price).cast("double")
    r = df.select(F.try_divide(a, b).alias("r"))
    # the smallest step beyond one half takes the upper of two middle values
    mid = r.agg(F.expr("percentile_disc(0.500000000001) WITHIN GROUP (ORDER BY r)").alias("m"), F.count("r").alias("n"), F.count("*").alias("rows"))  # one row
    near = r.join(F.broadcast(mid)).groupBy("m", "n", "rows").agg(F.count(F.when(F.abs(F.col("r") - F.col("m")) / F.col("m") < 0.03, 1)).alias("close"))
    enough = F.col("n") >= F.greatest(F.lit(5.0), F.col("rows") * 0.5)
    return near.select((enough & (F.col("m") != 0) & (F.try_divide(F.col("close").cast("double"), F.col("n").cast("double")) >= 0.6)).alias("derived"))
