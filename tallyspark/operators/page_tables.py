"""Tables out of the cells of pages: merged cells filled, blocks aligned to the first one's columns, furniture pruned.
Rows are (page, row_idx, cells); a page, and a block of rows between blank ones, is as long as paper is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import parse_number

# Likeness of two columns in the same and in another place, weights of its parts; least fill of a column;
# least table rows of a page; a number that can be a price.
SAME_PLACE, OTHER_PLACE = 0.45, 0.55
PARTS = (0.5, 0.3, 0.2)
LEAST_FILL, LEAST_ROWS, LEAST_NUMBER = 0.1, 3, 100


def _filled(cells: Column) -> Column:
    """Places of the filled cells."""
    return F.filter(F.transform(cells, lambda c, k: F.when(c != "", k)), lambda k: k.isNotNull())


def fill_merged(rows: DataFrame) -> DataFrame:
    """Within each run of rows without a blank one, the first row whose filled columns no other row fills is a label: its
    cells stand for a merged cell and fill the others' gaps."""
    blank = F.size(_filled(F.col("cells"))) == 0
    by = W.partitionBy("page").orderBy("row_idx")
    runs = rows.withColumn("_run", F.sum(F.when(blank, 1).otherwise(0)).over(by)).withColumn("_blank", blank)
    listed = F.array_sort(F.collect_list(F.struct("row_idx", "cells")))
    group = runs.where("not _blank").groupBy("page", "_run").agg(listed.alias("rows"))
    used = F.flatten(F.transform("rows", lambda r: _filled(r["cells"])))
    alone = lambda r: F.forall(_filled(r["cells"]), lambda k: F.size(F.filter(F.col("_used"), lambda x: x == k)) == 1)
    group = group.withColumn("_used", used).withColumn("_label", F.when(F.size("rows") > 1, F.get(F.filter("rows", alone), F.lit(0))["cells"]))
    full = lambda r: F.transform(r["cells"], lambda c, k: F.when(c == "", F.coalesce(F.get("_label", k), F.lit(""))).otherwise(c))
    done = group.select("page", F.explode(F.transform("rows", lambda r: F.struct(r["row_idx"].alias("row_idx"), full(r).alias("cells")))).alias("r")).select("page", "r.*")
    return done.unionByName(runs.where("_blank").select("page", "row_idx", "cells"))


def _likeness(a: Column, b: Column) -> Column:
    number, length, fill = PARTS
    apart = F.least(F.abs(a["length"] - b["length"]) / F.greatest(a["length"], b["length"], F.lit(1.0)), F.lit(1.0))
    return 1 - (F.abs(a["number"] - b["number"]) * number + apart * length + F.abs(a["fill"] - b["fill"]) * fill)


def align_blocks(rows: DataFrame) -> DataFrame:
    """rows (page, block, row_idx, cells): every block's cells under the columns of the page's first block.  Column by
    column: the same place if it is alike and free, else the most alike free one, else the column goes."""
    cell = rows.select("page", "block", F.posexplode("cells").alias("k", "v"))
    full, n = F.col("v") != "", F.count(F.when(F.col("v") != "", 1))
    number = parse_number(F.col("v")).isNotNull() & F.col("v").rlike(r"\d") & (F.length(F.regexp_replace("v", r"[^\p{L}]", "")) <= 2)
    count = rows.groupBy("page", "block").agg(F.count("*").alias("rows"))
    shares = cell.groupBy("page", "block", "k").agg(F.coalesce(F.try_divide(F.count(F.when(full & number, 1)), n), F.lit(0.0)).alias("number"), F.coalesce(F.try_divide(F.sum(F.when(full, F.length("v"))), n), F.lit(0.0)).alias("length"), n.alias("n"))
    shares = shares.join(count, ["page", "block"]).withColumn("fill", F.col("n") / F.col("rows"))
    profiles = shares.groupBy("page", "block").agg(F.array_sort(F.collect_list(F.struct("k", "number", "length", "fill"))).alias("profile"))  # as many as a block has columns
    first = profiles.groupBy("page").agg(F.min_by("profile", "block").alias("base"), F.min("block").alias("first"))

    def step(to: Column, own: Column) -> Column:
        here = F.get("base", own["k"])
        stays = here.isNotNull() & ~F.array_contains(to, own["k"]) & (_likeness(own, here) >= SAME_PLACE)
        free = F.filter("base", lambda b: ~F.array_contains(to, b["k"]))
        best = F.array_max(F.transform(free, lambda b: F.struct(_likeness(own, b).alias("s"), (-b["k"]).alias("at"))))
        return F.concat(to, F.array(F.when(stays, own["k"]).otherwise(F.coalesce(F.when(best["s"] > OTHER_PLACE, -best["at"]), F.lit(-1)))))

    mapped = profiles.join(first, "page").withColumn("to", F.when(F.col("block") == F.col("first"), F.transform("profile", lambda p: p["k"])).otherwise(F.aggregate("profile", F.array().cast("array<int>"), step)))
    out = F.transform(F.sequence(F.lit(0), F.size("base") - 1), lambda k: F.coalesce(F.get("cells", F.array_position("to", k).cast("int") - 1), F.lit("")))
    return rows.join(mapped.select("page", "block", "base", "to"), ["page", "block"]).select("page", "block", "row_idx", out.alias("cells"))


def table_rows(rows: DataFrame, scanned: bool = False) -> DataFrame:
    """(page, row_idx, category, cells): rows of a page that look like a table's, if it has three of them (else all), without
    columns filled in under a tenth of them.  A row of one text with a space and no digit is the title of what follows;
    of scanned pages, rows without a number of 100 or more go."""
    filled = F.filter("cells", lambda c: c != "")
    df = rows.withColumns({"_n": F.size(filled), "_one": F.get(filled, F.lit(0)), "_width": F.max(F.size("cells")).over(W.partitionBy("page"))})
    title = (F.col("_n") == 1) & (F.length("_one") >= 5) & F.col("_one").rlike(r"\s") & ~F.col("_one").rlike(r"\d")
    by = W.partitionBy("page").orderBy("row_idx")
    df = df.withColumn("category", F.coalesce(F.last(F.when(title, F.col("_one")), ignorenulls=True).over(by), F.lit("")))
    df = df.withColumn("_in", F.col("_n") >= F.greatest(F.lit(2), F.floor(F.col("_width") / 2)))
    df = df.withColumn("_use", F.count(F.when(F.col("_in"), 1)).over(W.partitionBy("page")) >= LEAST_ROWS).where("_in or not _use")
    fill = df.select("page", F.posexplode("cells").alias("k", "v")).groupBy("page", "k").agg(F.count(F.when(F.col("v") != "", 1)).alias("n"))
    kept = fill.join(df.groupBy("page").agg(F.count("*").alias("rows")), "page").where(F.col("n") / F.col("rows") >= LEAST_FILL).groupBy("page").agg(F.array_sort(F.collect_list("k")).alias("keep"))
    df = df.join(kept, "page", "left").withColumn("cells", F.when(F.size("keep") > 0, F.transform("keep", lambda k: F.coalesce(F.get("cells", k), F.lit("")))).otherwise(F.col("cells")))
    if scanned:
        df = df.where(F.exists("cells", lambda c: F.abs(parse_number(c)) >= LEAST_NUMBER))
    return df.select("page", "row_idx", "category", "cells")


# Fixed value: rows at the top of a scanned page among which its header is looked for.
HEADER_ROWS = 5


def scanned_headers(rows: DataFrame) -> DataFrame:
    """(page, header_row, headers) of scanned pages: the first of the top five rows with two filled cells or more, none of
    them a number; its empty cells are named by their place.  A page without one has no row."""
    top = rows.withColumn("_nth", F.row_number().over(W.partitionBy("page").orderBy("row_idx"))).where(F.col("_nth") <= HEADER_ROWS)
    filled = F.filter("cells", lambda c: c != "")
    head = top.where((F.size(filled) >= 2) & F.forall(filled, lambda c: parse_number(c).isNull()))
    first = head.groupBy("page").agg(F.min(F.struct("row_idx", "cells")).alias("h"))
    names = F.transform("h.cells", lambda c, k: F.when(c != "", c).otherwise(F.concat(F.lit("Column "), (k + 1).cast("string"))))
    return first.select("page", F.col("h.row_idx").alias("header_row"), names.alias("headers"))
