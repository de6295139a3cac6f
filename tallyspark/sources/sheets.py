"""Loose sheets as string matrices (CSV, spreadsheets) and the sinks of the pipelines."""

from __future__ import annotations

import re
import zipfile
from datetime import date, timedelta
from io import BytesIO
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import null_text
from ..operators.profile import header_row
from .csv_matrix import MATRIX, read_csv_matrix

__all__ = ["MATRIX", "read_csv_matrix", "read_workbooks", "largest_sheet", "sheet_ranking", "typed", "safe_names", "coerced", "save", "load_table", "export_csv", "flattened"]

_REL_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


# Number formats that show dates, by the file format; letters that do so in formats of one's own.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}
_DATE_LETTERS = re.compile(r"[ymdhs]", re.I)


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show dates."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    # quoted text, escapes and colours in brackets are no date letters
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", f.get("formatCode") or "") for f in root.iter(f"{{{_NS['m']}}}numFmt")}
    formats = [int(x.get("numFmtId") or 0) for x in root.findall("m:cellXfs/m:xf", _NS)]
    return {k for k, f in enumerate(formats) if (_DATE_LETTERS.search(own[f]) if f in own else f in DATE_FORMATS)}


def _iso_date(serial: str, since_1904: bool) -> str:
    """The day of a serial number of days; anything else as it is."""
    try:
        days = float(serial)
        # day 60 of the older system is a 29 February that never was
        start = date(1904, 1, 1) if since_1904 else date(1899, 12, 30 if days >= 60 else 31)
        return (start + timedelta(days=int(days))).isoformat()
    except (ValueError, OverflowError):
        return serial


def workbook_rows(content: bytes):
    """(sheet, row_idx, cells) of an xlsx file: shared and inline strings, numbers as written, ISO dates kept."""
    with zipfile.ZipFile(BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        sheets = list(book.iter(f"{{{_NS['m']}}}sheet"))
        if "xl/_rels/workbook.xml.rels" in names:
            parts = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
            files = [parts.get(s.get(_REL_ID), "") for s in sheets]
            files = [f.lstrip("/") if f.startswith("/") else f"xl/{f}" for f in files]
        else:  # a part without relations: sheets stand in order of their numbers
            files = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        dates, settings = _date_styles(z), book.find("m:workbookPr", _NS)
        since_1904 = settings is not None and settings.get("date1904") in ("1", "true")
        for title, file in zip((s.get("name") for s in sheets), files):
            if file not in names:
                continue
            for i, row in enumerate(ElementTree.fromstring(z.read(file)).iter(f"{{{_NS['m']}}}row")):
                cells: list[str] = []
                for c in row.findall("m:c", _NS):
                    letters = re.match(r"[A-Z]+", c.get("r") or "")
                    at = 0
                    for ch in letters.group() if letters else "":
                        at = at * 26 + ord(ch) - 64
                    cells += [""] * (at - 1 - len(cells))
                    v, inline = c.find("m:v", _NS), c.find("m:is", _NS)
                    if c.get("t") == "s" and v is not None:
                        cells.append(shared[int(v.text)].strip())
                    elif inline is not None:
                        cells.append("".join(t.text or "" for t in inline.iter(f"{{{_NS['m']}}}t")).strip())
                    else:
                        text = (v.text or "").strip() if v is not None else ""
                        shows_date = c.get("t") in (None, "n") and int(c.get("s") or 0) in dates
                        cells.append(_iso_date(text, since_1904) if shows_date and text else text[:10] if c.get("t") == "d" else text)
                if any(cells):
                    yield title, i, cells


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """All sheets of all workbooks under a path, one task a file."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def rows(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = list(workbook_rows(content))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(got)), pa.array([g[0] for g in got]), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.list_(pa.string()))], names=["path", "sheet", "row_idx", "cells"])

    return files.mapInArrow(rows, MATRIX)


def largest_sheet(matrix: DataFrame) -> DataFrame:
    """Rows of the sheet with most rows, by file; ties to the first name."""
    n = matrix.groupBy("path", "sheet").agg(F.count("*").alias("n")).groupBy("path").agg(F.min_by("sheet", F.struct(-F.col("n"), "sheet")).alias("sheet"))
    return matrix.join(n, ["path", "sheet"])  # one row a file: broadcast by its size at run time


def sheet_ranking(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("path", "sheet").agg(F.count("*").alias("n_rows"), F.max(F.size("cells")).alias("n_columns")).withColumn("score", F.col("n_rows") * F.col("n_columns"))


def typed(matrix: DataFrame) -> DataFrame:
    """A table out of one sheet: header found, rows below it, ragged rows padded with ''."""
    h, names = header_row(matrix)
    names = safe_names(names)
    return matrix.where(F.col("row_idx") > h).select("row_idx", *(F.coalesce(F.get("cells", i), F.lit("")).alias(n) for i, n in enumerate(names)))


def safe_names(names, repeat: str = "_1", drop: bool = False) -> list[str]:
    """Column names of letters, digits and _; repeated ones get _1, _2 ... (or start at _2 with repeat='_2')."""
    out: list[str] = []
    for n in names:
        n = re.sub(r"_+", "_", re.sub(r"[^0-9A-Za-z_]", "_", str(n).strip())).strip("_") or "column"
        n = f"_{n}" if n[0].isdigit() else n
        if n in out:
            if drop:
                continue
            k = int(repeat[1:])
            while f"{n}_{k}" in out:
                k += 1
            n = f"{n}_{k}"
        out.append(n)
    return out


def coerced(df: DataFrame) -> DataFrame:
    """Before a load: infinite numbers and null words become null, text columns named like dates timestamps."""
    cols = {}
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            cols[name] = F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)
        elif kind == "string":
            cols[name] = F.try_to_timestamp(null_text(c)) if re.search("date|tanggal", name, re.I) else null_text(c)
    return df.withColumns(cols)


def load_table(df: DataFrame, name: str, cluster_by=(), buckets: int | None = None) -> str:
    """Truncate and load into a catalogue table, bucketed and sorted by the clustering columns that df has.

    Returns what was done: "skipped" (no rows), "created", "loaded", or "recreated" where the stored clustering
    was another and the table was dropped first.  Tables of one clustering and number of buckets join without an exchange."""
    spark = df.sparkSession
    keys = [c for c in cluster_by if c in df.columns]
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if df.limit(1).count() == 0:
        return "skipped"
    stored = stored_clustering(spark, name)
    done = "created" if stored is None else "loaded" if stored == (keys, buckets if keys else 0) else "recreated"
    if done == "recreated":
        spark.sql(f"DROP TABLE {name}")
    # one file a bucket: rows are dealt out as the buckets are
    out = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys) if keys else df.write
    if done == "loaded" and not keys:
        out.insertInto(name, overwrite=True)
    else:
        out.mode("overwrite").format("parquet").saveAsTable(name)
    return done


def stored_clustering(spark: SparkSession, name: str) -> tuple[list[str], int] | None:
    """(bucket columns in order, buckets) of a catalogue table, ([], 0) without any, None if there is no such table."""
    if not spark.catalog.tableExists(name):
        return None
    said = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}  # a row a column and property
    return re.findall(r"`([^`]*)`", said.get("Bucket Columns", "")), int(said.get("Num Buckets", 0))


def save(df: DataFrame, path: str, cluster_by=(), partition_by=()) -> None:
    """Truncate and load as Parquet, laid out by range of the clustering columns."""
    out = df.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by) if cluster_by else df
    w = out.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def export_csv(df: DataFrame, path: str, order=(), total: bool = False) -> None:
    """One CSV file with byte-order mark and CRLF, optionally with a row of sums; for results of report size."""
    sums = [n for n, k in df.dtypes if k in ("double", "int", "bigint") or k.startswith("decimal")]
    text = [F.col(c).cast("string").alias(c) for c in df.columns]
    rows = df.withColumn("_part", F.lit(0))
    if total:
        one = df.agg(*(F.sum(c).alias(c) for c in sums)).select(*(F.col(c) if c in sums else F.lit("TOTAL" if i == 0 else None).alias(c) for i, c in enumerate(df.columns)), F.lit(1).alias("_part"))
        rows = rows.select(*text, "_part", *(F.col(c).alias(f"_o_{c}") for c in order)).unionByName(one.select(*text, "_part"), allowMissingColumns=True)
        order = [f"_o_{c}" for c in order]
    quoted = [F.when(F.col(c).cast("string").rlike('[",\n;]'), F.concat(F.lit('"'), F.regexp_replace(F.col(c).cast("string"), '"', '""'), F.lit('"'))).otherwise(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns]
    head = df.sparkSession.createDataFrame([("﻿" + ",".join(df.columns) + "\r", -1)], "value string, _part int")
    lines = rows.select(F.concat(F.concat_ws(",", *quoted), F.lit("\r")).alias("value"), "_part", *order)
    head.unionByName(lines, allowMissingColumns=True).repartition(1).sortWithinPartitions("_part", *order).select("value").write.mode("overwrite").text(path)


def flattened(df: DataFrame, column: str, keys=None) -> DataFrame:
    """A map column as one column for each key that occurs (keys are few: they are column names)."""
    if keys is None:
        keys = sorted(r[0] for r in df.select(F.explode(F.map_keys(column))).distinct().collect())
    return df.select(*(c for c in df.columns if c != column), *(F.col(column)[k].alias(k) for k in keys))
