"""Sheets of files written here: CSV over many splits, workbooks with dates and relations, managed tables."""

import csv
import random
import zipfile
from io import StringIO

import pytest

from tallyspark.sources import sheets
from tallyspark.sources.csv_matrix import cells_of, ends_inside


def plain(text):
    """(row_idx, cells) of csv.reader, blank rows left out."""
    rows = [[c.strip() for c in r] for r in csv.reader(StringIO(text, newline=""))]
    return [(i, r) for i, r in enumerate(rows) if any(r)]


def test_lines_move_like_the_csv_module():
    rng = random.Random(1)
    for _ in range(5000):
        text = "".join(rng.choice('ab",\n ') for _ in range(rng.randint(0, 30)))
        records, parts, inside = [], [], False
        for line in text.removesuffix("\n").split("\n") if text else []:
            parts.append(line)
            inside = ends_inside(line, inside)
            if not inside:
                records.append("\n".join(parts))
                parts = []
        records += ["\n".join(parts)] if parts else []
        assert [(i, c) for i, c in enumerate(map(cells_of, records)) if any(c)] == plain(text)


@pytest.mark.parametrize("split", ["64", "300", "128m"])
def test_csv_over_splits(spark, tmp_path, split):
    """Long quoted fields cross one or many splits; the result is that of one reader."""
    rng = random.Random(7)
    texts = {}
    for f in range(3):
        out = StringIO()
        w = csv.writer(out, lineterminator="\n")
        for k in range(150):
            w.writerow([k, rng.choice(["plain", 'say "x", ok', "two\nlines", "\n" * 90 + "long " * 60, "", 'a "', "é,"]), rng.choice(["", "z"])])
            if k % 40 == 0:
                out.write("\n")
        out.write('6" pipe,5" x,"end')  # stray quotes, and a field that is left open
        texts[f] = ("﻿" if f == 0 else "") + out.getvalue()
        (tmp_path / f"f{f}.csv").write_text(texts[f], encoding="utf-8")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = sheets.read_csv_matrix(spark, str(tmp_path)).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    for f, text in texts.items():
        assert sorted((r.row_idx, r.cells) for r in got if r.path.endswith(f"f{f}.csv")) == plain(text.removeprefix("﻿"))


def workbook(path, sheet_rows, rels=True, since_1904=False):
    ns, rel = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        pr = '<workbookPr date1904="1"/>' if since_1904 else ""
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}">{pr}<sheets><sheet name="First" sheetId="1" r:id="rId9"/><sheet name="Second" sheetId="2" r:id="rId8"/></sheets></workbook>')
        if rels:
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId8" Target="/xl/worksheets/sheet1.xml"/><Relationship Id="rId9" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy"/><numFmt numFmtId="171" formatCode="0.0 &quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        for k, rows in enumerate(sheet_rows, 1):
            z.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>")


def test_workbook_dates_and_relations(spark, tmp_path):
    dates = '<row r="1"><c r="A1" s="1"><v>46213</v></c><c r="B1" s="2"><v>46213.75</v></c><c r="C1" s="3"><v>46213</v></c><c r="D1"><v>46213</v></c><c r="E1" t="d"><v>2026-07-10T00:00:00</v></c><c r="F1" s="1"><v>59</v></c></row>'
    other = '<row r="1"><c r="A1"><v>1</v></c></row>'
    workbook(tmp_path / "a.xlsx", [dates, other])
    workbook(tmp_path / "b.xlsx", [dates, other], rels=False, since_1904=True)
    got = {(r.path[-6:], r.sheet): r.cells for r in sheets.read_workbooks(spark, str(tmp_path)).collect()}
    assert got["a.xlsx", "Second"] == ["2026-07-10", "2026-07-10", "46213", "46213", "2026-07-10", "1900-02-28"]
    assert got["a.xlsx", "First"] == ["1"]  # named by the relations, not by the files' numbers
    assert got["b.xlsx", "First"][0] == "2030-07-11"


def test_managed_tables(spark, tmp_path):
    a = spark.range(1000).selectExpr("id % 100 AS k", "id AS x")
    b = spark.range(100).selectExpr("id AS k", "id * 2 AS y")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS loads LOCATION '{tmp_path}/loads'")
    try:
        assert sheets.load_table(a, "loads.a", ["k", "absent"], 4) == "created" and sheets.load_table(b, "loads.b", ["k"], 4) == "created"
        assert sheets.stored_clustering(spark, "loads.a") == (["k"], 4)
        assert sheets.load_table(a.where("x < 500"), "loads.a", ["k"], 4) == "loaded" and spark.table("loads.a").count() == 500
        joined = spark.table("loads.a").hint("merge").join(spark.table("loads.b"), "k")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 500 and "SortMergeJoin" in plan and "Exchange" not in plan
        assert sheets.load_table(a, "loads.a", ["x"], 4) == "recreated" and sheets.stored_clustering(spark, "loads.a") == (["x"], 4)
        assert sheets.load_table(a, "loads.a") == "recreated" and sheets.load_table(b.selectExpr("k", "y AS x"), "loads.a") == "loaded" and spark.table("loads.a").count() == 100
        assert sheets.load_table(a.limit(0), "loads.a", ["k"]) == "skipped" and spark.table("loads.a").count() == 100
    finally:
        spark.sql("DROP DATABASE loads CASCADE")
