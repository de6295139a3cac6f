"""Meaning of columns over many sheets at once."""

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import columns as C


def cells(spark, sheets):
    """sheets: name -> (headers, rows)."""
    m = spark.createDataFrame([(s, i, r) for s, (_, rows) in sheets.items() for i, r in enumerate(rows)], "sheet string, row_idx long, cells array<string>")
    return C.cells_long(m, spark.createDataFrame([(s, h) for s, (h, _) in sheets.items()], "sheet string, headers array<string>"))


def test_roles_of_two_sheets(spark):
    names = ["Pump heavy duty", "Valve brass long", "Pipe steel short", "Hose rubber thick", "Tank plastic large", "Tap chrome plated"]
    a = (["Nama Barang", "Harga", "Harga PPN", "Kode", "Aturan", "Jenis", ""], [[n, str(1000 + 137 * k), str((1000 + 137 * k) * 1.11), f"AB{k}9X", f">= {k}", "AIR" if k % 2 else "GAS", ""] for k, n in enumerate(names)])
    b = (["x", "y"], [[n.upper() + " B", f"{k},50"] for k, n in enumerate(names)])
    both = cells(spark, {"a": a, "b": b})
    cross = C.cross_similarity(both.where("sheet = 'a'"), both.where("sheet = 'b'"))
    assert {(r.col, r.other_col): r.similarity for r in cross.collect()} == {(0, 0): 1.0}
    stats = C.role_scores(C.profiles(both).join(cross.where("other_col = 0").selectExpr("sheet", "col", "similarity AS cross"), ["sheet", "col"], "left"))
    got = {(r.sheet, r.role): r.header for r in C.assign_roles(stats, both).collect()}
    assert got["a", "product"] == "Nama Barang" and got["a", "price"] in ("Harga", "Harga PPN") and got["a", "code"] == "Kode" and got["a", "qtyRule"] == "Aturan"
    assert got["b", "product"] == "x" and got["b", "price"] == "y"
    assert {r.col for r in C.price_derived_columns(both, spark.createDataFrame([("a", 1)], "sheet string, price int")).collect()} == {2}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_and_words_are_not_broadcast(spark, tmp_path):
    sheet = spark.range(50).selectExpr("'a' AS sheet", "id AS row_idx", "array('pump ' || id, 'x') AS cells")
    sheet.write.parquet(str(tmp_path / "sheet"))
    long = C.cells_long(spark.read.parquet(str(tmp_path / "sheet")), spark.createDataFrame([("a", ["n", "m"])], "sheet string, headers array<string>"))
    p = plan(long)  # the names are broadcast, the cells neither that nor shuffled
    assert "BroadcastHashJoin" in p and "BuildRight" in p and "BuildLeft" not in p and "SortMergeJoin" not in p
    long.write.parquet(str(tmp_path / "long"))
    cells = spark.read.parquet(str(tmp_path / "long"))
    cross = C.cross_similarity(cells, cells.withColumn("sheet", F.lit("b")))
    assert "SortMergeJoin [word" in plan(cross)
    assert {(r.col, r.other_col): r.similarity for r in cross.collect()} == {(0, 0): 1.0}


def test_tracker_roles(spark):
    hints = {"salesman": ["salesman", "sales"], "visit_date": ["visit date"], "status": ["status"]}
    rows = [["An", "Budi", "31/12/2025", "x"], ["An", "Budi", "2026-01-02", ""], ["An", "Budi", "soon", "2026-01-02"]]
    by_header = (["Sales", "Salesman", "When", "Visit Date"], rows)
    by_cells = (["Sales", "b", "When", "Status"], rows)
    none = (["a", "b"], [["1", "2"]])
    got = C.tracker_roles(C.date_ratios(cells(spark, {"h": by_header, "c": by_cells, "n": none})), hints)
    # the earliest keyword wins over the first column; a date is read out of the cells where no header tells
    assert {(r.sheet, r.role, r.col) for r in got.collect()} == {("h", "salesman", 1), ("h", "visit_date", 3), ("c", "salesman", 0), ("c", "visit_date", 2), ("c", "status", 3)}


@pytest.mark.parametrize("names,want", [(["Price Volume", "Line_Volume"], "Line_Volume"), (["Volume Target", "Total liter"], "Total liter"), (["Qty"], None), ([], None)])
def test_measure_column(names, want):
    assert C.measure_column(names, ["Volume", "Line Volume"], ["volume", "liter"], ["target", "price"]) == want


def test_days_of_every_format_are_counted(spark):
    values = ["2024-03-01", "01/03/2024", "01-03-2024", "1/3/2024", "2024-03-01 10:00", "17", "O", "12.50", "-3", "a/b", "31/31/2024", "P-12"]
    df = spark.createDataFrame([("s", i, 0, "h", v) for i, v in enumerate(values)], "sheet string, row_idx int, col int, header string, v string")
    assert [r.dates for r in C.date_ratios(df).collect()] == [5 / 12]
