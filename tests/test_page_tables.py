"""Tables out of page cells, against what the rules say of small pages."""

from tallyspark.operators import page_tables as P


def rows(spark, pages, names="page long, row_idx long, cells array<string>"):
    return spark.createDataFrame([(p, i, r) for p, rs in pages.items() for i, r in enumerate(rs)], names)


def by_page(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.row_idx):
        out.setdefault(r.page, []).append(r.cells)
    return out


def test_merged_cells(spark):
    pages = {
        1: [["Pump", "", ""], ["", "40", "9"], ["", "50", ""], ["", "", ""], ["", "1", "2"], ["", "3", "4"]],  # a label, then a run without one
        2: [["", "7"], ["Valve", ""], ["", ""], ["Alone", ""]],  # the label may stand below; a run of one row stays
        3: [["a", "", "x"], ["", "1", "x"]],  # both fill the third column: no label
        4: [["L"], ["", "5"]],  # ragged rows keep their width
    }
    got = by_page(P.fill_merged(rows(spark, pages)))
    assert got[1] == [["Pump", "", ""], ["Pump", "40", "9"], ["Pump", "50", ""], ["", "", ""], ["", "1", "2"], ["", "3", "4"]]
    # of two rows that exclude each other the first is the label
    assert got[2] == [["", "7"], ["Valve", "7"], ["", ""], ["Alone", ""]]
    assert got[3] == pages[3] and got[4] == [["L"], ["L", "5"]]
    assert P.fill_merged(rows(spark, {}, "page long, row_idx long, cells array<string>")).count() == 0


def test_blocks_follow_the_first(spark):
    first = [["steel pump", "1.000", ""], ["brass valve", "2.500", "x"]]
    swapped = [["3.000", "iron pipe"], ["4.000", "soft hose"]]
    strange = [["iron bolts", "5.000", "", "QQQQQQQQQQQQQQQQQQQQQQQQ"]]
    df = spark.createDataFrame([(1, b, i, r) for b, block in enumerate((first, swapped, strange)) for i, r in enumerate(block)], "page long, block int, row_idx long, cells array<string>")
    got = {(r.block, r.row_idx): r.cells for r in P.align_blocks(df).collect()}
    assert got[0, 0] == ["steel pump", "1.000", ""] and got[0, 1] == ["brass valve", "2.500", "x"]
    assert got[1, 0] == ["iron pipe", "3.000", ""] and got[1, 1] == ["soft hose", "4.000", ""]
    assert got[2, 0] == ["iron bolts", "5.000", ""]  # the column that is like none goes


def test_table_rows(spark):
    lines = [["Water pumps", "", "", ""], *([f"pump {k}", "10", str(100 * k), "stray" if k == 3 else ""] for k in range(1, 13)), ["page", "", "", ""], ["Gas taps", "", "", ""], ["tap", "5", "70", ""]]
    got = P.table_rows(rows(spark, {1: lines, 2: [["Two words", ""], ["x", "1"]]})).orderBy("page", "row_idx").collect()
    one = [r for r in got if r.page == 1]
    assert [len(r.cells) for r in one] == [3] * 13  # the stray column is filled in one of thirteen rows
    assert [r.category for r in one] == ["Water pumps"] * 12 + ["Gas taps"]
    assert [(r.category, r.cells) for r in got if r.page == 2] == [("Two words", ["Two words", ""]), ("Two words", ["x", "1"])]  # no three table rows: all stay
    scanned = P.table_rows(rows(spark, {1: lines}), scanned=True).collect()
    assert {r.cells[0] for r in scanned} == {f"pump {k}" for k in range(1, 13)}  # no number of 100 or more: gone


def test_scanned_headers(spark):
    pages = {1: [["List", ""], ["x", "10"], ["Name", "Price"], ["Second", "Header"]], 2: [["a", "1"]] * 5 + [["Name", "Price"]], 3: [["Name", "", "Price"], ["1", "2", "3"]], 4: []}
    got = {r.page: (r.header_row, r.headers) for r in P.scanned_headers(rows(spark, pages)).collect()}
    assert got == {1: (2, ["Name", "Price"]), 3: (0, ["Name", "Column 2", "Price"])}
