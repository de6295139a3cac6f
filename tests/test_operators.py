import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import geometry, joins, matching, profile, reshape, windows
from tallyspark.operators.aggs import distinct_with_null, mode_of
from tallyspark.plans.audit import anomalies
from tallyspark.plans.basics import insert_new
from tallyspark.plans.names import otsu
from tallyspark.plans.registry import FILE_ROLES, run_all
from tallyspark.sources import sheets


def test_quartile_equals_pandas(spark):
    for n in (2, 5, 9, 23):
        pdf = pd.DataFrame({"k": range(n), "x": [(i * 7) % 11 for i in range(n)]})
        df = spark.createDataFrame(pdf)
        want = pd.qcut(pdf.sort_values(["x", "k"])["x"].rank(method="first"), 4 if n >= 4 else n, labels=list(range(1, (4 if n >= 4 else n) + 1)))
        if n >= 4:
            got = windows.quartile(df, "x", "k", "q").toPandas().set_index("k")["q"]
            assert [got[k] for k in pdf.loc[want.index, "k"]] == want.astype(int).tolist()
    flat = spark.createDataFrame([(1, 5), (2, 5)], "k int, x int")
    assert {r.q for r in windows.quartile(flat, "x", "k", "q").collect()} == {2}


def test_windows(spark):
    df = spark.createDataFrame([(1, 10.0, "a"), (2, 0.0, None), (3, 5.0, None), (4, 5.0, "b")], "t int, v double, c string")
    got = df.select("t", windows.change_pct("v", "t").alias("p"), windows.average_rank("v").alias("r"), windows.carry_forward("c", "t").alias("f")).orderBy("t").collect()
    assert [(r.p, r.r, r.f) for r in got] == [(None, 4.0, "a"), (-100.0, 1.0, "a"), (None, 2.5, "a"), (0.0, 2.5, "b")]


def test_aggregates(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, None)], "k int, v string")
    assert {(r.k, r.n) for r in df.groupBy("k").agg(distinct_with_null(F.col("v")).alias("n")).collect()} == {(1, 3), (2, 1)}
    assert [(r.k, r.v) for r in mode_of(df, ["k"], "v").collect()] == [(1, "a")]


def test_joins(spark):
    a = spark.createDataFrame([(1, None, 1), (2, "x", 2)], "k int, s string, p int")
    b = spark.createDataFrame([(1, None, 5), (3, "y", 6)], "k int, s string, q int")
    assert {tuple(r) for r in joins.full_outer(a, b, ["k", "s"]).collect()} == {(1, None, 1, 5), (2, "x", 2, None), (3, "y", None, 6)}
    assert [r.k for r in joins.orphans(b, "k", a).collect()] == [3]
    r = spark.createDataFrame([(1, 0, None, 4.0), (1, 1, 3.0, None)], "k int, band int, lo double, hi double")
    v = spark.createDataFrame([(1, 3.5), (1, 9.0)], "k int, v double")
    assert {(x.v, x.band) for x in joins.in_range(v, r, "k", "v", "lo", "hi", "band").collect()} == {(3.5, 0), (9.0, 1)}
    got = insert_new(a.select("k"), spark.createDataFrame([(1, 9), (4, 2), (4, 1)], "k int, o int"), ["k"], ["o"]).collect()
    assert [tuple(r) for r in got] == [(4, 1)]


def test_reshape(spark):
    df = spark.createDataFrame([("a", 1.0, 0.0, None)], "k string, `Mo 01` double, `Mo 02` double, `Mo 03` double")
    assert [tuple(r) for r in reshape.unpivot_months(df, ["k"]).collect()] == [("a", 1.0, 1)]
    u = reshape.diagonal_union(df.select("k"), spark.createDataFrame([(1,)], "n int"))
    assert u.columns == ["k", "n"] and u.count() == 2


def test_header_roles_and_rules(spark):
    rows = [(0, ["PRICE LIST", "", ""]), (1, ["", "", ""]), (2, ["Product", "Code", "Price"])] + [(3 + i, [f"PUMP {i} W", f"EU{i}", f"{1000 + i}"]) for i in range(20)]
    m = spark.createDataFrame(rows, "row_idx long, cells array<string>")
    assert profile.header_row(m) == (2, ["Product", "Code", "Price"])
    t = sheets.typed(m)
    assert t.columns == ["row_idx", "Product", "Code", "Price"] and t.count() == 20
    roles = profile.assign_roles([r.asDict() for r in profile.column_stats(t.drop("row_idx")).orderBy("column_name").collect()])
    assert roles["product"] == "Product" and roles["price"] == "Price" and roles["code"] == "Code"
    found = {r.rule: r.occurrences for r in profile.cleaning_rules(spark.createDataFrame([("a-b  a",), ("x x",)], "v string"), "v").collect()}
    assert found == {"multispace": 1, "dash": 1, "dupword": 1}
    assert profile.resolve(["Invoice_Date"], ["Invoice Date"]) == "Invoice_Date"
    with pytest.raises(ValueError):
        profile.require(t, ["nope"])
    for name, role in (("Packing Summary 9 Jul.xlsx", "packing"), ("Invoice Summary.xlsx", "invoice"), ("Target 2026.xlsx", "target"), ("Visit Plan Report.xlsx", "visitplan"), ("SO Summary.xlsx", "so")):
        assert profile.detect_file_role(name, "", FILE_ROLES)[0] == role


def test_otsu(spark):
    df = spark.createDataFrame([(x,) for x in [0.1, 0.12, 0.15, 0.8, 0.85, 0.9]], "s double")
    assert 0.15 < otsu(df, "s").collect()[0][0] <= 0.8
    assert otsu(df.limit(2), "s", 0.65).collect()[0][0] == 0.65
    same = spark.createDataFrame([(0.5,)] * 5, "s double")
    assert otsu(same, "s", 0.65).collect()[0][0] == pytest.approx(0.675)


def test_anomalies(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([5.0, 6.0, 5.5, 4.5, 6.2, 100.0])], "v int, diff_pct double")
    got = {r.v: r.severity for r in anomalies(df).collect()}
    assert got[5] == "high" and got[0] == "none"
    none = spark.createDataFrame([(1, None), (2, None)], "v int, diff_pct double")
    assert {r.severity for r in anomalies(none).collect()} == {"none"}
    ten = spark.createDataFrame([(i, 10.0 + i % 2) for i in range(10)] + [(99, 40.0)], "v int, diff_pct double")
    assert {r.v: r.severity for r in anomalies(ten).collect()}[99] != "none"


def test_code_signal_and_tokens(spark):
    def signal(v, vt, i, it):
        s, w = matching.code_signal(F.lit(v).cast("string"), F.array(*map(F.lit, vt)).cast("array<string>"), F.lit(i).cast("string"), F.array(*map(F.lit, it)).cast("array<string>"))
        return tuple(spark.range(1).select(s, w).collect()[0])

    assert signal("EU-309", [], "EU309", []) == (1.0, 4.0)
    s, w = signal(None, ["PANASONIC", "EU", "309", "2500", "W"], "EU-309", [])
    assert s >= 0.99 and w > 0
    assert signal(None, ["A"], None, ["B"]) == (0.0, 0.0)
    df = spark.createDataFrame([(["PUMP", "100"], ["PUMP", "100"], [1.0, 1.0], [1.0, 1.0]), (["PUMPS"], ["PUMPX"], [1.0], [1.0]), ([], ["A"], [], [1.0])], "a array<string>, b array<string>, x array<double>, y array<double>")
    got = [r[0] for r in df.select(matching.token_similarity(*(F.col(c) for c in "abxy"))).collect()]
    assert got == [1.0, pytest.approx(0.72), 0.0]


def test_review_and_master(spark):
    res = spark.createDataFrame([(1, 10, "NEED_REVIEW", 0.5), (2, 20, "PARTIAL", 0.4), (3, 30, "MATCHED", 0.9)], "v int, i int, status string, confidence double")
    dec = spark.createDataFrame([(1, "replace", 11), (2, "reject", None)], "v int, action string, new_i int")
    assert {tuple(r) for r in matching.review(res, dec).collect()} == {(1, 11, "MATCHED", 1.0), (2, None, "UNMATCHED", 1.0), (3, 30, "MATCHED", 0.9)}
    m = spark.createDataFrame([("A", "c", 1, 2)], "vendor_name string, vendor_code string, i int, uses int")
    got = matching.upsert_master(m, spark.createDataFrame([("A", "d", 5), ("B", "e", 6)], "vendor_name string, vendor_code string, i int"))
    assert {tuple(r) for r in got.collect()} == {("A", "d", 5, 3), ("B", "e", 6, 1)}


def test_geometry(spark):
    words = [(1, t, x, x + 30.0, y, y + 8.0) for y, line in ((10.0, ["Name", "Price"]), (30.5, ["Pump", "1.000"]), (50.0, ["Valve", "250"])) for t, x in zip(line, (10.0, 200.0))]
    cells = geometry.words_to_cells(spark.createDataFrame(words, "page long, text string, x0 double, x1 double, y0 double, y1 double"))
    assert [r.cells for r in cells.orderBy("row_idx").collect()] == [["Name", "Price"], ["Pump", "1.000"], ["Valve", "250"]]
    assert geometry.cell_text(["1", ".000"]) == "1.000" and geometry.cell_text(["1", "2", "3"]) == "" and geometry.cell_text(["a", "b"]) == "a b"
    assert geometry.merge_header([["Net", "Qty"], ["Price", "Unit"], ["10", "20"]]) == (["Net Price", "Qty Unit"], 2)
    same = [{"numeric": 0.0, "mean_length": 8.0, "fill": 1.0}, {"numeric": 1.0, "mean_length": 4.0, "fill": 1.0}]
    assert geometry.align_columns(same, same) == {0: 0, 1: 1}
    prof = {r.column: r.numeric for r in geometry.column_profiles(cells).collect()}
    assert prof[0] == 0 and prof[1] == pytest.approx(2 / 3)


def test_sheets_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿x,y\n\n1,\"a,b\"\n")
    assert [(r.row_idx, r.cells) for r in sheets.read_csv_matrix(spark, str(tmp_path / "a.csv")).collect()] == [(0, ["x", "y"]), (2, ["1", "a,b"])]
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S" sheetId="1"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Name</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2.5</v></c></row></sheetData></worksheet>')
    m = sheets.read_workbooks(spark, str(tmp_path / "b.xlsx"))
    assert [(r.sheet, r.cells) for r in sheets.largest_sheet(m).collect()] == [("S", ["Name", "", "2.5"])]
    assert sheets.safe_names(["a b", "a-b", "1x"]) == ["a_b", "a_b_1", "_1x"] and sheets.safe_names(["a", "a"], "_2") == ["a", "a_2"] and sheets.safe_names(["a", "a"], drop=True) == ["a"]
    df = spark.createDataFrame([(1.0, "nan", "2026-01-02"), (float("inf"), "b", "x")], "v double, s string, the_date string")
    got = sheets.coerced(df).collect()
    assert got[0].s is None and got[1].v is None and got[0].the_date is not None and got[1].the_date is None
    sheets.save(df, str(tmp_path / "out"), cluster_by=["s"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    sheets.export_csv(spark.createDataFrame([("a,b", 1), ("c", 2)], "n string, x int"), str(tmp_path / "csv"), order=["n"], total=True)
    body = next((tmp_path / "csv").glob("part-*")).read_bytes().decode("utf-8-sig").replace("\r\n", "\n")
    assert body == 'n,x\n"a,b",1\nc,2\nTOTAL,3\n'
    maps = spark.createDataFrame([(1, {"a": "x"}), (2, {"b": "y"})], "k int, m map<string,string>")
    assert sheets.flattened(maps, "m").columns == ["k", "a", "b"]


def test_registry(spark):
    got = run_all(spark, "/root/testdata/sf0.001", {"events"})
    assert got["daily"]["status"] == "SKIPPED" and got["marketing"]["status"] == "COMPLETED" and "q_visit_status" in got["tracker"]["tables"]


def test_a_long_page_is_not_cut_row_by_row():
    import time

    import numpy as np
    import pandas as pd

    class Grouped:  # takes the function that works on a page
        groupBy = lambda self, key: self

        def applyInPandas(self, f, schema):
            return f

    n = 8000
    pdf = pd.DataFrame({"page": 1, "x0": [10.0, 120.0] * n, "x1": [60.0, 150.0] * n, "y0": np.repeat(np.arange(n) * 12.0, 2), "text": [t for k in range(n) for t in (f"no{k}", str(k))]})
    start = time.time()
    out = geometry.words_to_cells(Grouped())((1,), pdf)
    assert out["cells"].tolist() == [[f"no{k}", str(k)] for k in range(n)]
    assert time.time() - start < 4


def test_activities_count_an_invoice_once_a_day(spark, tmp_path):
    """Lines and orders that come twice; due and paid dates; no activity is made distinct by shuffling every line."""
    from tallyspark.plans import monitoring

    day = "timestamp'1995-03-01'"
    spark.sql(f"select * from values (1L, 7L, 'O', 100d, {day}, '1-A'), (1L, 7L, 'O', 100d, {day}, '5-H'), (2L, 7L, 'O', 50d, {day}, '4-D') t(o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority)").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("select 7L as c_custkey, 'BUILDING' as c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    spark.sql(f"select *, 10d as l_extendedprice, 0d as l_discount, 'F' as l_linestatus from values (1L, 'A', {day}), (1L, 'N', {day}), (2L, 'N', {day}), (2L, 'N', null) t(l_orderkey, l_returnflag, l_shipdate)").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = monitoring.daily_activity(spark, str(tmp_path))
    assert "Expand" not in got._jdf.queryExecution().optimizedPlan().toString() and "distinct" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = got.where("salesman = 'SLP01'").collect()
    so = next(r for r in rows if r.has_so)
    assert (so.so_count, so.quotation_count, so.gross_so_value, so.status_groups) == (1, 0, 200.0, "SO On Hold / Approval, Sales Order Active")
    act = {(k, str(r.activity_date)): (r[f"{k}_count"], r[f"{k}_value"]) for r in rows for k in ("invoice", "payment", "due", "past_due") if r[f"has_{k}"]}
    assert act == {("invoice", "1995-03-01"): (1, 40.0), ("payment", "1995-03-21"): (1, 20.0), ("due", "1995-03-31"): (1, 40.0), ("past_due", "1995-03-31"): (1, 20.0)}
    other = {(k, str(r.activity_date)) for r in got.where("salesman = 'SLP02'").collect() for k in ("invoice", "payment", "due", "past_due") if r[f"has_{k}"]}
    assert other == {(k, d) for k, d in (("invoice", "1995-03-01"), ("due", "1995-03-31"), ("past_due", "1995-03-31"), ("invoice", "None"), ("due", "None"), ("past_due", "None"))}


def test_lines_of_an_invoice_are_dealt_out_by_the_number_of_lines(spark, monkeypatch):
    """What a task holds follows ``most``, not the table; where the lines lie changes no result."""
    from tallyspark.operators import stage
    from tallyspark.plans import daily

    sf = "/root/testdata/sf0.001"
    names = ("q_salesman_daily", "q_invoice_prepared", "q_sku_monthly", "q_branch_daily", "q_daily_sales")
    plain = {n: {tuple(r) for r in daily.QUERIES[n](spark, sf).collect()} for n in names[:3]}
    monkeypatch.setitem(stage.dealt.__kwdefaults__, "most", 300)
    for n in names:
        got = daily.QUERIES[n](spark, sf)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression [l_orderkey" in plan
        if n in plain:
            assert {tuple(r) for r in got.collect()} == plain[n]


def test_trend_and_key_figures_read_the_lines_once(spark, monkeypatch):
    """Each joined table is scanned once, and lines are not summed for every period."""
    from tallyspark.plans import kpis, report

    sf = "/root/testdata/sf0.001"
    assert report.trend_stats(spark, sf)._jdf.queryExecution().optimizedPlan().toString().count("l_orderkey#") <= 4
    kept = []
    monkeypatch.setattr(kpis, "staged", lambda df, name: kept.append(df) or df.sparkSession.createDataFrame(df.collect(), df.schema))
    kpis.report_kpis(spark, sf)
    lines, sums = kept
    assert lines.columns == ["invoice_date", "branch", "salesman", "sku", "net", "status"] and "l_orderkey" not in sums._jdf.queryExecution().optimizedPlan().toString()


def test_monitoring_deals_out_short_rows_once(spark, tmp_path):
    """Lines and orders that come twice, an order without due lines, sums as SQL has them; wide rows are not shuffled."""
    import duckdb

    from tallyspark.plans import monitoring

    day = "timestamp'1995-03-01'"
    spark.sql(f"select * from values (1L, 7L, 'O', 100.25d, {day}, '1-A'), (1L, 7L, 'O', 100.25d, {day}, '5-H'), (2L, 7L, 'O', 50d, {day}, '4-D'), (92L, 8L, 'O', 70d, {day}, '1-A'), (182L, 8L, 'F', null, {day}, '1-A') t(o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority)").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("select * from values (7L, 'BUILDING'), (8L, null) t(c_custkey, c_mktsegment)").write.parquet(f"{tmp_path}/customer.parquet")
    spark.sql(f"select *, 10.05d as l_extendedprice, 0d as l_discount, 'F' as l_linestatus from values (1L, 'A', {day}), (1L, 'N', {day}), (2L, 'N', {day}), (2L, 'N', null), (92L, 'A', {day}), (182L, 'N', {day}), (182L, 'N', {day}) t(l_orderkey, l_returnflag, l_shipdate)").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for t in ("orders", "customer", "lineitem"):
        con.sql(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    for name in ("q_customer_monitoring", "q_sales_monitoring"):
        got = monitoring.QUERIES[name](spark, str(tmp_path))
        assert "past_due_value" not in got._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression", 1)[1]
        got.write.parquet(f"{tmp_path}/{name}")
        cols = ", ".join(got.columns)
        want, have = f"select {cols} from ({monitoring.SQL[name]})", f"select {cols} from read_parquet('{tmp_path}/{name}/*.parquet')"
        assert con.sql(f"{want} except all {have}").fetchall() == [] and con.sql(f"{have} except all {want}").fetchall() == []
