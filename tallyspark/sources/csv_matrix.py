"""CSV files of any size as string matrices.

Spark splits the files; a split can begin inside a quoted field.  A line moves the reader between two states, outside
and inside quotes, so a split is one of four maps of two states.  One pass finds each split's map and the records
that it begins in either state; a window over the splits of a file composes the maps; a second pass reads every split
from its true state.  Records that cross the end of a split come out in pieces, which are put together by their number."""

from __future__ import annotations

import csv
from io import StringIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.stage import small, staged

MATRIX = "path string, sheet string, row_idx long, cells array<string>"
#: Splits that are broadcast to the second pass (some 100 bytes each); beyond it lines are joined and sorted.
FEW_SPLITS = 500_000


def ends_inside(line: str, inside: bool) -> bool:
    """Does a line that begins inside (or outside) a quoted field end inside one?  Quotes count where a field begins."""
    if '"' not in line:
        return inside
    at, n = 0, len(line)
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('""', at):
                at += 2
                continue
            at, inside = at + 1, False
        elif at < n and line[at] == '"' and (at == 0 or line[at - 1] == ","):
            at, inside = at + 1, True
            continue
        at = line.find(",", at) + 1
        if at == 0:
            return False


def cells_of(record: str) -> list[str]:
    if '"' not in record:
        return [c.strip() for c in record.split(",")]
    return [c.strip() for c in next(csv.reader(StringIO(record, newline="")), [])]


def _maps(batches):
    """Per split: where each state leads, and records begun when read from it."""
    now, state, begun = None, [False, True], [0, 0]

    def row():
        return pa.RecordBatch.from_pydict({"path": [now[0]], "block": [now[1]], "from_out": [state[0]], "from_in": [state[1]], "n_out": [begun[0]], "n_in": [begun[1]]})

    for b in batches:
        for path, block, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            if (path, block) != now:
                if now:
                    yield row()
                now, state, begun = (path, block), [False, True], [0, 0]
            for k in (0, 1):
                begun[k] += not state[k]
                state[k] = ends_inside(line, state[k])
    if now:
        yield row()


def _records(batches):
    """Whole records (piece is null) and pieces of those that cross an end of the split."""
    now, out, parts, inside, row, piece = None, [], [], False, 0, None

    def flush():
        got = out[:]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["path", "row_idx", "piece", "record"])

    for b in batches:
        for path, block, line, begins_inside, base in zip(*(b.column(k).to_pylist() for k in range(5))):
            if (path, block) != now:
                if parts:
                    out.append((now[0], row, now[1], "\n".join(parts)))
                now, parts, inside = (path, block), [], begins_inside
                row, piece = base - 1, begins_inside
            if not inside and not parts:
                row, piece = row + 1, False
            parts.append(line)
            inside = ends_inside(line, inside)
            if not inside:
                out.append((path, row, block if piece else None, "\n".join(parts)))
                parts = []
        if out:
            yield flush()
    if parts:
        out.append((now[0], row, now[1], "\n".join(parts)))
    if out:
        yield flush()


def _split_up(batches):
    for b in batches:
        path, row, record = b.column(0), b.column(1), b.column(2).to_pylist()
        cells = [cells_of(r) for r in record]
        kept = [k for k, c in enumerate(cells) if any(c)]
        take = pa.array(kept, pa.int64())
        yield pa.RecordBatch.from_arrays([path.take(take), pa.array(["csv"] * len(kept), pa.string()), row.take(take), pa.array([cells[k] for k in kept], pa.list_(pa.string()))], names=["path", "sheet", "row_idx", "cells"])


def read_csv_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row_idx, cells): every record as trimmed strings, no header assumed; row_idx counts records from 0,
    blank ones too, which are dropped.  Line ends inside quotes become \\n; a field left open takes the rest of the file."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    maps = staged(lines.mapInArrow(_maps, "path string, block long, from_out boolean, from_in boolean, n_out long, n_in long"), "csv-splits")
    before = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    constant, swaps = F.col("from_out") == F.col("from_in"), (F.col("from_out") & ~F.col("from_in")).cast("int")
    known = maps.withColumn("turns", F.sum(swaps).over(W.partitionBy("path").orderBy("block")))
    last = F.last(F.when(constant, F.struct(F.col("from_out").cast("int").alias("state"), "turns")), ignorenulls=True).over(before)
    known = known.withColumns({"last": last, "gone": F.coalesce(F.sum(swaps).over(before), F.lit(0))})
    inside = (F.coalesce(F.col("last.state"), F.lit(0)) + F.col("gone") - F.coalesce(F.col("last.turns"), F.lit(0))) % 2 == 1
    known = known.withColumn("inside", inside)
    begun = F.when(F.col("inside"), F.col("n_in")).otherwise(F.col("n_out"))
    starts = staged(known.select("path", "block", "inside", F.coalesce(F.sum(begun).over(before), F.lit(0)).alias("base")), "csv-starts")
    few = small(starts, FEW_SPLITS)
    placed = lines.withColumn("line", F.monotonically_increasing_id()).join(few, ["path", "block"])
    if few is starts:  # the join shuffles
        placed = placed.repartition("path", "block").sortWithinPartitions("path", "block", "line")
    records = staged(placed.select("path", "block", "value", "inside", "base").mapInArrow(_records, "path string, row_idx long, piece long, record string"), "csv-records")
    pieces = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "record"))), lambda x: x["record"]), "\n")
    crossing = records.where("piece is not null").groupBy("path", "row_idx").agg(pieces.alias("record"))  # few: one at an end of a split
    return records.where("piece is null").select("path", "row_idx", "record").unionByName(crossing).mapInArrow(_split_up, MATRIX)
