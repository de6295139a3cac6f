"""Tables out of positioned words (page, text, x0, x1, y0, y1): rows, columns, cells, wrapped headers."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import carry_forward


def cluster_rows(y: np.ndarray) -> np.ndarray:
    """Row number of each word: words within half the median gap of a row's first word share the row."""
    kinds = np.unique(y)
    tol = max(1.0, float(np.median(np.diff(kinds))) / 2) if len(kinds) > 1 else 1.0
    out, anchor, row = np.zeros(len(y), int), None, -1
    for i in np.argsort(y, kind="stable"):
        if anchor is None or y[i] - anchor > tol:
            anchor, row = y[i], row + 1
        out[i] = row
    return out


def column_bounds(x0: np.ndarray, x1: np.ndarray, rows: np.ndarray) -> list[float]:
    """Middles of the gaps that (nearly) no row covers and that are wide enough."""
    low, high = int(np.floor(x0.min())), int(np.ceil(x1.max()))
    cover, upto, start = np.zeros(high - low + 1), low, None
    order = np.lexsort((x0, rows))
    for r, a, b in zip(rows[order], x0[order], x1[order]):  # row by row from the left, a point is counted once a row
        upto, start = (low, r) if r != start else (upto, start)
        end = int(np.ceil(b))
        cover[max(int(a), upto) - low : max(end - low, 0)] += 1
        upto = max(upto, end)
    free = cover <= max(1, 0.15 * len(np.unique(rows)))
    edge = np.flatnonzero(np.diff(np.concatenate([[0], free.view(np.int8), [0]])))
    wide = max(10, 0.015 * (high - low))
    return [low + (a + b) / 2 for a, b in zip(edge[::2], edge[1::2]) if b - a >= wide and a > 0 and b < len(cover)]


def cell_text(parts: list[str]) -> str:
    """Words of a cell; a number cut in two is glued, other pieces of numbers cannot be trusted."""
    number = [bool(re.fullmatch(r"[\d.,]+", p)) for p in parts]
    if len(parts) > 1 and all(number):
        return "".join(parts) if len(parts) == 2 and re.fullmatch(r"[.,]?\d{3}", parts[1]) else ""
    return " ".join(parts)


def words_to_cells(words: DataFrame) -> DataFrame:
    """(page, row_idx, cells) of words, page by page (a page is a bounded group)."""

    def page(key, pdf):
        rows = cluster_rows(pdf["y0"].to_numpy())
        bounds = column_bounds(pdf["x0"].to_numpy(), pdf["x1"].to_numpy(), rows)
        col = np.searchsorted(bounds, (pdf["x0"] + pdf["x1"]).to_numpy() / 2)
        text, cells = pdf["text"].to_numpy(), [[[] for _ in range(len(bounds) + 1)] for _ in range(rows.max() + 1)]
        for k in np.argsort(pdf["x0"].to_numpy(), kind="stable"):
            cells[rows[k]][col[k]].append(text[k])
        return pd.DataFrame({"page": key[0], "row_idx": np.arange(len(cells)), "cells": [[cell_text(c) for c in r] for r in cells]})

    return words.groupBy("page").applyInPandas(page, "page long, row_idx long, cells array<string>")


def column_profiles(cells: DataFrame) -> DataFrame:
    """Share of numbers, mean length and fill of each column of each page."""
    c = cells.select("page", F.posexplode("cells").alias("column", "v"))
    full = F.col("v") != ""
    n = F.count(F.when(full, 1))
    return c.groupBy("page", "column").agg(F.try_divide(F.count(F.when(full & F.col("v").rlike(r"^[\d.,()\-]+$"), 1)), n).alias("numeric"), F.try_divide(F.sum(F.when(full, F.length("v"))), n).alias("mean_length"), (n / F.count("*")).alias("fill"))


def align_columns(base: list[dict], other: list[dict]) -> dict[int, int]:
    """Column of ``other`` to column of ``base``: same place if alike, else the most alike free one, else none."""

    def like(a, b):
        num = abs((a["numeric"] or 0) - (b["numeric"] or 0))
        x, y = a["mean_length"] or 0, b["mean_length"] or 0
        return 1 - (0.5 * num + 0.3 * abs(x - y) / max(x, y, 1) + 0.2 * abs(a["fill"] - b["fill"]))

    out: dict[int, int] = {}
    for k, o in enumerate(other):
        if k < len(base) and k not in out.values() and like(base[k], o) >= 0.45:
            out[k] = k
            continue
        best = max(((like(b, o), -i) for i, b in enumerate(base) if i not in out.values()), default=(0, 0))
        if best[0] > 0.55:
            out[k] = -best[1]
    return out


def merge_header(rows: list[list[str]]) -> tuple[list[str], int]:
    """Header cells out of wrapped lines above the first row with numbers, and that row's place."""
    width = max(map(len, rows))
    first = next((i for i, r in enumerate(rows) if sum(bool(re.search(r"\d", c)) for c in r) >= 2), len(rows))
    top = first
    while top > 0 and sum(map(bool, rows[top - 1])) >= max(2, width / 2):
        top -= 1
    return [" ".join(r[j] for r in rows[top:first] if j < len(r) and r[j]) for j in range(width)], first


def tabular_rows(cells: DataFrame) -> DataFrame:
    """Rows with enough cells filled, and the section titles between them carried forward."""
    width = F.max(F.size("cells"))
    w = cells.groupBy("page").agg(width.alias("width"))
    filled = F.size(F.filter("cells", lambda c: c != ""))
    df = cells.join(F.broadcast(w), "page").withColumn("filled", filled)
    title = F.when(F.col("filled") == 1, F.array_join(F.filter("cells", lambda c: c != ""), " "))
    df = df.withColumn("_title", title).withColumn("category", carry_forward("_title", "row_idx", ["page"]))
    return df.where(F.col("filled") >= F.greatest(F.lit(2), F.col("width") / 2)).select("page", "row_idx", "category", "cells")
