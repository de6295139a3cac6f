"""Licence scan: Aho-Corasick over normalised words and over tag lines, shunting-yard for expressions.

Two automata are built once per task.  One runs over the document's words joined by single spaces and
finds notice phrases; the other runs over the raw lower-cased bytes and finds identifier tags, whose
expression (up to the end of the line) is put in postfix order and evaluated: ``or`` gives a choice,
``and`` a conjunction, ``with`` binds an exception to its licence.

Defined cases: null or empty text gives 0 words, no labels ('') and score 0; texts are read whole;
an expression that does not parse yields the known identifiers it names; equal rows give equal rows.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import alnum_words, table

# The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Notice phrases that the scan adds.
NOTICES = {
    "mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license": "apache-2",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "redistribution and use in source and binary forms": "bsd",
    "bsd 3 clause": "bsd-3-clause",
    "bsd 2 clause": "bsd-2-clause",
    "permission to use copy modify and or distribute this software": "isc",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "all rights reserved": "all-rights-reserved",
    "public domain": "public-domain",
}
TAGS = ("spdx-license-identifier:", "license-expression:", "licence-expression:")
# Identifiers whose label differs from the identifier in lower case.
ALIASES = {"apache-2.0": "apache-2", "apache2": "apache-2", "cc-by-nc-4.0": "cc-by-nc", "cc-by-nc-3.0": "cc-by-nc"}
RANK = {"with": 3, "and": 2, "or": 1}
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+-]+(?::[A-Za-z0-9.+-]+)?")
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions string"


def postfix(expression: str) -> list[str] | None:
    """Shunting-yard; None if the expression is not well formed."""
    out: list[str] = []
    stack: list[str] = []
    operand = False
    for tok in _TOKEN.findall(expression):
        low = tok.lower()
        if tok == "(":
            if operand:
                return None
            stack.append(tok)
        elif tok == ")":
            if not operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif low in RANK:
            if not operand:
                return None
            while stack and stack[-1] != "(" and RANK[stack[-1]] >= RANK[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = False
        else:
            if operand:
                break  # prose after the expression
            out.append(low)
            operand = True
    if not operand:
        return None
    while stack:
        if stack[-1] == "(":
            return None
        out.append(stack.pop())
    return out


def evaluate(expression: str) -> tuple[set[str], int]:
    """Labels that the expression names, and the number of ways (choices) to satisfy it.

    Only sets and counts are kept, so nested expressions do not grow with their choices."""

    def label(name):
        if name.endswith("+"):  # or later
            name = name[:-1] if f"{name[:-1]}-or-later" not in KNOWN else f"{name[:-1]}-or-later"
        return ALIASES.get(name, name)

    rpn = postfix(expression)
    if rpn is None:
        names = {t.lower() for t in _TOKEN.findall(expression) if t not in "()" and t.lower() not in RANK}
        return {label(n) for n in names if n.rstrip("+") in KNOWN}, 0
    stack: list[tuple[set[str], int]] = []
    for tok in rpn:
        if tok in RANK:
            if len(stack) < 2:
                return set(), 0
            (b, nb), (a, na) = stack.pop(), stack.pop()
            if tok == "with":
                stack.append(({f"{x} with {y}" for x in a for y in b}, na))
            else:
                stack.append((a | b, na + nb if tok == "or" else na * nb))
        else:
            stack.append(({label(tok)}, 1))
    labels, ways = stack[-1]
    return {x for x in labels if x.split(" with ")[0] in LABELS}, ways


LABELS = set(BASE.values()) | set(NOTICES.values()) | {"gpl-2.0", "gpl-2.0-only", "gpl-2.0-or-later", "gpl-3.0", "gpl-3.0-only", "gpl-3.0-or-later", "lgpl-2.1", "lgpl-2.1-only", "lgpl-3.0", "lgpl-3.0-only", "agpl-3.0", "agpl-3.0-only", "mpl-2.0", "epl-2.0", "0bsd", "unlicense", "cc0-1.0", "cc-by-4.0", "cc-by-sa-4.0", "zlib", "bsl-1.0", "wtfpl"}
KNOWN = LABELS | set(ALIASES)


@lru_cache(maxsize=1)
def automata():
    words = ahocorasick.Automaton()
    for phrase, label in NOTICES.items():
        words.add_word(f" {phrase} ", (len(phrase), label, False))
    for phrase, label in BASE.items():
        words.add_word(f" {phrase} ", (len(phrase), label, True))
    words.make_automaton()
    tags = ahocorasick.Automaton()
    for tag in TAGS:
        tags.add_word(tag, tag)
    tags.make_automaton()
    return words, tags


def scan(text: str | None) -> tuple:
    """n_words, n_base, first, last, base labels, labels, score, expressions of one whole text."""
    words, tags = automata()
    toks = alnum_words(text)
    line = (b" " + b" ".join(toks) + b" ").decode("latin-1")
    n, starts, base, labels = 0, [], set(), set()
    for end, (size, label, is_base) in words.iter(line):
        labels.add(label)
        if is_base:
            n += 1
            base.add(label)
            starts.append(end - size - 1)
    at = index = 0
    for k, start in enumerate(sorted(starts)):  # places become word numbers
        index += line.count(" ", at, start)
        at, starts[k] = start, index
    found: list[str] = []
    ways = 0
    if text and ":" in text:
        low = text.encode("utf-8", "surrogatepass").lower().decode("latin-1")
        for end, _ in tags.iter(low):
            stop = low.find("\n", end + 1)
            rest = low[end + 1 : stop if stop >= 0 else len(low)].strip(" \t\r*/#-<!>")
            names, k = evaluate(rest)
            labels |= names
            ways = max(ways, k)
            if names:
                found.append(rest)
    n_tags = len(found)
    score = 1.0 - 0.5 ** (2 * (n_tags + (n > 0)) + len(labels)) if labels else 0.0
    return len(toks), n, min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, "; ".join(sorted(set(found)))


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document; whole texts, one pass, no shuffle."""

    def run(batches):
        for b in batches:
            got = [scan(t) for t in b.column(1).to_pylist()]
            cols = list(zip(*got)) if got else [()] * 8
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:6]), pa.array(cols[6], pa.float64()), pa.array(cols[7], pa.string())], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(id_col, text_col).mapInArrow(run, SCHEMA)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(table(spark, sf_dir, "documents"))
