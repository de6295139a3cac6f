"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]), so a document
costs time linear in its features.  Metadata are the document's length figures; labels, lang, source and
doc_id are no inputs.  The model is fitted on at most ``sample`` labelled rows (a documented bound; the
rows with the smallest hashes), every document is scored whole.

Defined cases: null and empty texts are scored from their (zero) statistics; a table without usable labels
gives the prior 0.5; rows with the same id are scored one by one; extra columns are ignored by the query and
kept by the pipeline's filter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_mod, table

BITS = 14
STATS = 20
SAMPLE = 3000
THRESHOLD = 0.7
_UPPER, _LOWER, _DIGIT, _ASCII_SPACE = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_ASCII_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CLASS = np.zeros(256, np.uint8)  # 0 other, 1 upper, 2 lower, 3 digit, 4 space, 5 non-ASCII, 6 sentence marks, 7 symbols
_CLASS[_UPPER], _CLASS[_LOWER], _CLASS[_DIGIT], _CLASS[_ASCII_SPACE], _CLASS[128:] = 1, 2, 3, 4, 5
for _c in b".,;:'\"-":
    _CLASS[_c] = 6
for _c in b"!?#$%&*|@<>{}[]\\/=+~^_`()":
    _CLASS[_c] = 7


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: STATS statistics, then hashed words with the square root of their share."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, m = len(raw), len(words)
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=8) / max(n, 1)
    codes = np.fromiter((crc32(w) for w in words), np.int64, m)
    slots, counts = np.unique(codes & ((1 << BITS) - 1), return_counts=True)
    lines = raw.split(b"\n")
    lens = np.fromiter(map(len, words), np.int64, m)
    marks = len(re.findall(rb"[.!?](?=\s|$)", raw))
    distinct = len(np.unique(codes))
    stats = np.array([
        *kinds,
        np.log1p(n) / 10,
        np.log1p(m) / 10,
        (lens.mean() if m else 0) / 10,
        (lens.std() if m else 0) / 10,
        distinct / max(m, 1),
        len(set(lines)) / len(lines),
        np.log1p(n / len(lines)) / 10,
        marks / max(m, 1),
        float((lens > 20).mean()) if m else 0.0,
        (counts.max() / m) if m else 0.0,
        kinds[1] / max(kinds[1] + kinds[2], 1e-9),
        len(set(words[:-1])) / max(m - 1, 1),
    ])
    return np.concatenate([np.arange(STATS), slots + STATS]), np.concatenate([stats, np.sqrt(counts / max(m, 1)) * 0.5])


@dataclass
class FactorisationMachine:
    bias: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.empty(0)
        idx, val, start = flat(rows)
        val = self._standard(idx, val)
        return 1 / (1 + np.exp(-np.clip(self._raw(idx, val, start)[0], -30, 30)))

    def _standard(self, idx, val):
        val = val.copy()
        head = idx < STATS
        val[head] = np.clip((val[head] - self.mean[idx[head]]) / self.scale[idx[head]], -4, 4)
        return val

    def _raw(self, idx, val, start):
        xv = self.v[idx] * val[:, None]
        sums = np.add.reduceat(xv, start, axis=0)
        pairs = 0.5 * ((sums**2).sum(1) - np.add.reduceat((xv**2).sum(1), start))
        return self.bias + np.add.reduceat(self.w[idx] * val, start) + pairs, sums


def flat(rows):
    sizes = np.array([len(r[0]) for r in rows])
    return np.concatenate([r[0] for r in rows]).astype(np.int64), np.concatenate([r[1] for r in rows]), np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)


def fit(rows, labels, rank: int = 4, epochs: int = 8, batch: int = 64, rate: float = 0.08, l2: float = 1e-3, seed: int = 5) -> FactorisationMachine:
    """Minibatch AdaGrad on the logistic loss."""
    rng = np.random.default_rng(seed)
    d = STATS + (1 << BITS)
    fm = FactorisationMachine(0.0, np.zeros(d), rng.normal(0, 0.02, (d, rank)), np.zeros(STATS), np.ones(STATS))
    y = np.asarray(labels, float)
    if not len(y):
        fm.v[:] = 0
        return fm
    p = np.clip(y.mean(), 0.01, 0.99)
    fm.bias = float(np.log(p / (1 - p)))
    head = np.array([r[1][:STATS] for r in rows])
    fm.mean, fm.scale = head.mean(0), head.std(0) + 1e-3
    gw, gv, gb = np.full(d, 1e-2), np.full((d, rank), 1e-2), 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), batch):
            take = order[at : at + batch]
            idx, val, start = flat([rows[i] for i in take])
            val = fm._standard(idx, val)
            raw, sums = fm._raw(idx, val, start)
            err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[take]) / len(take)
            of = np.repeat(np.arange(len(take)), np.diff([*start, len(idx)]))
            e = err[of] * val
            use, inv = np.unique(idx, return_inverse=True)
            dw = np.bincount(inv, e, len(use)) + l2 * fm.w[use] / 10
            grad = e[:, None] * (sums[of] - fm.v[idx] * val[:, None])
            dv = np.stack([np.bincount(inv, grad[:, f], len(use)) for f in range(rank)], 1) + l2 * fm.v[use]
            gw[use] += dw**2
            gv[use] += dv**2
            gb += err.sum() ** 2
            fm.w[use] -= rate * dw / np.sqrt(gw[use])
            fm.v[use] -= rate * dv / np.sqrt(gv[use])
            fm.bias -= rate * err.sum() / np.sqrt(gb)
    return fm


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", sample: int = SAMPLE, id_col="doc_id", text_col="text", training=None) -> FactorisationMachine:
    """Fits on at most ``sample`` labelled rows for which ``training`` (a Column over the id) holds."""
    chosen = labels.where(F.col(target).isNotNull() & F.col(id_col).isNotNull())
    if training is not None:
        chosen = chosen.where(training)
    chosen = chosen.groupBy(id_col).agg(F.max(target).alias("_q_label")).orderBy(F.xxhash64(id_col), id_col).limit(sample)  # a bound, so it may be broadcast

    def run(batches):
        for b in batches:
            got = [features(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1).cast(pa.int32()), pa.array([x[0].astype(np.int32).tobytes() for x in got], pa.binary()), pa.array([x[1].astype(np.float32).tobytes() for x in got], pa.binary())], names=["id", "label", "idx", "val"])

    rows = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).select(id_col, "_q_label", text_col).mapInArrow(run, "id long, label int, idx binary, val binary").collect()
    rows = sorted({(r.id, bytes(r.idx), bytes(r.val)): r for r in rows}.values(), key=lambda r: (r.id, bytes(r.idx)))
    return fit([(np.frombuffer(r.idx, np.int32), np.frombuffer(r.val, np.float32).astype(float)) for r in rows], [r.label for r in rows])


def score(docs: DataFrame, model: FactorisationMachine, text_col="text", out="score") -> DataFrame:
    """docs with a score column; whole texts, no shuffle."""
    cast = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])
    at, names = docs.columns.index(text_col), [*docs.columns, out]

    def run(batches):
        fm = cast.value
        for b in batches:
            parts = []
            for k in range(0, b.num_rows, 64):
                parts.append(fm.scores([features(t) for t in b.column(at).slice(k, 64).to_pylist()]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(parts) if parts else [], pa.float64())], names=names)

    return docs.mapInArrow(run, schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), "quality", training=id_mod("doc_id", 4) != 2)
    scored = score(docs.select("doc_id", (id_mod("doc_id", 4) == 2).alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))
