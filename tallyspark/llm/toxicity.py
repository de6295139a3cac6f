"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

1. At most ``sample`` labelled rows are the examples (a documented bound of the fit).  Every word of every example is
   a term; its document frequency is counted over all documents.  A weight is (1 + ln tf) * idf * rf^2, where
   rf = log2(2 + a / max(1, c)) is the relevance frequency of the term (a of the positive, c of the negative
   examples hold it); without it the nearest examples are those of like function words.
2. Examples become unit vectors, ordered so that like vectors lie together, in blocks.  Common terms are kept as a
   dense matrix with their largest weight in each block, rare ones as postings.
3. A query's bound for a block is its product with the block's largest weights of common terms plus the largest
   sum over its rare terms; blocks are opened from the highest bound on, until the k-th best cosine is above what
   is left, so the k nearest are exact.  All examples at the k-th cosine vote: ids play no part.
4. Votes weighted by cosine give a raw share, calibrated by bins fitted on leave-one-out votes of the
   examples.

Words that no example holds change a query's cosines by one common factor, which the shares do not feel; cosines
are over the words of the examples.

Defined cases: null or empty texts, and texts with none of the terms, take the share of such examples (with the
overall share as prior); without labels the score is 0; of several labels of an id the largest counts; repeated rows
are scored one by one; texts are read whole; extra columns are ignored; words are 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_WORDS, batches_of_bytes, hashed_words, id_mod, table

SAMPLE = 4000
BLOCK = 32
NEAREST = 15
THRESHOLD = 0.7
#: Queries that are answered together.
BATCH = 128


def counted_terms(texts):
    """Of each run of texts: number of the text, term, and how often it occurs there."""
    for first, run in batches_of_bytes(texts):
        h, _, _, at = hashed_words(run, ALNUM_WORDS)
        of = np.repeat(np.arange(len(run)), np.diff(at))
        order = np.lexsort((h, of))
        h, of = h[order], of[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
        cut = np.flatnonzero(new)
        yield first, len(run), of[cut], h[cut], np.diff([*cut, len(h)])


@dataclass
class BlockMaxIndex:
    """Unit vectors of labelled examples in blocks."""

    terms: np.ndarray  # sorted
    weight: np.ndarray  # of a term: idf * rf^2
    labels: np.ndarray = field(default_factory=lambda: np.empty(0))
    ids: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    empty: float = 0.0
    bins: np.ndarray | None = None

    def known(self, of: np.ndarray, h: np.ndarray, n: np.ndarray):
        """Rows (of, term number, weight), unit by ``of``."""
        if not len(self.terms):
            return of[:0], np.empty(0, np.int64), np.empty(0)
        t = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        ok = (self.terms[t] == h) & (self.weight[t] > 0)
        of, t = of[ok], t[ok]
        x = (1 + np.log(n[ok])) * self.weight[t]
        size = np.sqrt(np.bincount(of, x * x))[of] if len(of) else x
        return of, t, x / size

    def build(self, of: np.ndarray, t: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Takes in the examples' vectors; returns the places they got."""
        n = len(self.labels)
        cut = np.searchsorted(of, np.arange(n + 1))
        heads = [tuple(t[a:b][np.lexsort((t[a:b], -x[a:b]))[:3]].tolist()) for a, b in zip(cut, cut[1:])]
        order = sorted(range(n), key=lambda i: (heads[i], t[cut[i] : cut[i + 1]].tobytes(), x[cut[i] : cut[i + 1]].tobytes()))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.labels, self.ids = self.labels[order], self.ids[order]
        self.blocks = max(1, -(-n // BLOCK))
        of = place[of]
        df = np.bincount(t, minlength=len(self.terms))
        common = np.flatnonzero(df > max(BLOCK, n // 16))
        self.dense_of = np.full(len(self.terms), -1, np.int32)
        self.dense_of[common] = np.arange(len(common))
        d = self.dense_of[t]
        dense = np.zeros((self.blocks, len(common), BLOCK))
        dense[of[d >= 0] // BLOCK, d[d >= 0], of[d >= 0] % BLOCK] = x[d >= 0]
        self.dense, self.tops = dense, dense.max(2).T.copy() if len(common) else np.zeros((0, self.blocks))
        rare = np.flatnonzero(d < 0)
        rare = rare[np.lexsort((of[rare], t[rare]))]
        self.post_of, self.post_x = of[rare].astype(np.int32), x[rare]
        self.post_at = np.searchsorted(t[rare], np.arange(len(self.terms) + 1))
        return place

    def cosines(self, m: int, of: np.ndarray, t: np.ndarray, x: np.ndarray, k: int = NEAREST, without: np.ndarray | None = None):
        """For m queries: cosines with the examples (-1 where a block was not opened), and the k-th best of each."""
        wide = self.blocks * BLOCK
        d = self.dense_of[t]
        ask = np.zeros((m, self.dense.shape[1]))
        ask[of[d >= 0], d[d >= 0]] = x[d >= 0]
        r = np.flatnonzero(d < 0)
        many = self.post_at[t[r] + 1] - self.post_at[t[r]]
        to = np.repeat(self.post_at[t[r]] - np.cumsum(many) + many, many) + np.arange(many.sum())
        rare = np.bincount(np.repeat(of[r], many) * wide + self.post_of[to], np.repeat(x[r], many) * self.post_x[to], m * wide).reshape(m, self.blocks, BLOCK)
        bound = ask @ self.tops + rare.max(2) + 1e-9
        out = np.full((m, self.blocks, BLOCK), -1.0)
        shut = np.ones((m, self.blocks), bool)
        rows = np.arange(m)
        kth = np.full(m, -1.0)
        step = max(1, -(-2 * k // BLOCK))
        while True:
            left = np.where(shut, bound, -1.0)
            left[left < kth[:, None]] = -1.0
            if not (left > 0).any():
                break
            nth = np.partition(left, -min(step, self.blocks), axis=1)[:, -min(step, self.blocks)]
            go = (left >= nth[:, None]) & (left > 0)
            for b in np.flatnonzero(go.any(0)):
                q = np.flatnonzero(go[:, b])
                out[q, b] = ask[q] @ self.dense[b] + rare[q, b]
            shut &= ~go
            if without is not None:
                out[rows, without // BLOCK, without % BLOCK] = -1.0
            flat = out.reshape(m, wide)
            kth = np.partition(flat, wide - min(k, wide), axis=1)[:, wide - min(k, wide)]
            step *= 4
        return out.reshape(m, wide)[:, : len(self.labels)], kth

    def votes(self, m: int, of: np.ndarray, t: np.ndarray, x: np.ndarray, without: np.ndarray | None = None) -> tuple[np.ndarray, list]:
        """Share of positive votes of each query (nan without neighbours), and the ids of those that voted, nearest first."""
        share, proof = np.full(m, np.nan), [[] for _ in range(m)]
        if not len(self.labels):
            return share, proof
        for a in range(0, m, BATCH):
            z = min(a + BATCH, m)
            lo, hi = np.searchsorted(of, [a, z])
            cos, kth = self.cosines(z - a, of[lo:hi] - a, t[lo:hi], x[lo:hi], without=None if without is None else without[a:z])
            q, e = np.nonzero((cos > 1e-9) & (cos >= kth[:, None] - 1e-9))
            c = cos[q, e]
            total = np.bincount(q, c, z - a)
            share[a:z] = np.divide(np.bincount(q, c * self.labels[e], z - a), total, out=np.full(z - a, np.nan), where=total > 0)
            order = np.lexsort((e, -c, q))
            for i, j in zip((q[order] + a).tolist(), self.ids[e[order]].tolist()):
                proof[i].append(j)
        return share, proof

    def calibrate(self, m: int, of, t, x, place: np.ndarray) -> None:
        """Share of positives by tenth of the leave-one-out vote, kept monotone."""
        raw, _ = self.votes(m, of, t, x, without=place)
        y, ok = self.labels[place], ~np.isnan(raw)
        cell = np.minimum((raw[ok] * 10).astype(int), 9)
        hits, every = np.bincount(cell, y[ok], 10), np.bincount(cell, minlength=10)
        mid = (np.arange(10) + 0.5) / 10
        self.bins = np.maximum.accumulate((hits + 2 * mid) / (every + 2))

    def scores(self, m: int, of, h, n) -> tuple[np.ndarray, list]:
        raw, proof = self.votes(m, *self.known(of, h, n))
        none = np.isnan(raw)
        x = np.where(none, 0, raw) * 10 - 0.5
        low = np.clip(np.floor(x), 0, 8).astype(int)
        part = np.clip(x - low, 0, 1)
        got = self.bins[low] * (1 - part) + self.bins[low + 1] * part if self.bins is not None else np.zeros(m)
        return np.clip(np.where(none, self.empty, got), 0, 1), proof


def _frequency_task(cast):
    """How many texts of the task hold each term."""

    def run(batches):
        terms = cast.value
        total = np.zeros(len(terms), np.int64)
        docs = 0
        for b in batches:
            docs += b.num_rows
            for *_, h, _ in counted_terms(b.column(0)):
                t = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
                total += np.bincount(t[terms[t] == h], minlength=len(terms))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(total[at], docs), pa.int64())], names=["term", "n"])

    return run


def build_index(docs: DataFrame, labels: DataFrame, target="toxic", sample=SAMPLE, id_col="doc_id", text_col="text", training=None) -> BlockMaxIndex:
    chosen = labels.where(F.col(target).isNotNull() & F.col(id_col).isNotNull())
    if training is not None:
        chosen = chosen.where(training)
    chosen = chosen.groupBy(id_col).agg(F.max(target).cast("int").alias("_t_label")).orderBy(F.xxhash64(id_col), id_col).limit(sample)  # a bound, so it may be broadcast

    def words(batches):
        for b in batches:
            hs, ns = [], []
            for _, m, of, h, n in counted_terms(b.column(2)):
                cut = np.searchsorted(of, np.arange(m + 1))
                hs += [h[a:z].tobytes() for a, z in zip(cut, cut[1:])]
                ns += [n[a:z].astype("<i8").tobytes() for a, z in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1).cast(pa.int32()), pa.array(hs, pa.binary()), pa.array(ns, pa.binary())], names=["id", "label", "terms", "counts"])

    rows = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).select(id_col, "_t_label", text_col)
    got = rows.mapInArrow(words, "id long, label int, terms binary, counts binary").toArrow().to_pylist()  # the bounded sample
    got = list({r["id"]: r for r in sorted(got, key=lambda r: (r["id"], r["terms"], r["counts"]))}.values())
    hs = [np.frombuffer(r["terms"], np.uint64) for r in got]
    of = np.repeat(np.arange(len(got)), [len(h) for h in hs])
    h = np.concatenate(hs) if hs else np.empty(0, np.uint64)
    n = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in got]) if got else np.empty(0, np.int64)
    y = np.array([r["label"] for r in got], float)
    terms, t = np.unique(h, return_inverse=True)
    index = BlockMaxIndex(terms, np.zeros(len(terms)))
    if not len(terms):
        index.empty = float(y.mean()) if len(y) else 0.0
        return index
    counts = docs.select(text_col).mapInArrow(_frequency_task(docs.sparkSession.sparkContext.broadcast(terms)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # one row a term of the sample
    at, df = counts.column("term").to_numpy(), counts.column("n").to_numpy()
    every = np.ones(len(terms), np.int64)
    every[at[at >= 0]] = df[at >= 0]
    held, bad = np.bincount(t), np.bincount(t, y[of])
    index.weight = np.log1p(df[at < 0].sum() / every) * np.log2(2 + bad / np.maximum(1, held - bad)) ** 2
    has = np.bincount(of, minlength=len(got)) > 0
    index.empty = float((y[~has].sum() + y.mean()) / ((~has).sum() + 1))
    number = np.cumsum(has) - 1
    index.labels, index.ids = y[has], np.array([r["id"] for r in got], np.int64)[has]
    vectors = index.known(number[of], h, n)
    index.calibrate(len(index.labels), *vectors, place=index.build(*vectors))
    return index


def toxicity(docs: DataFrame, index: BlockMaxIndex, id_col="doc_id", text_col="text") -> DataFrame:
    """id, score, and the ids of the examples that voted, nearest first."""
    cast = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        for b in batches:
            scores, proof = [], []
            for _, m, of, h, n in counted_terms(b.column(1)):
                s, p = cast.value.scores(m, of, h, n)
                scores.append(s)
                proof += p
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(np.concatenate(scores) if scores else [], pa.float64()), pa.array(proof, pa.list_(pa.int64()))], names=["doc_id", "score", "evidence"])

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, score double, evidence array<long>")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = build_index(docs, table(spark, sf_dir, "labels"), training=id_mod("doc_id", 3) != 1)
    out = toxicity(docs, index)
    return out.select("doc_id", (id_mod("doc_id", 3) == 1).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"), "evidence")
