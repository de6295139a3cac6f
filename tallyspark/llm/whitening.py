"""Whitening of embeddings by Chan's merging of counts, means and centred scatters.

Every partition of the distinct x vectors keeps a count, local mean and centred scatter, block by block;
treeReduce merges them pairwise (Chan, Golub, LeVeque); the driver takes the eigenvectors of one d x d
matrix; a second pass whitens the same vectors, merges again and measures the distance of their
covariance from the identity.  Only such moments, of size d^2, reach the driver.

Defined cases: vectors that are null or hold null or non-finite entries take no part; an empty vector has
no component, and no row; vectors of several lengths are fitted apart, each length with its own n, and
identity_error is the largest over all lengths; x of entries beyond 2^62 / 64 is that of the bound;
components of no variance (a single vector, fewer vectors than dimensions, a constant entry) have a null
whitened value, explain what their eigenvalue says, and take no part in identity_error; repeated rows
count once in the fit and are each returned; null or repeated ids are ids as any; an empty table gives an
empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged, table

#: Fixed by the contract: x = floor(SCALE * c) + SHIFT; components returned.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
_BOUND = float(1 << 62)
#: Entries of a block of vectors that is worked on at once (16 MB as doubles).
_BLOCK = 1 << 21


def blocks(col):
    """(row numbers, matrix) of an Arrow list column, lengths apart, in blocks of bounded size; rows that are
    null, empty, or hold null entries or non-finite numbers are left out."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    sizes = np.asarray(col.value_lengths().fill_null(0), np.int64)
    flat = col.flatten()
    whole = flat.type == pa.int64() and not flat.null_count  # x vectors stay whole numbers
    values = np.asarray(flat if whole else flat.cast(pa.float64()).fill_null(np.nan))
    ends = np.cumsum(sizes)
    wrong = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    good = (sizes > 0) & (wrong[ends] == wrong[ends - sizes])
    for d in np.unique(sizes[good]):
        rows = np.flatnonzero(good & (sizes == d))
        step = max(1, _BLOCK // int(d))
        for a in range(0, len(rows), step):
            part = rows[a : a + step]
            yield part, values[(ends - sizes)[part][:, None] + np.arange(d)]


def x_of(c: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * c.astype(np.float64)), -_BOUND, _BOUND).astype(np.int64) + SHIFT


def exact_sums(x: np.ndarray) -> np.ndarray:
    """Sums by column as Python integers."""
    most = max(abs(int(x.min())), abs(int(x.max())))
    return (x.sum(axis=0) if most * len(x) < 1 << 62 else x.astype(object).sum(axis=0)).astype(object)


@dataclass
class Moments:
    n: int
    mean: np.ndarray
    scatter: np.ndarray
    sums: np.ndarray | None = None  # exact, of whole numbers

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        sums = exact_sums(x) if x.dtype == np.int64 else None
        mean = (sums / len(x)).astype(np.float64) if sums is not None else x.mean(axis=0)
        away = x - mean
        return cls(len(x), mean, away.T @ away, sums)

    def merge(self, other: Moments) -> Moments:
        n, apart = self.n + other.n, other.mean - self.mean
        scatter = self.scatter + other.scatter + np.outer(apart, apart) * (self.n * other.n / n)
        return Moments(n, self.mean + apart * (other.n / n), scatter, None if self.sums is None else self.sums + other.sums)


def merged(a: dict[int, Moments], b: dict[int, Moments]) -> dict[int, Moments]:
    """Moments by length of vectors."""
    return {d: a[d].merge(b[d]) if d in a and d in b else a.get(d) or b[d] for d in a.keys() | b.keys()}


def moments(vectors: DataFrame, through=lambda d, x: x) -> dict[int, Moments]:
    """Of the only column of vectors, each block passed ``through`` first."""

    def local(batches):
        own: dict[int, Moments] = {}
        for batch in batches:
            for _, x in blocks(batch.column(0)):
                d = x.shape[1]
                own = merged(own, {d: Moments.of(through(d, x))})
        yield pa.RecordBatch.from_pydict({"state": pa.array([pickle.dumps(own)], pa.binary())})

    states = vectors.mapInArrow(local, "state binary").rdd.map(lambda r: pickle.loads(bytes(r.state)))
    return states.treeReduce(merged) if states.getNumPartitions() else {}


@dataclass
class Axes:
    """Of one length: exact sums, eigenvectors (columns), eigenvalues and the shares of the trace."""

    n: int
    sums: np.ndarray
    mean: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    live: np.ndarray

    def whiten(self, x: np.ndarray) -> np.ndarray:
        scale = np.sqrt(np.where(self.live, self.values, 1.0))
        return np.where(self.live, (x - self.mean) @ self.vectors / scale, np.nan)

    def deviation(self, x: np.ndarray) -> list[str]:
        """Sum over dimensions of (n x - S)^2 in decimal digits, exactly."""
        reach = max(abs(int(x.min())), abs(int(x.max()))) * self.n + max(map(abs, self.sums))
        if reach < 1 << 62:
            away = self.n * x - self.sums.astype(np.int64)
            if x.shape[1] * int(np.abs(away).max()) ** 2 < 1 << 63:
                return (away * away).sum(axis=1).astype(str).tolist()
        away = self.n * x.astype(object) - self.sums
        return [str(v) for v in (away * away).sum(axis=1)]


def axes_of(m: Moments, most: int) -> Axes:
    cov = m.scatter / m.n
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    top = np.argsort(-values, kind="stable")[:most]
    trace = float(np.trace(cov))
    values = np.maximum(values[top], 0.0)
    live = values > len(cov) * np.finfo(float).eps * max(float(values[0]), np.finfo(float).tiny)
    return Axes(m.n, m.sums, (m.sums / m.n).astype(np.float64), vectors[:, top], values, values / trace if trace > 0 else np.zeros(len(top)), live)


@dataclass
class Whitening:
    axes: dict[int, Axes]
    identity_error: float


def fit(embeddings: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """Axes over the distinct x vectors, and how far the whitened ones are from unit covariance."""

    def to_x(batches):
        for batch in batches:
            for _, c in blocks(batch.column(0)):
                flat = pa.array(x_of(c).ravel())
                yield pa.RecordBatch.from_pydict({"x": pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, c.shape[1], dtype=np.int32), flat)})

    xs = staged(embeddings.select(vector).mapInArrow(to_x, "x array<bigint>").dropDuplicates(["x"]), "x-vectors")
    axes = {d: axes_of(m, components) for d, m in moments(xs).items()}
    second = moments(xs, lambda d, x: axes[d].whiten(x)[:, axes[d].live])
    errors = [np.abs(m.scatter / m.n - np.eye(len(m.mean))).max() for m in second.values() if len(m.mean)]
    return Whitening(axes, float(max(errors, default=0.0)))


def whiten(embeddings: DataFrame, model: Whitening, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per vector that takes part and component: id, component, n, deviation (decimal digits), whitened, explained, identity_error."""
    axes, error = model.axes, model.identity_error
    rest = T.StructType.fromDDL("component int, n bigint, deviation string, whitened double, explained double, identity_error double")
    schema = T.StructType([embeddings.schema[id_col], *rest])

    def score(batches):
        for batch in batches:
            for rows, c in blocks(batch.column(1)):
                a, x = axes[c.shape[1]], x_of(c)
                k = len(a.values)
                size = k * len(rows)
                w = a.whiten(x).ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.repeat(rows, k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                        pa.array(np.full(size, a.n, np.int64)),
                        pa.array(a.deviation(x)).take(pa.array(np.repeat(np.arange(len(rows)), k))),
                        pa.array(w, mask=np.isnan(w)),
                        pa.array(np.tile(a.explained, len(rows))),
                        pa.array(np.full(size, error)),
                    ],
                    names=schema.names,
                )

    return embeddings.select(id_col, vector).mapInArrow(score, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors whitened on up to 16 components (deviation is null where it doesn't fit into a long)."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whiten(rows, fit(rows)).withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))
