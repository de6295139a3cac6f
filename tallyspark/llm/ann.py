"""Nearest neighbours by cosine: an NN-descent graph in every block of nodes, greedy beam search over each of them.

1. Vectors that are equal are one node (their smallest ids are kept), so copies cannot crowd a neighbourhood.
2. Spark deals the nodes out by hash to blocks of bounded size (block_rows) and sends every query to every block.  A vector
   is shuffled once and stays where it lies; what is found are ids and scores.
3. Start of a block's graph: nodes are sorted by random-hyperplane codes a few times over, and every window of WINDOW
   consecutive nodes is compared within itself.
4. NN-descent: a node's neighbours and reverse neighbours (at most ``degree`` of each) meet at the node; pairs of them, one
   of them fresh in the list, that beat a current neighbour are merged, until under CHANGES of the edges change.
5. Search: a query's beam starts at the nodes beside its own codes and at the best of PROBES spread nodes; the nearest
   unexpanded ones are followed along their edges (both ways), until nothing in the beam is unexpanded.  The scores are
   double-precision cosines of the original vectors; the nearest of all blocks are merged by a window.

``degree`` and the beam's width grow with the number of nodes in a block (degree_of, beam_of).  Every valid row is indexed.  Work: the
graphs grow with the nodes, the searches with queries times blocks.  Defined cases: null, zero or non-finite vectors and rows with null ids take no part;
a repeated (id, vector) counts once; an id with several vectors is a query, and a candidate, with each of them, but not
its own candidate; vectors of another length than most rows' are compared only if
lengths agree; ties go to the smaller id; with fewer candidates all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded, staged, table

DEGREE, STARTS, WINDOW, CHANGES = 20, 4, 512, 0.001
BEAM, ENTRIES, PROBES, EXPAND = 100, 16, 512, 16
LEAST, MOST, NUMBERS = 8_192, 32_768, 1 << 22  # rows of a block, and numbers in one
NONE, CHUNK = -3.0, 64


def degree_of(nodes: int) -> int:
    """20 up to 2,000 nodes, 30 at 10,000, 40 at 50,000."""
    return DEGREE + round(4.3 * max(0.0, float(np.log2(max(nodes, 1) / 2000))))


def beam_of(nodes: int) -> int:
    """100 up to 500 nodes, 316 at 10,000, 432 at 50,000."""
    return BEAM + round(50 * max(0.0, float(np.log2(max(nodes, 1) / 500))))


def block_rows(nodes: int, width: int) -> int:
    """Nodes of a block: a 32nd of all, within LEAST and MOST, and no more than NUMBERS numbers (32 MB of doubles)."""
    return max(64, min(max(LEAST, min(MOST, -(-nodes // 32))), NUMBERS // max(width, 1)))


def nodes_of(rows: DataFrame, id_col: str, vec_col: str, keep: int) -> tuple[DataFrame, DataFrame, int]:
    """All valid rows (id, original); (node, id, original, head) with up to ``keep`` smallest ids of a node; and the most
    vectors of one id."""
    kind = rows.schema[vec_col].dataType.simpleString()
    vector = F.col(vec_col).cast(kind if kind in ("array<float>", "array<double>") else "array<double>")
    good = rows.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), vector.alias("original"))
    good = good.where("size(original) > 0 and not exists(original, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(original, x -> x <> 0)")
    place = W.partitionBy("original").orderBy("id")
    ids = good.withColumn("nth", F.dense_rank().over(place)).where(F.col("nth") <= keep).select("id", "original").distinct()
    ids = staged(ids.withColumn("first", F.min("id").over(W.partitionBy("original"))), "id-vectors", release=True)
    # a node is named after its smallest id; where that id has other vectors, after its own (far from any id in use)
    several = staged(ids.groupBy(F.col("id").alias("first")).agg(F.count(F.lit(1)).alias("vectors")).where("vectors > 1"), "several")
    most = several.agg(F.max("vectors")).first()[0] or 1
    named = F.when(F.col("vectors").isNotNull(), F.lit(-(1 << 62)) - F.shiftrightunsigned(F.xxhash64("original"), 2)).otherwise(F.col("first"))
    return good, ids.join(bounded(several), "first", "left").select(named.alias("node"), "id", "original", (F.col("id") == F.col("first")).alias("head")), most


# -- the graph of a block: near and sim (nodes x degree), nearest first, -1 where there is none --------------------
def _nth(owner: np.ndarray, n: int) -> np.ndarray:
    """The place of every entry among its owner's; owners ascend."""
    return np.arange(len(owner)) - np.searchsorted(owner, np.arange(n))[owner]


def _merged(near, sim, a, b, s):
    """near, sim and what is fresh in them, after pairs (a, b, s) were found."""
    n, k = near.shape
    _, once = np.unique(a.astype(np.int64) * n + b, return_index=True)
    a, b, s = a[once], b[once], s[once]
    new = ~(near.take(a, 0) == b[:, None]).any(1)
    a, b, s = a[new], b[new], s[new]
    order = np.lexsort((b, -s, a))
    a, b, s = a[order], b[order], s[order]
    nth = _nth(a, n)
    within = nth < k
    a, b, s, nth = (x[within] for x in (a, b, s, nth))
    wide = int(nth.max()) + 1 if len(nth) else 0
    more, value = np.full((n, wide), -1, np.int32), np.full((n, wide), NONE)
    more[a, nth], value[a, nth] = b, s
    every = np.concatenate([near, more], 1), np.concatenate([sim, value], 1), np.concatenate([np.zeros(near.shape, bool), more >= 0], 1)
    top = np.argsort(-every[1], axis=1, kind="stable")[:, :k]
    return tuple(np.take_along_axis(x, top, 1) for x in every)


def codes_of(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    return ((x @ planes > 0) << np.arange(planes.shape[1])).sum(1)


def _windows(x: np.ndarray, orders: list[np.ndarray], degree: int):
    n = len(x)
    near, sim = np.full((n, degree), -1, np.int32), np.full((n, degree), NONE)
    for order in orders:
        found = []
        for at in range(0, n, WINDOW):
            ids = order[max(0, min(at, n - WINDOW)) : at + WINDOW]
            k = min(degree, len(ids) - 1)
            if k < 1:
                continue
            s = x[ids] @ x[ids].T
            np.fill_diagonal(s, NONE)
            best = np.argpartition(-s, k - 1, axis=1)[:, :k]
            found.append((np.repeat(ids, k), ids[best].ravel(), np.take_along_axis(s, best, 1).ravel()))
        if found:
            near, sim, _ = _merged(near, sim, *(np.concatenate(p) for p in zip(*found)))
    return near, sim


def reverse_of(near, sim, fresh):
    """(nodes x degree) those in whose list a node is, the nearest of them, but for those in its own; and if they are fresh there."""
    n, k = near.shape
    at, nth = np.nonzero(near >= 0)
    b, s = near[at, nth], sim[at, nth]
    order = np.lexsort((at, -s, b))
    a, b, f = at[order], b[order], fresh[at, nth][order]
    nth = _nth(b, n)
    within = nth < k
    a, b, f, nth = (m[within] for m in (a, b, f, nth))
    alone = ~(near.take(b, 0) == a[:, None]).any(1)
    a, b, f, nth = (m[alone] for m in (a, b, f, nth))
    back, was = np.full((n, k), -1, np.int32), np.zeros((n, k), bool)
    back[b, nth], was[b, nth] = a, f
    return back, was


def _meet(x, members, fresh, bar):
    """(a, b, s) of pairs in rows of members, one of them fresh there, that beat the weakest neighbour of a."""
    first = np.argsort(~fresh + 2 * (members < 0), axis=1, kind="stable")
    members, fresh = np.take_along_axis(members, first, 1), np.take_along_axis(fresh, first, 1)
    news, size = fresh.sum(1), (members >= 0).sum(1)
    rows = np.argsort(news, kind="stable")
    rows, found = rows[news[rows] > 0], []
    for at in range(0, len(rows), CHUNK):
        r = rows[at : at + CHUNK]
        f = news[r].max()
        m = members[r][:, : size[r].max()]
        v = x[m]
        s = v[:, :f] @ v.transpose(0, 2, 1)
        hit = s > np.minimum(bar[m[:, :f]][:, :, None], bar[m][:, None, :])
        hit &= fresh[r][:, :f, None] & (m >= 0)[:, None, :] & (m[:, :f, None] != m[:, None, :])
        p, i, j = np.nonzero(hit)
        a, b, s = m[p, i], m[p, j], s[p, i, j]
        for a, b in ((a, b), (b, a)):
            ok = s > bar[a]
            found.append((a[ok], b[ok], s[ok]))
    return (np.concatenate(p) for p in zip(*found)) if found else (np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0))


def build_graph(x: np.ndarray, orders: list[np.ndarray], degree: int) -> np.ndarray:
    """(nodes x 2 degree) edges of every node, both ways, -1 where there are fewer; x: unit vectors, orders: of the start."""
    near, sim = _windows(x, orders, degree)
    fresh = near >= 0
    while fresh.sum() > CHANGES * near.size:
        back, was = reverse_of(near, sim, fresh)
        bar = np.where(near[:, -1] < 0, -1.5, sim[:, -1]) + 1e-12  # no more than what rounding makes, so lists only get nearer
        near, sim, fresh = _merged(near, sim, *_meet(x, np.concatenate([near, back], 1), np.concatenate([fresh, was], 1), bar))
    return np.concatenate([near, reverse_of(near, sim, fresh)[0]], 1)


def search(x: np.ndarray, edges: np.ndarray, q: np.ndarray, starts: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(queries x beam) nodes and cosines: the beams of the queries q after greedy search from their start nodes (-1: none)."""
    n, many = len(x), len(q)
    seen, stamp, live = np.zeros(many * n, bool), np.empty(many * n, np.int32), np.arange(many)
    out = np.full((many, beam), -1, np.int32), np.full((many, beam), NONE)
    ids, sims, done = out[0].copy(), out[1].copy(), np.ones((many, beam), bool)
    c = starts
    while len(live):
        flat = ((live * n)[:, None] + c).ravel()
        at = np.flatnonzero((c.ravel() >= 0) & ~seen.take(flat, mode="clip"))
        flat, number = flat.take(at), np.arange(len(at), dtype=np.int32)  # a node met twice in one step counts once
        seen[flat], stamp[flat] = True, number
        at = at[stamp.take(flat) == number]
        r, b = at // c.shape[1], c.ravel().take(at)
        s = np.einsum("ij,ij->i", x.take(b, 0), q.take(live.take(r), 0))
        ok = np.flatnonzero(s > sims.min(1).take(r))
        r, b, s = r.take(ok), b.take(ok), s.take(ok)
        if len(r):
            nth = _nth(r, len(live))
            more, value = np.full((len(live), nth.max() + 1), -1, np.int32), np.full((len(live), nth.max() + 1), NONE)
            more[r, nth], value[r, nth] = b, s
            every = np.concatenate([ids, more], 1), np.concatenate([sims, value], 1), np.concatenate([done, more < 0], 1)
            top = np.argpartition(-every[1], beam - 1, axis=1)[:, :beam]
            ids, sims, done = (np.take_along_axis(m, top, 1) for m in every)
        open_ = np.where(done, NONE, sims)
        top = np.argpartition(-open_, min(EXPAND, beam) - 1, axis=1)[:, :EXPAND]
        good = np.take_along_axis(open_, top, 1) > -2
        on = good.any(1)
        out[0][live[~on]], out[1][live[~on]] = ids[~on], sims[~on]
        live, ids, sims, done, top, good = (m[on] for m in (live, ids, sims, done, top, good))
        np.put_along_axis(done, top, True, 1)
        c = np.where(good[:, :, None], edges.take(np.take_along_axis(ids, top, 1), 0, mode="clip"), -1).reshape(len(live), edges.shape[1] * top.shape[1])
    return out


class _Block:
    """The vectors of one length in a block, their graph, and the search in it."""

    def __init__(self, nodes: np.ndarray, original: np.ndarray, degree: int | None, beam: int | None, starts: int, least: int):
        self.nodes, self.original, self.x = nodes, original, _unit(original)
        n, d = self.x.shape
        rng = np.random.default_rng(3)
        self.planes = rng.normal(size=(starts, d, 20))
        codes = [codes_of(self.x, p) for p in self.planes]
        self.orders = [np.lexsort((rng.permutation(n), c)).astype(np.int32) for c in codes]
        self.codes = [c[o] for c, o in zip(codes, self.orders)]
        self.probes = rng.permutation(n)[:PROBES].astype(np.int32)
        self.edges = build_graph(self.x, self.orders, degree or degree_of(n))
        self.beam = min(max(beam or beam_of(n), min(least, BEAM)), n)

    def starts(self, q: np.ndarray) -> np.ndarray:
        """The best of the spread nodes, and those beside the query's place in every order."""
        near = q @ self.x[self.probes].T
        best = self.probes[np.argpartition(-near, min(ENTRIES, len(self.probes)) - 1, axis=1)[:, :ENTRIES]]
        beside = [o[np.clip(np.searchsorted(c, codes_of(q, p))[:, None] + np.arange(-4, 4), 0, len(o) - 1)] for p, c, o in zip(self.planes, self.codes, self.orders)]
        return np.concatenate([best, *beside], 1)

    def nearest(self, queries: np.ndarray, original: np.ndarray, k: int):
        """Record batches of (q, c, score): the k nearest nodes found, and those that tie with the last."""
        for at in range(0, len(queries), CHUNK):
            y = original[at : at + CHUNK]
            q = _unit(y)
            ids, sims = search(self.x, self.edges, q, self.starts(q), self.beam)
            last = -np.partition(-sims, min(k, self.beam) - 1, axis=1)[:, min(k, self.beam) - 1]
            r, p = np.nonzero((ids >= 0) & (sims >= last[:, None] - 1e-12))
            c = ids[r, p]
            yield pa.RecordBatch.from_arrays([pa.array(queries[at : at + CHUNK][r]), pa.array(self.nodes[c]), pa.array(_cosine(self.original[c], y[r]))], names=["q", "c", "score"])


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows as doubles whose squares neither vanish nor overflow."""
    x = x.astype(np.float64)
    top = np.abs(x).max(1, keepdims=True)
    return np.where((top > 1e-100) & (top < 1e100), x, x / top)


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, y = _scaled(x), _scaled(y)
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


def _by_length(parts: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length to (ids, matrix) of record batches with columns node and original."""
    out: dict = {}
    for b in parts:
        nodes, lists = b.column("node").to_numpy(), b.column("original")
        size, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(size)
        for d in np.unique(size):
            at = np.flatnonzero(size == d)
            out.setdefault(int(d), []).append((nodes[at], flat[(ends[at] - d)[:, None] + np.arange(d)]))
    return {d: tuple(np.concatenate(p) for p in zip(*v)) for d, v in out.items()}


def _block_task(k: int, degree: int | None, beam: int | None, starts: int):
    """Rows come by block, a block's nodes before its queries."""

    def run(batches):
        now, parts, graphs = None, [], None
        for b in batches:
            block, asks = b.column("block").to_numpy(), b.column("asks").to_numpy(zero_copy_only=False)
            edge = [0, *(np.flatnonzero((np.diff(block) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(edge[:-1], edge[1:]):
                if hi == lo:
                    continue
                if block[lo] != now:
                    now, parts, graphs = block[lo], [], None
                if not asks[lo]:
                    parts.append(b.slice(lo, hi - lo))
                    continue
                if graphs is None:
                    graphs, parts = {d: _Block(*v, degree, beam, starts, k) for d, v in _by_length(parts).items()}, []
                for d, (queries, original) in _by_length([b.slice(lo, hi - lo)]).items():
                    if d in graphs:
                        yield from graphs[d].nearest(queries, original, k)

    return run


def neighbours(rows: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", degree: int | None = None, beam: int | None = None, starts: int = STARTS, block: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of every query row (``is_query`` over column id)."""
    good, ids, own = nodes_of(rows, id_col, vec_col, k + 1)
    heads = ids.where("head").select("node", "original")
    asked = staged(good.where(is_query).distinct().join(heads, "original").select("id", F.col("node").alias("q"), "original"), "asked", release=True)
    total, width = heads.agg(F.count(F.lit(1)), F.max(F.size("original"))).first()
    blocks = max(1, -(-total // (block or block_rows(total, width or 1))))
    queries = asked.dropDuplicates(["q"]).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), F.col("q").alias("node"), "original")
    dealt = heads.select(F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asks"), "node", "original").unionByName(queries)
    dealt = dealt.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "asks", "node")
    # besides an id's own vectors, its k nearest rows are among the k nearest nodes of all blocks
    found = staged(dealt.mapInArrow(_block_task(k + own, degree, beam, starts), "q long, c long, score double"), "found", release=True)
    found = found.withColumn("nth", F.rank().over(W.partitionBy("q").orderBy(F.desc("score")))).where(F.col("nth") <= k + own).drop("nth")
    found = asked.select("id", "q").join(found, "q").join(ids.select(F.col("node").alias("c"), F.col("id").alias("vec_id")), "c").where("vec_id <> id")
    place = W.partitionBy("id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select(F.col("id").alias("query_id"), "rank", "vec_id", "score")


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.expr("id % 50 = 0"))
