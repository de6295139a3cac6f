"""Scoring by prediction by partial matching: a byte-context trie over the whole training corpus.

The text is its lower-cased words, joined by single spaces, and a closing newline; the contexts before it are
newlines.  The trie holds, for contexts of 0 to ORDER bytes, how often each byte followed.  A byte is coded in the
longest context seen; escapes have the weight of the distinct followers (method C), and lower orders leave out all
bytes that the context above has already offered (symbol exclusion), down to a uniform order -1.

Spark side: documents are dealt to chunks by hash.  A chunk counts its words and its byte n-grams and asks, by
hash slot, for what it will need; slots add the counts of all chunks, build their part of the trie (all orders of a
context share its last two bytes), and answer each chunk with counts and code lengths of just its own n-grams.  The
only tables that every task gets are byte and byte-pair counts, at most 65,792 numbers.

Defined cases: null text is the empty text (one end token); repeated rows each count; a null id is in training;
without training documents bytes are uniform; texts are read whole; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of_bytes, hashed_words, id_mod, mix64, partitions_for, table, text_of

ORDER = 5
END = b"\n"
ASK = np.dtype([("key", "<u8"), ("n", "<u4")])
CODE = np.dtype([("key", "<u8"), ("code", "<f4")])
COUNT = np.dtype([("key", "<u8"), ("code", "<i8")])  # words are answered by whole counts


def normal(text: bytes) -> bytes:
    return b" ".join(text.lower().split()) + END


def grams(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """All (order + 1)-grams of the normalised texts, and how many each text has."""
    rows = [normal(t) for t in texts]
    pad = END * order
    buf = np.frombuffer(pad + pad.join(rows), np.uint8)
    out = np.zeros(len(buf) - order, np.uint64)
    for k in range(order + 1):
        out |= buf[order - k : len(buf) - k].astype(np.uint64) << np.uint64(8 * k)
    sizes = np.array([len(r) for r in rows])
    keep = np.ones(len(out), bool)
    ends = np.cumsum(sizes + order)[:-1] - order
    for k in range(order):
        keep[ends + k] = False
    return out[keep], sizes


def counted(keys: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, w = np.concatenate(keys), np.concatenate(weights)
    u, inv = np.unique(k, return_inverse=True)
    return u, np.bincount(inv, w, len(u)).astype(np.int64)


def _pairs_task(order: int):
    def run(batches):
        total, docs = np.zeros(1 << 16, np.int64), 0
        for b in batches:
            for _, run_ in batches_of_bytes(b.column(0)):
                buf = np.frombuffer(END + END.join(normal(t) for t in run_), np.uint8)
                total += np.bincount(buf[:-1].astype(np.uint16) * np.uint16(256) + buf[1:], minlength=1 << 16)
                total[10 * 256 + 10] -= len(run_) - 1
                docs += len(run_)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1], pa.int32()), pa.array([*total[at].tolist(), docs], pa.int64())], names=["pair", "n"])

    return run


class Lookup:
    """Exact hash look-up of uint64 keys, vectorised: levels of slots, losers of a slot go to the next level."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.levels = keys, []
        left, seed = np.arange(len(keys)), 0
        while len(left):
            bits = max(4, int(np.ceil(np.log2(len(left)))) + 2)
            slot = self._slot(keys[left], seed, bits)
            tab = np.full(1 << bits, -1, np.int32)
            tab[slot] = left
            self.levels.append((seed, bits, tab))
            left = left[tab[slot] != left]
            seed += 1

    @staticmethod
    def _slot(k, seed, bits):
        return ((k ^ (k >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15 + 2 * seed * 0x1000193)) >> np.uint64(64 - bits)

    def find(self, k: np.ndarray) -> np.ndarray:
        """Positions of the keys, -1 where there is none."""
        out = np.full(len(k), -1, np.int32)
        left = None
        for seed, bits, tab in self.levels:
            q = k if left is None else k[left]
            at = tab[self._slot(q, seed, bits)]
            good = (at >= 0) & (self.keys[at] == q) if len(self.keys) else np.zeros(len(q), bool)
            if left is None:
                out[good] = at[good]
                left = np.flatnonzero(~good)
            else:
                out[left[good]] = at[good]
                left = left[~good]
            if not len(left):
                break
        return out


def code_lengths(keys: np.ndarray, counts: np.ndarray, pairs: np.ndarray, order: int = ORDER) -> np.ndarray:
    """log10 probability of the last byte of each (order + 1)-gram given the others.

    ``counts`` are training counts of the (sorted) keys; all keys that share two context bytes with one of
    them are there.  ``pairs`` are the training counts of all byte pairs."""
    single = pairs.reshape(256, 256).sum(0)
    sym = (keys & np.uint64(255)).astype(np.int64)
    c1 = ((keys >> np.uint64(8)) & np.uint64(255)).astype(np.int64)
    # by order: followers (context and byte, count) and contexts (total, distinct)
    seen = counts > 0
    fk, fc = keys[seen], counts[seen]
    tables = {}
    for d in range(order, 1, -1):
        if d < order:
            fk, inv = np.unique(fk & np.uint64((1 << (8 * (d + 1))) - 1), return_inverse=True)
            fc = np.bincount(inv, fc, len(fk)).astype(np.int64)
        ctx, first = np.unique(fk >> np.uint64(8), return_index=True)
        edge = np.append(first, len(fk))
        tables[d] = (fk, fc, ctx, np.add.reduceat(fc, first) if len(fk) else fc, np.diff(edge), first)
    # what the followers of a context weigh in the context one byte shorter
    above = {}
    for d in range(order, 1, -1):
        fk, _, ctx, _, _, first = tables[d]
        if d == 2:
            lower = pairs[(fk & np.uint64(0xFFFF)).astype(np.int64)]
        else:
            lk, lc = tables[d - 1][:2]
            lower = lc[np.searchsorted(lk, fk & np.uint64((1 << (8 * d)) - 1))] if len(fk) else fk.astype(np.int64)
        above[d] = np.add.reduceat(lower, first) if len(first) else lower
    square = pairs.reshape(256, 256)
    above[1] = ((square > 0) * single).sum(1)
    log = np.zeros(len(keys))
    open_ = np.ones(len(keys), bool)
    taken, offered = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)  # weight and number of excluded bytes
    for d in range(order, -1, -1):
        if d >= 2:
            fk, fc, ctx, total, distinct, _ = tables[d]
            if not len(ctx):
                continue
            k = keys & np.uint64((1 << (8 * (d + 1))) - 1)
            at = np.minimum(np.searchsorted(ctx, k >> np.uint64(8)), len(ctx) - 1)
            known = ctx[at] == k >> np.uint64(8)
            T, q, up = np.where(known, total[at], 0), np.where(known, distinct[at], 0), np.where(known, above[d][at], 0)
            at = np.minimum(np.searchsorted(fk, k), len(fk) - 1)
            c = np.where(fk[at] == k, fc[at], 0)
        elif d == 1:
            T, q, c, up = square.sum(1)[c1], (square > 0).sum(1)[c1], square[c1, sym], above[1][c1]
        else:
            n = len(keys)
            T, q, c, up = np.full(n, single.sum()), np.full(n, (single > 0).sum()), single[sym], np.zeros(n, np.int64)
        rest, kinds = T - taken, q - offered
        use = open_ & (rest > 0)
        hit, miss = use & (c > 0), use & (c == 0)
        log[hit] += np.log10(c[hit] / (rest[hit] + kinds[hit]))
        log[miss] += np.log10(kinds[miss] / (rest[miss] + kinds[miss]))
        open_ &= ~hit
        taken, offered = np.where(q > 0, up, taken), np.where(q > 0, q, offered)
    log[open_] -= np.log10(np.maximum(256 - (single > 0).sum(), 1))
    return log


def _packed(kind: int, chunk: int, keys: np.ndarray, n: np.ndarray, slot: np.ndarray):
    """Rows (kind, slot, chunk, payload) of a chunk's questions."""
    order = np.argsort(slot, kind="stable")
    rec = np.empty(len(keys), ASK)
    rec["key"], rec["n"] = keys[order], n[order]
    slot = slot[order]
    cut = np.flatnonzero(np.diff(slot, prepend=-1))
    return [(kind, int(slot[a]), chunk, rec[a:z].tobytes()) for a, z in zip(cut, [*cut[1:], len(rec)])]


def gram_slot(keys: np.ndarray, slots: int) -> np.ndarray:
    """By the last two context bytes."""
    return (mix64((keys >> np.uint64(8)) & np.uint64(0xFFFF)) % np.uint64(slots)).astype(np.int64)


def _ask_task(slots: int, order: int):
    def run(tab):
        chunk = tab.column("chunk")[0].as_py()
        trained = np.array([bool(x) for x in tab.column("trained").to_pylist()])
        wk, wn, gk, gn = [], [], [], []
        for at, texts in batches_of_bytes(tab.column("text")):
            for part in (True, False):
                mine = [t for t, x in zip(texts, trained[at : at + len(texts)]) if x == part]
                if not mine:
                    continue
                for keys, counts, got in ((wk, wn, hashed_words(mine)[0]), (gk, gn, grams(mine, order)[0])):
                    u, c = np.unique(got, return_counts=True)
                    keys.append(u)
                    counts.append(c if part else np.zeros(len(u), np.int64))
        rows = []
        k, n = counted(wk, wn)
        rows += _packed(0, chunk, k, n, (k % np.uint64(slots)).astype(np.int64))
        k, n = counted(gk, gn)
        rows += _packed(1, chunk, k, n, gram_slot(k, slots))
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["kind", "slot", "chunk", "payload"])

    return run


def _answer_task(pairs_cast, order: int, totals: bool):
    """Of each (kind, slot): totals (number of known keys, sum of counts), or the answers to its chunks."""

    def answer(kind, rows):
        if totals and kind:
            return
        asked = [(c, np.frombuffer(p, ASK)) for c, p in rows]
        keys, n = counted([r["key"] for _, r in asked], [r["n"].astype(np.float64) for _, r in asked])
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([int((n > 0).sum())], pa.int32()), pa.array([int(n.sum())], pa.int64()), pa.array([None], pa.binary())], names=["kind", "chunk", "n", "payload"])
            return
        code = n if kind == 0 else code_lengths(keys, n, pairs_cast.value, order)
        out = []
        for chunk, rec in asked:
            reply = np.empty(len(rec), CODE if kind else COUNT)
            reply["key"], reply["code"] = rec["key"], code[np.searchsorted(keys, rec["key"])]
            out.append((chunk, reply.tobytes()))
        m = len(out)
        yield pa.RecordBatch.from_arrays([pa.array([kind] * m, pa.int32()), pa.array([c for c, _ in out], pa.int32()), pa.array([0] * m, pa.int64()), pa.array([p for _, p in out], pa.binary())], names=["kind", "chunk", "n", "payload"])

    def run(batches):
        now, have = None, []
        for b in batches:
            for kind, slot, chunk, payload in zip(*(b.column(c).to_pylist() for c in ("kind", "slot", "chunk", "payload"))):
                if (kind, slot) != now:
                    if have:
                        yield from answer(now[0], have)
                    now, have = (kind, slot), []
                have.append((chunk, payload))
        if have:
            yield from answer(now[0], have)

    return run


def _score_task(order: int):
    def run(left, right):
        replies = {0: [], 1: []}
        for kind, p in zip(right.column("kind").to_pylist(), right.column("payload").to_pylist()):
            replies[kind].append(np.frombuffer(p, CODE if kind else COUNT))
        rec = {k: np.concatenate(v) if v else np.empty(0, CODE if k else COUNT) for k, v in replies.items()}
        words, bytes_ = Lookup(np.ascontiguousarray(rec[0]["key"])), Lookup(np.ascontiguousarray(rec[1]["key"]))
        counts, codes = rec[0]["code"].astype(np.float64), rec[1]["code"].astype(np.float64)
        logs = np.log10(counts + 1)
        n_words, known, sums, score = [], [], [], []
        for _, texts in batches_of_bytes(left.column("text")):
            h, _, _, first = hashed_words(texts)
            at = words.find(h)
            for x, out in ((logs[at], sums), (counts[at] > 0, known)):
                total = np.concatenate([[0], np.cumsum(x, dtype=np.float64)])
                out.append(total[first[1:]] - total[first[:-1]])
            n_words.append(np.diff(first))
            g, sizes = grams(texts, order)
            score.append(np.add.reduceat(codes[bytes_.find(g)], np.concatenate([[0], np.cumsum(sizes)[:-1]])))
        cat = lambda x, t: pa.array(np.concatenate(x).astype(t))
        return pa.table([left.column("doc_id"), left.column("trained"), cat(n_words, np.int64), cat(known, np.int64), cat(sums, np.float64), cat(score, np.float64)], names=["doc_id", "trained", "words", "known", "sums", "score"])

    return run


def score_documents(docs: DataFrame, trained: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    chunks = partitions_for(docs)
    slots = max(12, chunks // 4)  # chunks ask every slot, so their product is kept low
    base = docs.select(F.col(id_col).alias("doc_id"), trained.alias("trained"), text_of(text_col).alias("text"), F.pmod(F.xxhash64(id_col, text_col), F.lit(chunks)).cast("int").alias("chunk"))
    pairs, train_docs = np.zeros(1 << 16, np.int64), 0
    for r in base.where("trained").select("text").mapInArrow(_pairs_task(order), "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # at most 65,537 rows
        if r.pair < 0:
            train_docs = r.n
        else:
            pairs[r.pair] = r.n
    cast = docs.sparkSession.sparkContext.broadcast(pairs)
    texts = base.groupBy("chunk")
    asked = texts.applyInArrow(_ask_task(slots, order), "kind int, slot int, chunk int, payload binary").repartition("kind", "slot").sortWithinPartitions("kind", "slot")
    answers = asked.mapInArrow(_answer_task(cast, order, False), "kind int, chunk int, n long, payload binary")
    rows = texts.cogroup(answers.groupBy("chunk")).applyInArrow(_score_task(order), "doc_id long, trained boolean, words long, known long, sums double, score double")
    totals = asked.mapInArrow(_answer_task(cast, order, True), "kind int, chunk int, n long, payload binary").agg(F.coalesce(F.sum("chunk"), F.lit(0)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    end = 1 if train_docs else 0
    n, v = F.col("n") + F.lit(train_docs), F.col("v") + F.lit(end)
    tokens = F.col("words") + 1
    base_score = F.col("sums") + F.lit(float(np.log10(train_docs + 1.0))) - tokens * F.log10((n + v + 1).cast("double"))
    return rows.join(F.broadcast(totals)).select("doc_id", (~F.col("trained")).alias("held_out"), tokens.alias("n_tokens"), (F.col("known") + end).alias("n_known"), n.cast("long").alias("train_tokens"), base_score.alias("base_score"), "score")  # one row of totals


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), id_mod("doc_id", 7) != 2)
