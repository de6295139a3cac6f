"""Jaccard join over word n-grams with a token-group matrix; components of linked documents.

1. Equal shingle sets are one node (64-bit hash of the set and its size), so copies cost one row each.
2. Where two sets have J >= t, their symmetric difference is at most (1-t)/(1+t) of the sum of the sizes.  A
   set is cut by token hash into more parts than that, so linked sets share a part (not an empty one) whole.  Sets emit the hashes
   of their parts for their own size class and the next one; these meet in slots of their class, packed.
3. Nodes that share part hashes are dealt to groups of like documents (commonest part hash, split by hash
   to about BLOCK members).  The matrix holds, for each part hash, the groups it occurs in.  A group and a query that
   meet in it often enough are a candidate.
4. A group stores the union of its members' tokens, as a bitmap of hashed tokens (a superset, so what it bounds
   holds).  A query's overlap is bounded by the union and then by the members' own bitmaps; only groups that
   qualify are opened, and their members' tokens are compared with the query's, which is sent to each group once.
   Groups with many queries are salted.
5. First all nodes meet the hub group of most of their part hashes; components of the links follow.  Only nodes outside
   their part hash's main component then meet the other groups, so families of near copies do not cost
   the square of their size unless they are hardly linked at all.

Nodes and tokens are 64-bit hashes and part hashes 32 bits inside a slot; nodes and tokens that agree are taken as
equal, part hashes only propose candidates.  Documents are keyed by a 64-bit hash of id and text.

Defined cases: null or empty text has no shingles and is linked with nothing; fewer than n words are one
shingle; ties go to the smaller doc_id; repeated rows are copies; an empty table gives an empty result; texts of any
length are read whole; extra columns are ignored by ``component_ids`` and kept by ``keep_one`` (internal names start
with ``_nj_``), which keeps any one of rows that agree in id and text.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of_bytes, bounded, components, hashed_words, mix64, shingle_hashes, staged, table

BLOCK = 256
#: Tokens of a group's members together, and queries that meet a group in one task, about.
GROUP_TOKENS, QUERIES = 1 << 18, 2000
#: Tokens of all sets for each slot, about.
SLOT_TOKENS = 1_000_000


class Parts:
    """Size classes and numbers of parts for a threshold t (a fraction)."""

    def __init__(self, t: Fraction):
        self.t = t
        self.low, x = [1], 1
        while x < 1 << 31:
            x = int(Fraction(x) / t) + 1
            self.low.append(x)
        self.bounds = np.array(self.low)

    def level(self, n: int) -> int:
        return int(np.searchsorted(self.bounds, n, "right")) - 1

    def differ(self, level: int) -> int:
        """Most tokens by which two linked sets differ, the larger of them in this class."""
        most = self.low[level + 1] - 1
        return int(2 * most * (1 - self.t) / (1 + self.t))

    def need(self, level: int) -> int:
        """Parts, other than empty ones, that linked sets share at least; large sets get parts to spare for it."""
        return min(7, 1 + self.differ(level) // 8)

    def number(self, level: int) -> int:
        """Parts of a class: what can differ, what must be shared, and some for parts that are empty by chance."""
        m = self.differ(level) + self.need(level)
        return m + int(1.5 * m * np.exp(-float(self.t) * self.low[level] / m)) + 4

    def signatures(self, tokens: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(class, part hashes) of a sorted token set, for its class and the next.  A set with few empty parts
        need not emit these."""
        own = self.level(len(tokens))
        out = []
        for level in (own, own + 1):
            d = self.differ(level)
            if d == 0:
                continue
            m = self.number(level)
            cut = (np.arange(1, m, dtype=np.float64) * (2.0**64 / m)).astype(np.uint64)
            at = np.concatenate([[0], np.searchsorted(tokens, cut), [len(tokens)]])
            sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(tokens ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
            part = mix64(sums[at[1:]] - sums[at[:-1]] + mix64(np.arange(m, dtype=np.uint64) + np.uint64(level << 32)))
            full = at[1:] > at[:-1]
            out.append((level, part[full] if m - int(full.sum()) <= m - d - self.need(level) else part))
        return out


class Slots:
    """Slots of part hashes: every class has its own, in number as its share of all tokens."""

    def __init__(self, parts: Parts, tokens: dict[int, int], total: int):
        weight = {c: tokens.get(c, 0) + tokens.get(c - 1, 0) for c in {x + y for x in tokens for y in (0, 1)}}
        whole = max(1, sum(weight.values()))
        self.base, self.count, self.need, at = {}, {}, [], 0
        for c in sorted(weight):
            self.base[c], self.count[c] = at, max(1, round(total * weight[c] / whole))
            at += self.count[c]
            self.need += [parts.need(c)] * self.count[c]

    def of(self, level: int, part: np.ndarray) -> np.ndarray:
        return self.base[level] + ((part >> np.uint64(32)) % np.uint64(self.count[level])).astype(np.int64)


def token_sets(texts, k: int):
    """Sorted distinct shingle hashes of each text."""
    for _, run in batches_of_bytes(texts):
        words, _, _, first = hashed_words(run)
        for i in range(len(run)):
            yield np.unique(shingle_hashes(words[first[i] : first[i + 1]], k))


def node_of(tokens: np.ndarray) -> int:
    """Identity of a token set: 64 bits from its sum, the exclusive or of its mixed tokens, and its size."""
    once = np.array([np.bitwise_xor.reduce(mix64(tokens + np.uint64(1)))])
    return int(mix64(tokens.sum(dtype=np.uint64, keepdims=True) + once + np.uint64(len(tokens))).astype(np.int64)[0])


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """Hashed tokens as a bitmap of 64-bit words, about four bits a token."""
    words = max(1, 1 << (4 * len(tokens) - 1).bit_length() >> 6)
    bit = tokens & np.uint64(64 * words - 1)
    out = np.zeros(words, np.uint64)
    np.bitwise_or.at(out, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap (last axis) with fewer words, as if it had been made so."""
    return np.bitwise_or.reduce(bits.reshape(*bits.shape[:-1], -1, words), axis=-2)


def _batch(schema: dict, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.values())], names=list(schema))


NODES = {"rk": pa.int64(), "doc_id": pa.int64(), "n": pa.int64(), "level": pa.int32(), "node": pa.int64(), "bits": pa.binary()}


def _node_task(k: int, parts: Parts):
    """One row a document: size and class of its set, its node, and its bitmap."""

    def run(batches):
        for b in batches:
            ns, levels, nodes, bits = [], [], [], []
            for tokens in token_sets(b.column(2), k):
                n = len(tokens)
                ns.append(n)
                levels.append(parts.level(n) if n else None)
                nodes.append(node_of(tokens) if n else None)
                bits.append(bitmap(tokens).tobytes() if n else None)
            yield _batch(NODES, b.column(0), b.column(1), ns, levels, nodes, bits)

    return run


def _signature_task(k: int, parts: Parts, slots: Slots, most: int = 600_000):
    """Part hashes of the distinct sets of a task, packed by slot: a table of nodes, how many each has, the hashes."""

    def flush(slot, part, at, nodes):
        slot, part, at, nodes = np.concatenate(slot), np.concatenate(part), np.concatenate(at), np.array(nodes, np.int64)
        order = np.argsort(slot, kind="stable")
        slot, part, at = slot[order], part[order].astype("<u4"), at[order]
        cut = np.flatnonzero(np.diff(slot, prepend=-1))
        out = []
        for a, z in zip(cut, [*cut[1:], len(slot)]):
            first = np.flatnonzero(np.diff(at[a:z], prepend=-1))
            many = np.diff([*first, z - a]).astype("<u4")
            out.append(np.array([len(first)], "<u4").tobytes() + nodes[at[a:z][first]].astype("<i8").tobytes() + many.tobytes() + part[a:z].tobytes())
        return _batch({"slot": pa.int32(), "payload": pa.binary()}, slot[cut], out)

    def run(batches):
        seen, slot, part, at, nodes, size = set(), [], [], [], [], 0
        for b in batches:
            for tokens in token_sets(b.column(0), k):
                if not len(tokens) or (node := node_of(tokens)) in seen:
                    continue
                seen.add(node)
                for level, p in parts.signatures(tokens):
                    slot.append(slots.of(level, p))
                    part.append(p)
                    at.append(np.full(len(p), len(nodes), np.int32))
                    size += len(p)
                nodes.append(node)
                if size > most:
                    yield flush(slot, part, at, nodes)
                    slot, part, at, nodes, size = [], [], [], [], 0
        if size:
            yield flush(slot, part, at, nodes)

    return run


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    k = int(np.frombuffer(raw, "<u4", 1)[0])
    nodes, many = np.frombuffer(raw, "<i8", k, 4), np.frombuffer(raw, "<u4", k, 4 + 8 * k)
    return np.frombuffer(raw, "<u4", offset=4 + 12 * k), np.repeat(nodes, many)


def _by_slot(batches, *names):
    """(slot, rows of the named columns) of sorted rows, slot by slot, in runs of one batch."""
    for b in batches:
        slot = b.column("slot").to_numpy()
        cut = np.flatnonzero(np.diff(slot, prepend=-1))
        cols = [b.column(n) for n in names]
        for a, z in zip(cut, [*cut[1:], len(slot)]):
            yield int(slot[a]), [c.slice(a, z - a) for c in cols]


SHARED = {"slot": pa.int32(), "node": pa.int64(), "n": pa.int64(), "need": pa.int32(), "many": pa.int64(), "home": pa.int64(), "sigs": pa.binary()}


def _shared_task(need: list[int], most: int = 1_000_000):
    """Part hashes that more than one node has, packed by slot and node.  What is kept in a task are the distinct hashes
    of a slot: the rows of a hash that many nodes have pass through."""

    class Meeting:
        def __init__(self, slot):
            self.slot, self.have, self.size, self.open = slot, [], 0, np.empty(0, np.uint32)

        def add(self, raw):
            self.have.append(_unpacked(raw))
            self.size += len(self.have[-1][0])

        def compact(self, last):
            sig, node = (np.concatenate(x) for x in zip(*self.have))
            order = np.lexsort((node, sig))
            sig, node = sig[order], node[order]
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
            sig, node = sig[new], node[new]
            first = np.ones(len(sig), bool)
            first[1:] = sig[1:] != sig[:-1]
            ids = np.cumsum(first) - 1
            many = np.bincount(ids)[ids]
            shared = many > 1
            if len(self.open):
                shared |= self.open[np.minimum(np.searchsorted(self.open, sig), len(self.open) - 1)] == sig
            if not last:
                self.open = np.union1d(self.open, sig[shared])
                self.have = [(sig[~shared], node[~shared])]
                self.size = 0
            sig, node, many = sig[shared], node[shared], many[shared]
            if not len(sig):
                return
            order = np.lexsort((sig, -many, node))  # a node's commonest part hash comes first
            sig, node, many = sig[order].astype("<u4"), node[order], many[order]
            cut = np.flatnonzero(np.diff(node, prepend=node[0] - 1))
            edge = [*cut[1:].tolist(), len(node)]
            m = len(cut)
            home = np.int64(self.slot << 32) + sig[cut].astype(np.int64)
            yield _batch(SHARED, np.full(m, self.slot), node[cut], np.diff([*cut, len(node)]), np.full(m, need[self.slot]), many[cut], home, [sig[a:z].tobytes() for a, z in zip(cut.tolist(), edge)])

    def run(batches):
        now = None
        for slot, (payloads,) in _by_slot(batches, "payload"):
            if now is None or slot != now.slot:
                if now is not None:
                    yield from now.compact(True)
                now = Meeting(slot)
            for raw in payloads.to_pylist():
                now.add(raw)
                if now.size > most:
                    yield from now.compact(False)
        if now is not None:
            yield from now.compact(True)

    return run


def blocks_of(shared: DataFrame, rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """(node, block, n, bits, rk): nodes that share as many parts as a link takes; those with the same commonest
    part hash are together, split by node hash to about ``size`` members and GROUP_TOKENS tokens."""
    home = shared.groupBy("node").agg(F.sum("n").alias("parts"), F.min("need").alias("need"), F.max_by("home", F.struct("many", "home")).alias("home")).where("parts >= need").select("node", "home")
    known = rows.where("node is not null").groupBy("node").agg(F.min("n").alias("n"), F.min("bits").alias("bits"), F.min("rk").alias("rk"))
    home = staged(home.join(known, "node"), "homes")
    many = home.groupBy("home").agg(F.ceil(F.greatest(F.count("*") / size, F.sum("n") / GROUP_TOKENS)).alias("many"))
    return home.join(many, "home").select("node", F.xxhash64("home", F.pmod("node", "many")).alias("block"), "n", "bits", "rk")


PAIRS = {"q": pa.int64(), "y": pa.int64(), "n": pa.int64(), "need": pa.int32()}


def _listed(sigs) -> tuple[np.ndarray, np.ndarray]:
    """Part hashes of the rows, and how many each row has."""
    raw = sigs.to_pylist()
    return np.frombuffer(b"".join(raw), "<u4"), np.array([len(r) // 4 for r in raw])


def _counted(x, y, slot, need, best=False):
    """Rows of PAIRS for the distinct (x, y), x a node and y a block; for ``best``, the commonest y of each x."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    cut = np.flatnonzero(new)
    x, y, n = x[cut], y[cut], np.diff([*cut, len(x)])
    if best:
        order = np.lexsort((y, -n, x))
        order = order[np.append(True, np.diff(x[order]) != 0)]
        x, y, n = x[order], y[order], n[order]
    return _batch(PAIRS, x, y, n, np.full(len(x), need[slot]))


def _distinct(*cols):
    """Distinct rows of the columns, sorted by the first, the second, ..."""
    order = np.lexsort(cols[::-1])
    cols = [c[order] for c in cols]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    return [c[new] for c in cols]


def _hub_task(need: list[int]):
    """Of rows (slot, block, node, sigs) by slot and block: every node with the block that comes first for most of its part hashes."""

    def run(batches):
        now, known, hub = None, None, None
        for slot, (block, node, sigs) in _by_slot(batches, "block", "node", "sigs"):
            if slot != now:
                now, known, hub = slot, np.empty(0, np.uint32), np.empty(0, np.int64)
            sig, many = _listed(sigs)
            sig, block, node = _distinct(sig, *(np.repeat(c.to_numpy(), many) for c in (block, node)))
            new = np.ones(len(sig), bool)
            new[1:] = sig[1:] != sig[:-1]
            fresh = new & ~np.isin(sig, known)
            known, hub = np.concatenate([known, sig[fresh]]), np.concatenate([hub, block[fresh]])
            order = np.argsort(known)
            known, hub = known[order], hub[order]
            yield _counted(node, hub[np.searchsorted(known, sig)], slot, need, True)

    return run


def _late_task(need: list[int], t: Fraction, most: int = 1 << 20):
    """Of rows (slot, root, node, block, n, bits, sigs) by slot: nodes outside the main component of a part hash, with
    the blocks of nodes of other components there that their bitmaps leave possible."""
    num, den = t.numerator, t.denominator

    def possible(x, y, n, bits):
        """Whether the rows x and y, pair by pair, can be linked."""
        out = np.empty(len(x), bool)
        for a in range(0, len(x), 1 << 16):
            i, j = x[a : a + (1 << 16)], y[a : a + (1 << 16)]
            left, right = bits[i], bits[j]
            both = np.minimum(n[i] - np.bitwise_count(left & ~right).sum(1, dtype=np.int64), n[j] - np.bitwise_count(right & ~left).sum(1, dtype=np.int64))
            out[a : a + (1 << 16)] = den * both >= num * (n[i] + n[j] - both)
        return out

    def flush(slot, parts, raws):
        root, node, block, n = (np.concatenate(c) for c in zip(*(p[:4] for p in parts)))
        sig, many = (np.concatenate(c) for c in zip(*(p[4] for p in parts)))
        row = np.repeat(np.arange(len(node)), many)
        s, r = _distinct(sig, root[row])
        mixed = np.unique(s[1:][s[1:] == s[:-1]])  # hashes with more than one component
        keep = np.isin(sig, mixed)
        sig, row = _distinct(sig[keep], row[keep])
        if not len(sig):
            return
        maps = [np.frombuffer(x, np.uint64) for x in raws]
        least = min(map(len, maps))
        bits = np.array([folded(x, least) for x in maps])
        of = root[row]
        order = np.lexsort((of, sig))
        sig, row, of = sig[order], row[order], of[order]
        new_s = np.ones(len(sig), bool)
        new_s[1:] = sig[1:] != sig[:-1]
        new_r = new_s.copy()
        new_r[1:] |= of[1:] != of[:-1]
        r_of, s_of = np.cumsum(new_r) - 1, np.cumsum(new_s) - 1
        size = np.bincount(r_of)
        first = np.flatnonzero(new_r)
        rank = np.lexsort((of[first], size, s_of[first]))  # the last of each hash is its main component
        main = np.zeros(len(first), bool)
        main[rank[np.append(np.diff(s_of[first][rank]) > 0, True)]] = True
        alone = np.flatnonzero(~main[r_of])
        alone = alone[np.argsort(row[alone], kind="stable")]  # a query's pairs are counted together
        lo, hi = np.searchsorted(sig, sig[alone], "left"), np.searchsorted(sig, sig[alone], "right")
        total = np.cumsum(hi - lo)
        a = 0
        while a < len(alone):
            z = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
            if z < len(alone) and (whole := int(np.searchsorted(row[alone], row[alone[z]]))) > a:
                z = whole
            times = (hi - lo)[a:z]
            to = np.repeat(lo[a:z], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            q = np.repeat(alone[a:z], times)
            other = of[to] != of[q]
            q, to = q[other], to[other]
            pair, back = np.unique(row[q].astype(np.int64) * len(node) + row[to], return_inverse=True)
            good = possible(pair // len(node), pair % len(node), n, bits)[back]
            _, x, y = _distinct(sig[q[good]], node[row[q[good]]], block[row[to[good]]])
            if len(x):
                yield _counted(x, y, slot, need)
            a = z

    def run(batches):
        now, parts, raws = None, [], []
        for slot, (root, node, block, n, bits, sigs) in _by_slot(batches, "root", "node", "block", "n", "bits", "sigs"):
            if slot != now:
                if parts:
                    yield from flush(now, parts, raws)
                now, parts, raws = slot, [], []
            parts.append([*(c.to_numpy() for c in (root, node, block, n)), _listed(sigs)])
            raws += bits.to_pylist()
        if parts:
            yield from flush(now, parts, raws)

    return run


def met(pairs: DataFrame, times: int = 2) -> DataFrame:
    """(q, y) that share half the parts a link takes.  Half, because of two linked nodes only one need stand
    outside the main component of each part they share."""
    return pairs.groupBy("q", "y").agg(F.sum("n").alias("n"), F.min("need").alias("need")).where(f"{times} * n >= need").select("q", "y")


MEETING = "y long, salt long, node long, asks boolean, n long, data binary"


def meetings(found: DataFrame, blocks: DataFrame, data: DataFrame) -> DataFrame:
    """Rows of MEETING: the members of each group y of ``found`` (q, y) and then its queries, with their data
    (node, n, data).  A group with many queries meets them in several places."""
    salts = found.groupBy("y").agg(F.ceil(F.count("*") / QUERIES).alias("salts"))
    asks = found.join(salts, "y").select("y", F.pmod(F.xxhash64("q"), "salts").alias("salt"), F.col("q").alias("node"), F.lit(True).alias("asks"))
    held = salts.select("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")).join(blocks.select(F.col("block").alias("y"), "node"), "y").select("y", "salt", "node", F.lit(False).alias("asks"))
    rows = held.unionByName(asks).join(data, "node").select("y", "salt", "node", "asks", "n", "data")
    return rows.repartition("y", "salt").sortWithinPartitions("y", "salt", "asks")


def _groups(batches):
    """(what a new group's members hold, or a query) in order: ("group", nodes, ns, data) and ("ask", node, n, data)."""
    now, members, opened = None, {}, False
    for b in batches:
        for y, salt, node, asks, n, data in zip(*(b.column(c).to_pylist() for c in ("y", "salt", "node", "asks", "n", "data"))):
            if (y, salt) != now:
                now, members, opened = (y, salt), {}, False
            if not asks:
                members[node] = (n, data)
                continue
            if not opened and members:
                opened = True
                yield "group", list(members), np.array([m[0] for m in members.values()]), (y, [np.frombuffer(m[1], np.uint64) for m in members.values()])
            if members:
                yield "ask", node, n, np.frombuffer(data, np.uint64)


def _bound_task(t: Fraction):
    """(q, y) of queries that the group's union and one of its members' bitmaps leave possible."""
    num, den = t.numerator, t.denominator

    def run(batches):
        out_q, out_y = [], []
        for what, node, n, data in _groups(batches):
            if what == "group":
                y, nodes, ns, least, by_width = data[0], np.array(node), n, min(map(len, data[1])), {}
                every = np.array([folded(x, least) for x in data[1]])
                continue
            width = min(least, len(data))
            if width not in by_width:
                held = folded(every, width)
                by_width[width] = held, np.bitwise_or.reduce(held, axis=0)
            held, union = by_width[width]
            mine = folded(data, width)
            if den * (n - int(np.bitwise_count(mine & ~union).sum())) < num * n:
                continue
            both = np.minimum(n - np.bitwise_count(mine & ~held).sum(1).astype(np.int64), ns - np.bitwise_count(held & ~mine).sum(1).astype(np.int64))
            if ((den * both >= num * (n + ns - both)) & (nodes != node)).any():
                out_q.append(node)
                out_y.append(y)
            if len(out_q) >= 10_000:
                yield _batch({"q": pa.int64(), "y": pa.int64()}, out_q, out_y)
                out_q, out_y = [], []
        yield _batch({"q": pa.int64(), "y": pa.int64()}, out_q, out_y)

    return run


def _open_task(t: Fraction):
    """Links between opened groups and their queries: (node, smallest node it hangs together with there)."""
    num, den = t.numerator, t.denominator

    def ends(roots):
        def root(x):
            while roots[x] != x:
                x = roots[x]
            return x

        links = [(v, root(v)) for v in roots]
        links = [x for x in links if x[0] != x[1]]
        return _batch({"a": pa.int64(), "b": pa.int64()}, [x[0] for x in links], [x[1] for x in links])

    def run(batches):
        roots: dict[int, int] = {}

        def root(x):
            while roots.setdefault(x, x) != x:
                roots[x] = x = roots[roots[x]]
            return x

        for what, node, n, data in _groups(batches):
            if what == "group":
                if roots:
                    yield ends(roots)
                    roots.clear()
                nodes, ns = node, n
                union = np.unique(np.concatenate(data[1]))
                matrix = np.zeros((len(union), len(nodes)), np.uint8)
                for j, x in enumerate(data[1]):
                    matrix[np.searchsorted(union, x), j] = 1
                continue
            at = np.minimum(np.searchsorted(union, data), len(union) - 1)
            both = matrix[at[union[at] == data]].sum(0, dtype=np.int64)
            for j in np.flatnonzero(den * both >= num * (n + ns - both)):
                if nodes[j] != node and (x := root(node)) != (y := root(nodes[j])):
                    roots[max(x, y)] = min(x, y)
        yield ends(roots)

    return run


def _token_task(k: int):
    def run(batches):
        seen = set()
        for b in batches:
            nodes, ns, out = [], [], []
            for node, tokens in zip(b.column(0).to_pylist(), token_sets(b.column(1), k)):
                if len(tokens) and node not in seen and node_of(tokens) == node:
                    seen.add(node)
                    nodes.append(node)
                    ns.append(len(tokens))
                    out.append(tokens.tobytes())
            yield _batch({"node": pa.int64(), "n": pa.int64(), "data": pa.binary()}, nodes, ns, out)

    return run


def links_of(found: DataFrame, blocks: DataFrame, keyed: DataFrame, k: int, t: Fraction) -> DataFrame:
    """Links (a, b) among candidates (q, y): bounded by bitmaps, the rest opened."""
    left = staged(meetings(found, blocks, blocks.select("node", "n", F.col("bits").alias("data"))).mapInArrow(_bound_task(t), "q long, y long"), "qualified")
    wanted = left.select(F.col("q").alias("node")).unionByName(left.select("y").distinct().join(blocks.select(F.col("block").alias("y"), "node"), "y").select("node")).distinct()
    wanted = staged(wanted.join(blocks.select("node", "rk"), "node").select("rk", "node"), "wanted")
    tokens = staged(keyed.join(bounded(wanted), "rk").select("node", "text").mapInArrow(_token_task(k), "node long, n long, data binary"), "tokens")
    return staged(meetings(left, blocks, tokens).mapInArrow(_open_task(t), "a long, b long").distinct(), "links", release=True)


def linked_nodes(docs: DataFrame, k: int = 5, t: Fraction = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (rk, doc_id, n, node), one for each document, rk a hash of id and text, node null without shingles; and
    the components (node, root) of nodes that have links."""
    parts = Parts(t)
    keyed = docs.select(F.xxhash64(F.lit(23), id_col, text_col).alias("rk"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = staged(keyed.mapInArrow(_node_task(k, parts), "rk long, doc_id long, n long, level int, node long, bits binary"), "nodes")
    sizes = rows.where("node is not null").groupBy("level").agg(F.sum("n").alias("n")).collect()  # one row for each size class
    slots = Slots(parts, {r.level: r.n for r in sizes}, -(-sum(r.n for r in sizes) // SLOT_TOKENS))
    packed = keyed.select("text").mapInArrow(_signature_task(k, parts, slots), "slot int, payload binary")
    shared = staged(packed.repartition("slot").sortWithinPartitions("slot").mapInArrow(_shared_task(slots.need), "slot int, node long, n long, need int, many long, home long, sigs binary"), "shared", release=True)
    blocks = staged(blocks_of(shared, rows), "blocks")
    placed = shared.select("slot", "node", "sigs").join(blocks.select("node", "block", "n", "bits"), "node")
    hubs = placed.select("slot", "block", "node", "sigs").repartition("slot").sortWithinPartitions("slot", "block").mapInArrow(_hub_task(slots.need), "q long, y long, n long, need int")
    first = links_of(met(hubs, 1), blocks, keyed, k, t)
    roots = components(first)
    # what does not hang together with the main component of a part hash meets the groups of all the others
    late = placed.join(roots, "node", "left").select("slot", F.coalesce("root", "node").alias("root"), "node", "block", "n", "bits", "sigs").repartition("slot").sortWithinPartitions("slot").mapInArrow(_late_task(slots.need, t), "q long, y long, n long, need int")
    second = links_of(met(late), blocks, keyed, k, t)
    return rows.select("rk", "doc_id", "n", "node"), components(first.unionByName(second))


def component_ids(docs: DataFrame, k: int, t: Fraction, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, n_shingles, component_id)."""
    rows, roots = linked_nodes(docs, k, t, id_col, text_col)
    one = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc"))
    placed = staged(one.join(roots, "node", "left").select("node", "doc", F.coalesce("root", "node").alias("root")), "placed")
    least = placed.groupBy("root").agg(F.min("doc").alias("least"))
    named = staged(placed.join(least, "root").select("node", "least"), "named")
    return rows.join(named, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, t: Fraction = Fraction(4, 5), id_col="doc_id", text_col="text") -> DataFrame:
    """The document with the smallest id of each component, and all documents without shingles."""
    rows, roots = linked_nodes(docs, k, t, id_col, text_col)
    rows = rows.join(roots, "node", "left").select("rk", "doc_id", F.coalesce("root", "node").alias("root"))
    once = staged(rows.groupBy("rk").agg(F.min("doc_id").alias("doc_id"), F.min("root").alias("root"), F.count("*").alias("many")), "documents")
    best = once.where("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "rk")).alias("m")).select(F.col("m.rk").alias("rk"), F.lit(True).alias("kept"))
    marked = once.join(best, "rk", "left").where("kept is null and root is not null or many > 1")
    marks = staged(marked.select(F.col("rk").alias("_nj_rk"), (F.col("kept").isNull() & F.col("root").isNotNull()).alias("_nj_gone")), "marks")
    keyed = docs.withColumn("_nj_rk", F.xxhash64(F.lit(23), id_col, text_col)).join(bounded(marks), "_nj_rk", "left").where("not coalesce(_nj_gone, false)")
    out = keyed.where("_nj_gone is null").select(*docs.columns)
    if marks.where("not _nj_gone").limit(1).count():  # rows that are equal in id and text
        out = out.unionByName(keyed.where("_nj_gone is not null").dropDuplicates(["_nj_rk"]).select(*docs.columns))
    return out


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return component_ids(table(spark, sf_dir, "documents"), 3, Fraction(9, 10))


OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i+2], ' ') END AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 2, 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 90 * (na.n + nb.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reach = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.least AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(reach) AS least FROM r GROUP BY 1) m ON m.doc_id = d.doc_id
"""
