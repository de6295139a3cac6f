"""Removal of repeated byte strings by deep-shallow suffix sorting, spread over Spark.

Goal: every byte that lies in a ``length``-byte string which also starts somewhere else goes.

1. Sampled suffixes.  Of the k-gram hashes (k = 2/5 of the length) inside each window of ``length`` bytes
   the smallest marks a suffix.  Equal windows mark the same place, so two equal strings always have a
   marked suffix in common; about one position in 60 is marked.
2. Marked suffixes meet by k-gram hash in numpy-packed blocks.  Where the whole neighbourhood of a mark
   (all windows that hold it) is hashed alike in another place (128 bits together), its bytes go at once.
   A map task ships one record for each distinct neighbourhood, so copies cannot pile up in a task.
3. Marks whose k-gram recurs with another neighbourhood lie near the edge of a repeat.  All window starts
   about them are suffixes to be sorted: a multikey quicksort over 8-byte characters down to a shallow
   depth, then blind tries over the groups that still agree.  Suffixes that agree over the full length are
   repeats.  Of a k-gram with more than HOT neighbourhoods every window is hashed (128 bits with the k-gram), a
   map task ships one record for each distinct window, and these are dealt by their hash: windows meet only where
   they agree, and no more often than there are tasks.
4. Spans are joined to the texts and cut.

Defined cases: null text is the empty text; texts under ``length`` bytes lose nothing; rows that are equal
throughout are copies of each other; null ids are kept; an empty table gives an empty result; texts of any
length are read whole, in pieces; extra columns are kept by ``dedup_texts``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_of_bytes, mix64, partitions_for, staged, table, text_of

LENGTH = 200
SHALLOW = 3  # characters of 8 bytes
PIECE = 1 << 19
HOT = 4096
RECORD = np.dtype([("g", "<u8"), ("c", "<u8"), ("rk", "<i8"), ("pos", "<u4"), ("right", "u1"), ("dup", "u1")])
SPAN = np.dtype([("rk", "<i8"), ("start", "<u4"), ("end", "<u4")])
PROBE = np.dtype([("g", "<u8"), ("rk", "<i8"), ("pos", "<u4"), ("hot", "u1")])
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers: dict = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(steps)
    return have[:n]


def _sliding(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over x[i : i + w] for every full window, from block prefixes and suffixes."""
    n = len(x)
    blocks = -(-n // w)
    pad = np.full(blocks * w, x[-1], x.dtype)
    pad[:n] = x
    grid = pad.reshape(blocks, w)
    head = op.accumulate(grid, axis=1).ravel()
    tail = op.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(tail[: n - w + 1], head[w - 1 : n])


class Marker:
    """Rolling hashes of a buffer of texts, and the marked suffixes in it."""

    def __init__(self, buf: np.ndarray, length: int):
        self.length, self.k = length, length * 2 // 5
        self.w = length - self.k + 1
        self.buf, n = buf, len(buf)
        self.inv = _power(_INV, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[buf] * _power(_BASE, n), out=self.sums[1:])

    def span_hash(self, a, b):
        return (self.sums[b] - self.sums[a]) * self.inv[a]

    def grams(self) -> np.ndarray:
        n = len(self.buf) - self.k + 1
        return mix64((self.sums[self.k :] - self.sums[:n]) * self.inv[:n])

    def marks(self, first: np.ndarray, last: np.ndarray):
        """Positions that are smallest in a window of which the start lies in some [first, last), and the grams."""
        h = self.grams()
        low = _sliding(h, self.w, np.minimum)  # by window start
        ok = np.zeros(len(low) + 1, np.int32)
        np.add.at(ok, np.minimum(first, len(low)), 1)
        np.add.at(ok, np.minimum(last, len(low)), -1)
        low[np.cumsum(ok[:-1]) == 0] = 0
        most = _sliding(np.concatenate([np.zeros(self.w - 1, np.uint64), low, np.zeros(self.w - 1, np.uint64)]), self.w, np.maximum)
        return np.flatnonzero((most == h) & (h != 0)), h


def _pieces(texts: list[bytes], length: int):
    """Buffers of about PIECE bytes: (buffer, text numbers, text starts, text ends, offset of the buffer in its
    text, first and last window starts).  Long texts come in pieces that overlap by their neighbourhoods."""
    at, size, group = 0, 0, []
    out = []
    for i, t in enumerate(texts):
        if len(t) < length:
            continue
        if len(t) > 2 * PIECE:
            for a in range(0, len(t) - length + 1, PIECE):
                b = min(a + PIECE, len(t) - length + 1)
                a0, b0 = max(0, a - length), min(len(t), b + 3 * length)
                out.append((np.frombuffer(t, np.uint8)[a0:b0], np.array([i]), np.array([0]), np.array([b0 - a0]), a0, np.array([a - a0]), np.array([b - a0])))
            continue
        group.append(i)
        size += len(t)
        if size >= PIECE:
            out.append(group)
            group, size = [], 0
    if group:
        out.append(group)
    for x in out:
        if isinstance(x, list):
            ends = np.cumsum([len(texts[i]) for i in x])
            starts = np.concatenate([[0], ends[:-1]])
            yield np.frombuffer(b"".join(texts[i] for i in x), np.uint8), np.array(x), starts, ends, 0, starts, ends - length + 1
        else:
            yield x


def find_records(keys: np.ndarray, texts: list[bytes], length: int) -> np.ndarray:
    """A RECORD for every marked suffix."""
    found, where = [], []
    for buf, who, starts, ends, shift, first, last in _pieces(texts, length):
        m = Marker(buf, length)
        pos, h = m.marks(first, last)
        if not len(pos):
            continue
        d = np.searchsorted(ends, pos, side="right")
        a, b = np.maximum(pos - (m.w - 1), starts[d]), np.minimum(pos + length, ends[d])
        rec = np.zeros(len(pos), RECORD)
        rec["g"], rec["rk"], rec["pos"], rec["right"] = h[pos], keys[who[d]], pos - starts[d] + shift, b - pos
        rec["c"] = mix64(m.span_hash(a, b) + mix64(((pos - a) * 1024 + (b - pos)).astype(np.uint64)))
        found.append(rec)
        where.append(who[d].astype(np.int64) << 32 | rec["pos"])
    if not found:
        return np.empty(0, RECORD)
    return np.concatenate(found)[np.unique(np.concatenate(where), return_index=True)[1]]  # pieces overlap


def _spans(rec: np.ndarray, w: int) -> np.ndarray:
    out = np.empty(len(rec), SPAN)
    out["rk"], out["end"] = rec["rk"], rec["pos"] + rec["right"]
    out["start"] = np.maximum(rec["pos"].astype(np.int64) - (w - 1), 0)
    return out


def _by(x: np.ndarray, *names) -> np.ndarray:
    return np.lexsort(tuple(x[n] for n in reversed(names)))


def _blocks(x: np.ndarray, slot: np.ndarray):
    """(slot, bytes) for each slot that occurs."""
    order = np.argsort(slot, kind="stable")
    x, slot = x[order], slot[order]
    cut = np.flatnonzero(np.diff(slot, prepend=-1)) if len(slot) else []
    for a, b in zip(cut, [*cut[1:], len(slot)]):
        yield int(slot[a]), x[a:b].tobytes()


def _rows(pairs, kind: int):
    pairs = list(pairs)
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int32()), pa.array([kind] * len(pairs), pa.int32()), pa.array([p[1] for p in pairs], pa.binary())], names=["slot", "kind", "payload"])


PACKED = "slot int, kind int, payload binary"


def _mark_task(length: int, slots: int, text_slots: int):
    def run(batches):
        w = length - length * 2 // 5 + 1
        found = []
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            for first, texts in batches_of_bytes(b.column(1), 4 * PIECE):
                found.append(find_records(keys[first : first + len(texts)], texts, length))
        if not found:
            return
        rec = np.concatenate(found)
        rec = rec[_by(rec, "g", "c")]
        new = np.ones(len(rec), bool)
        new[1:] = (rec["g"][1:] != rec["g"][:-1]) | (rec["c"][1:] != rec["c"][:-1])
        group = np.cumsum(new) - 1
        many = np.bincount(group) > 1 if len(rec) else np.empty(0, bool)
        gone = many[group]
        yield _rows(_blocks(s := _spans(rec[gone], w), s["rk"] % text_slots), 0)
        rec["dup"] = gone
        ship = rec[new]
        yield _rows(_blocks(ship, (ship["g"] % np.uint64(slots)).astype(np.int64)), 1)

    return run


def _slots_of(batches):
    """(slot, [payloads]) of sorted packed rows, slot by slot."""
    now, have = None, []
    for b in batches:
        for s, p in zip(b.column("slot").to_pylist(), b.column("payload").to_pylist()):
            if s != now:
                if have:
                    yield now, have
                now, have = s, []
            have.append(p)
    if have:
        yield now, have


def _meet_task(length: int, text_slots: int, hot: int):
    def run(batches):
        w = length - length * 2 // 5 + 1
        for _, parts in _slots_of(batches):
            rec = np.concatenate([np.frombuffer(p, RECORD) for p in parts])
            rec = rec[_by(rec, "g", "c")]
            new_g = np.ones(len(rec), bool)
            new_g[1:] = rec["g"][1:] != rec["g"][:-1]
            new = new_g.copy()
            new[1:] |= rec["c"][1:] != rec["c"][:-1]
            group, of_g = np.cumsum(new) - 1, np.cumsum(new_g) - 1
            n = np.bincount(group)
            known = n > 1
            known[group[rec["dup"] > 0]] = True
            kinds = np.bincount(of_g[new])  # distinct neighbourhoods of each gram
            gone = known[group]
            s = _spans(rec[gone & (rec["dup"] == 0)], w)
            if len(s):
                yield _rows(_blocks(s, s["rk"] % text_slots), 0)
            ask = new & (kinds[of_g] > 1)  # one of each neighbourhood
            open_g = np.zeros(len(kinds), bool)
            open_g[of_g[~gone]] = True  # some neighbourhood of the gram is still undecided
            ask &= open_g[of_g]
            if ask.any():
                p = np.empty(int(ask.sum()), PROBE)
                p["g"], p["rk"], p["pos"], p["hot"] = rec["g"][ask], rec["rk"][ask], rec["pos"][ask], kinds[of_g[ask]] > hot
                yield _rows(_blocks(p, p["rk"] % text_slots), 2)

    return run


def window_range(h: np.ndarray, pos: np.ndarray, w: int, n_windows: int):
    """First and last start of the windows of which pos is the rightmost smallest gram."""
    step = np.arange(1, w + 1)
    at = h[pos][:, None]
    left = np.where(pos[:, None] - step >= 0, h[np.maximum(pos[:, None] - step, 0)] < at, True)
    right = np.where(pos[:, None] + step < len(h), h[np.minimum(pos[:, None] + step, len(h) - 1)] <= at, False)
    lo = np.maximum(pos - np.where(left.any(1), left.argmax(1), w), pos - w + 1)
    hi = np.minimum(np.where(right.any(1), pos + right.argmax(1) + 1 - w, pos), pos)
    return np.maximum(lo, 0), np.minimum(hi, n_windows - 1)


def contexts(text: bytes, probes: np.ndarray, length: int):
    """For each probe of the text: the probe, first and last window start, and the bytes of these windows, or their
    hashes if the k-gram is hot."""
    raw = np.frombuffer(text, np.uint8)
    for a in range(0, len(raw), PIECE):  # long texts by pieces
        mine = probes[(probes["pos"] >= a) & (probes["pos"] < a + PIECE)]
        if not len(mine):
            continue
        a0, b0 = max(0, a - 2 * length), min(len(raw), a + PIECE + 2 * length)
        m = Marker(raw[a0:b0], length)
        h = m.grams()
        lo, hi = window_range(h, mine["pos"].astype(np.int64) - a0, m.w, len(raw) - a0 - length + 1)
        for p, x, y in zip(mine, lo.tolist(), hi.tolist()):
            if y < x:
                continue
            if p["hot"]:
                at = np.arange(x, y + 1)
                yield p, x + a0, y + a0, mix64(m.span_hash(at, at + length) + (p["pos"].astype(np.int64) - a0 - at).astype(np.uint64))
            else:
                yield p, x + a0, y + a0, text[x + a0 : y + a0 + length]


CONTEXT = {"slot": pa.int32(), "kind": pa.int32(), "g": pa.int64(), "rk": pa.int64(), "pos": pa.int64(), "lo": pa.int64(), "hi": pa.int64(), "bytes": pa.binary()}


def _alike(rec: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of window records: spans of those that occur more than once, and one record of each, which says so."""
    rec = rec[_by(rec, "g", "c")]
    new = np.ones(len(rec), bool)
    new[1:] = (rec["g"][1:] != rec["g"][:-1]) | (rec["c"][1:] != rec["c"][:-1])
    group = np.cumsum(new) - 1
    many = np.bincount(group) > 1
    many[group[rec["dup"] > 0]] = True
    rec["dup"] = many[group]
    gone = rec[rec["dup"] > 0]
    spans = np.empty(len(gone), SPAN)
    spans["rk"], spans["start"], spans["end"] = gone["rk"], gone["pos"], gone["pos"] + length
    return spans, rec[new]


def _context_task(length: int, slots: int, text_slots: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out, hot = [], []
        if right.num_rows and left.num_rows:
            probes = np.concatenate([np.frombuffer(p, PROBE) for p in right.column("payload").to_pylist()])
            probes = probes[_by(probes, "rk", "pos")]
            keys = left.column("rk").to_numpy()
            lo, hi = np.searchsorted(probes["rk"], keys, "left"), np.searchsorted(probes["rk"], keys, "right")
            seen = set()
            for i in np.flatnonzero(hi > lo):
                if keys[i] in seen:  # equal rows: one is enough
                    continue
                seen.add(keys[i])
                text = left.column("text")[int(i)].as_py().encode("utf-8", "surrogatepass")
                for p, x, y, ctx in contexts(text, probes[lo[i] : hi[i]], length):
                    if p["hot"]:
                        rec = np.zeros(y - x + 1, RECORD)
                        rec["g"], rec["c"], rec["rk"], rec["pos"] = p["g"], ctx, keys[i], np.arange(x, y + 1)
                        hot.append(rec)
                    else:
                        out.append((int(p["g"] % np.uint64(slots)), 2, int(p["g"].astype(np.int64)), int(keys[i]), int(p["pos"]), x, y, ctx))
        if hot:
            spans, rec = _alike(np.concatenate(hot), length)
            out += [(slot, 0, 0, 0, 0, 0, 0, raw) for slot, raw in _blocks(spans, spans["rk"] % text_slots)]
            out += [(slot, 1, 0, 0, 0, 0, 0, raw) for slot, raw in _blocks(rec, (mix64(rec["c"]) % np.uint64(slots)).astype(np.int64))]
        cols = list(zip(*out)) if out else [()] * len(CONTEXT)
        return pa.table([pa.array(c, t) for c, t in zip(cols, CONTEXT.values())], names=list(CONTEXT))

    return run


def deep_shallow(buf: np.ndarray, start: np.ndarray, group: np.ndarray, length: int, shallow: int = SHALLOW) -> np.ndarray:
    """Which suffixes agree with another of their group over the full length.

    Shallow: multikey quicksort, all groups at once; a character is 8 bytes, suffixes alone in their part
    drop out.  Deep: a blind trie for each part, built along its first suffix: the place where a member
    first differs and the byte there name the branch it goes to; members that never differ are equal."""
    same = np.zeros(len(start), bool)
    live, part = np.arange(len(start)), group
    for depth in range(min(shallow, length // 8)):
        at = start[live] + depth * 8
        char = np.ascontiguousarray(buf[at[:, None] + np.arange(8)]).view(">u8").ravel().astype(np.uint64)
        order = np.lexsort((char, part))
        live, part, char = live[order], part[order], char[order]
        new = np.ones(len(live), bool)
        new[1:] = (part[1:] != part[:-1]) | (char[1:] != char[:-1])
        ids = np.cumsum(new) - 1
        keep = np.bincount(ids, minlength=1)[ids] > 1 if len(ids) else np.empty(0, bool)
        live, part = live[keep], ids[keep]
        if not len(live):
            return same
    done = min(shallow, length // 8) * 8
    rest = np.arange(done, length)
    while len(live):
        order = np.argsort(part, kind="stable")
        live, part = live[order], part[order]
        new = np.ones(len(live), bool)
        new[1:] = part[1:] != part[:-1]
        first = np.flatnonzero(new)
        ids = np.cumsum(new) - 1
        branch = np.empty(len(live), np.int64)
        for a in range(0, len(live), 1 << 16):  # bounded memory
            b = min(a + (1 << 16), len(live))
            mine, lead = buf[start[live[a:b]][:, None] + rest], buf[start[live[first[ids[a:b]]]][:, None] + rest]
            differs = mine != lead
            where = differs.argmax(1)
            rows = np.arange(b - a)
            branch[a:b] = np.where(differs[rows, where], where * 256 + mine[rows, where] + 1, 0)
        equal = branch == 0  # the leader itself, and what agrees with it
        twice = np.bincount(ids[equal], minlength=len(first)) > 1
        same[live[equal & twice[ids]]] = True
        live, ids, branch = live[~equal], ids[~equal], branch[~equal]
        key = ids * (length * 256 + 2) + branch
        _, part, count = np.unique(key, return_inverse=True, return_counts=True) if len(key) else (None, key, key)
        keep = count[part] > 1 if len(key) else np.empty(0, bool)
        live, part = live[keep], part[keep]
    return same


def sort_contexts(rows: list[tuple], length: int) -> np.ndarray:
    """Spans of repeated windows among contexts (g, rk, pos, lo, hi, bytes) that share a slot."""
    rows.sort(key=lambda r: r[0])
    g = np.array([r[0] for r in rows])
    pos, lo, hi = (np.array([r[k] for r in rows]) for k in (2, 3, 4))
    size = np.array([len(r[5]) for r in rows])
    buf = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
    base = np.concatenate([[0], np.cumsum(size)[:-1]])
    n = hi - lo + 1
    new = np.ones(len(rows), bool)
    new[1:] = g[1:] != g[:-1]
    gid = np.cumsum(new) - 1
    of = np.repeat(np.arange(len(rows)), n)
    step = np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    offset = (pos - lo)[of] - step  # of the mark in its window
    same = deep_shallow(buf, base[of] + step, gid[of] * (length + 1) + offset, length)
    hit = np.flatnonzero(same)
    if not len(hit):
        return np.empty(0, SPAN)
    s = lo[of[hit]] + step[hit]
    new = np.ones(len(hit), bool)
    new[1:] = (np.diff(of[hit]) != 0) | (np.diff(s) != 1)
    a = np.flatnonzero(new)
    b = np.concatenate([a[1:], [len(hit)]]) - 1
    out = np.empty(len(a), SPAN)
    out["rk"], out["start"], out["end"] = np.array([r[1] for r in rows])[of[hit[a]]], s[a], s[b] + length
    return out


def _sort_task(length: int, text_slots: int, most: int = 1 << 20):
    def flush(rows):
        s = sort_contexts(rows, length)
        return [_rows(_blocks(s, s["rk"] % text_slots), 0)] if len(s) else []

    def alike(parts):
        s, _ = _alike(np.concatenate(parts), length)
        return [_rows(_blocks(s, s["rk"] % text_slots), 0)] if len(s) else []

    def run(batches):
        rows, now, suffixes, windows, slot_now = [], None, 0, [], None
        for b in batches:
            for slot, kind, *r in zip(*(c.to_pylist() for c in b.columns)):
                if windows and (kind != 1 or slot != slot_now):
                    yield from alike(windows)
                    windows = []
                if kind == 0:
                    yield _rows([(slot, r[5])], 0)
                elif kind == 1:
                    slot_now = slot
                    windows.append(np.frombuffer(r[5], RECORD))
                else:
                    if r[0] != now:
                        if suffixes > most:
                            yield from flush(rows)
                            rows, suffixes = [], 0
                        now = r[0]
                    rows.append(r)
                    suffixes += r[4] - r[3] + 1
        if windows:
            yield from alike(windows)
        if rows:
            yield from flush(rows)

    return run


def merged(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Union of spans as maximal runs."""
    if not len(start):
        return []
    order = np.argsort(start, kind="stable")
    start, end = start[order].astype(np.int64), np.maximum.accumulate(end[order].astype(np.int64))
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    a = np.flatnonzero(new)
    return list(zip(start[a].tolist(), end[np.concatenate([a[1:], [len(start)]]) - 1].tolist()))


def repeated_spans(keyed: DataFrame, length: int = LENGTH, hot: int = HOT) -> tuple[DataFrame, int]:
    """Packed spans of repeated strings of ``keyed`` (rk, text, slot), by slot of the text."""
    slots, text_slots = 4 * partitions_for(keyed), 8 * partitions_for(keyed)
    found = keyed.select("rk", "text").mapInArrow(_mark_task(length, slots, text_slots), PACKED)
    found = staged(found, "marks")
    meet = found.where("kind = 1").repartition("slot").sortWithinPartitions("slot").mapInArrow(_meet_task(length, text_slots, hot), PACKED)
    return found.where("kind = 0"), staged(meet, "meet")


def cut(docs: DataFrame, finish, schema, length: int = LENGTH, text_col: str = "text", id_col: str = "doc_id", hot: int = HOT) -> DataFrame:
    """Applies finish(row table, list of removed runs by row) to all rows, slot by slot of their key."""
    slots, text_slots = 4 * partitions_for(docs), 8 * partitions_for(docs)
    text = text_of(text_col)
    keyed = docs.withColumn("rk", F.xxhash64(F.lit(17), id_col, text_col)).withColumn("text", text) if text_col == "text" else docs.withColumns({"rk": F.xxhash64(F.lit(17), id_col, text_col), "text": text})
    keyed = keyed.withColumn("slot", F.pmod("rk", F.lit(text_slots)).cast("int"))
    local, meet = repeated_spans(keyed, length, hot)
    texts = keyed.groupBy("slot")
    probes = meet.where("kind = 2")
    ctx = texts.cogroup(probes.groupBy("slot")).applyInArrow(_context_task(length, slots, text_slots), "slot int, kind int, g long, rk long, pos long, lo long, hi long, bytes binary")
    late = ctx.repartition("slot").sortWithinPartitions("slot", "kind", "g").mapInArrow(_sort_task(length, text_slots), PACKED)
    spans = local.unionByName(meet.where("kind = 0")).unionByName(late)

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        got = np.concatenate([np.frombuffer(p, SPAN) for p in right.column("payload").to_pylist()]) if right.num_rows else np.empty(0, SPAN)
        got = got[np.argsort(got["rk"], kind="stable")]
        keys = left.column("rk").to_numpy()
        lo, hi = np.searchsorted(got["rk"], keys, "left"), np.searchsorted(got["rk"], keys, "right")
        runs = [merged(got["start"][a:b], got["end"][a:b]) if b > a else [] for a, b in zip(lo, hi)]
        return finish(left, runs)

    return texts.cogroup(spans.groupBy("slot")).applyInArrow(apply, schema)


def kept_bytes(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    if not runs:
        return text
    edge = [0, *(x for r in runs for x in r), len(text)]
    return b"".join(text[a:b] for a, b in zip(edge[::2], edge[1::2]))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def finish(left, runs):
        texts = [t.encode("utf-8", "surrogatepass") for t in left.column("text").to_pylist()]
        kept = [kept_bytes(t, r) for t, r in zip(texts, runs)]
        n, m = [len(t) for t in texts], [len(t) for t in kept]
        return pa.table([left.column("doc_id"), pa.array(n, pa.int64()), pa.array([a - b for a, b in zip(n, m)], pa.int64()), pa.array([len(r) for r in runs], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return cut(docs, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup_texts(docs: DataFrame, length: int = LENGTH, text_col: str = "text", id_col: str = "doc_id", n_chars_col: str | None = "n_chars") -> DataFrame:
    """docs with the repeated bytes cut out of the texts (a character cut in two goes); rows of which no
    visible text is left are dropped, if they had any."""
    names, fields = docs.columns, docs.schema.fields
    inner = docs.withColumn("_sd_text", F.col(text_col)) if text_col != "text" else docs
    clash = {c: f"_sd_col_{i}" for i, c in enumerate(names) if c in ("rk", "slot")}
    inner = inner.withColumnsRenamed(clash)

    def finish(left, runs):
        old = left.column("text").to_pylist()
        new = [t if not r else kept_bytes(t.encode("utf-8", "surrogatepass"), r).decode("utf-8", "ignore") for t, r in zip(old, runs)]
        keep = pa.array([not r or bool(t.strip()) for t, r in zip(new, runs)], pa.bool_())
        cols = []
        for c in names:
            col = left.column(clash.get(c, c))
            if c == text_col:
                col = pa.array([None if v and not r else t for t, v, r in zip(new, left.column("_sd_null").to_pylist(), runs)], pa.string())
            elif c == n_chars_col:
                col = pa.array([len(t) if r else v for t, r, v in zip(new, runs, col.to_pylist())], col.type)
            cols.append(col)
        return pa.table(cols, names=names).filter(keep)

    inner = inner.withColumn("_sd_null", F.col(text_col).isNull())
    return cut(inner, finish, T.StructType(fields), length, text_col, clash.get(id_col, id_col))
