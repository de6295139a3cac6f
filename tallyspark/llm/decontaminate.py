"""Benchmark decontamination by template canonicalisation.

Windows of WINDOW words are hash-joined between documents and benchmark in two readings.  Exact windows hold the
words as they are and count wherever they agree.  In template windows numbers, names (capitalised words inside a
sentence) and units are typed placeholders; they need enough literal words, and a hit carries the values of its slots.
In each run of touching windows on a diagonal (document place less item place) these values must map one to one, and
windows with a value that does not are dropped, so a question whose numbers or names were exchanged is caught, and a
text that merely shares the form is not.  A document is contaminated by an item if the hits that count cover LEAST
words of it (all of a shorter item); it is a changed copy if exact windows alone do not.  The first word of a
document's template window is read both as a name and as a literal, if it is capitalised.

Benchmark windows are looked up in blocks of BLOCK hashes, so the set that tasks hold is bounded, whatever the size
of the benchmark; hits alone are shuffled.

Items with fewer than SHORTEST words would be found in any prose; they are found where they stand alone, word for word: as
a line of a document, or as all of it.  Lines and items are hash-joined by their words; no item is left out but those without words.

Defined cases: null or empty texts match nothing; items with too few literal words are found as exact copies only; items are told apart by id and
text, null ids among them; repeated rows are each reported once per pair of ids; null ids are kept as null; empty tables give
empty results; texts are read whole; extra columns are kept by ``remove_contaminated``.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_WORDS, batches_of_bytes, mix64, shingle_hashes, span_hashes, staged, table

#: SHORTEST: from so many words on items are looked for inside a text.
WINDOW, LITERAL, LEAST, SHORTEST, BLOCK = 8, 5, 13, 5, 1 << 20
# Units that become one placeholder.
UNITS = "mm cm m km in ft yd mile miles meter meters metre metres mg g kg t lb lbs oz gram grams ml l liter liters litre litres s sec seconds minute minutes min hour hours day days week weeks month months year years percent pct usd eur gbp dollar dollars euro euros cent cents mph kmh c f k w kw kwh v hz gb mb tb"
NUM, NAME, UNIT, EXACT = (int(x) for x in mix64(np.array([101, 102, 103, 104], np.uint64)))


def _hash_of(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    end = np.cumsum([len(w) for w in raw])
    return np.sort(span_hashes(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], end[:-1]]), end))


_UNITS = _hash_of(UNITS.split())


def canonical(texts: list[bytes]):
    """Of the joined texts: canonical token hashes, value hashes, slot kinds (0 literal), first token of each text, and
    which words are capitalised (names, or literals that begin a sentence)."""
    raw = np.frombuffer(b" ".join(texts), np.uint8)
    buf = ALNUM_WORDS[raw]
    gap = buf == 0x20
    edge = np.flatnonzero(np.diff(gap.view(np.int8), prepend=1, append=1))
    a, b = edge[::2], edge[1::2]
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    value = span_hashes(buf, a, b)
    if not len(a):
        return value, value, np.empty(0, np.int8), np.zeros(len(starts), np.int64), np.empty(0, bool)
    digits = np.concatenate([[0], np.cumsum((raw >= 48) & (raw <= 57))])
    number = digits[b] - digits[a] == b - a
    # a number goes on over one point or comma
    joint = np.zeros(len(a), bool)
    joint[1:] = number[1:] & number[:-1] & (a[1:] - b[:-1] == 1) & np.isin(raw[b[:-1]], (44, 46))
    head = raw[a]
    two = np.where(b - a > 1, raw[np.minimum(a + 1, len(raw) - 1)], 0)
    capital = (head >= 65) & (head <= 90) | (head == 0xC3) & (two >= 0x80) & (two <= 0x9E)
    uppers = np.concatenate([[0], np.cumsum((raw >= 65) & (raw <= 90))])
    shout = uppers[b] - uppers[a] > 1
    # the last visible byte before the word ends a sentence, or there is none
    seen = np.where((raw != 32) & (raw != 9) & (raw != 13), np.arange(len(raw)), -1)
    last = np.maximum.accumulate(seen)
    before = np.where(a > 0, last[np.maximum(a - 1, 0)], -1)
    first_of = starts[np.searchsorted(starts, a, "right") - 1]
    mark = np.where(before >= first_of, raw[np.maximum(before, 0)], 10)
    begins = np.isin(mark, np.frombuffer(b".!?:;\n\"'|*#%$&-(", np.uint8))
    kind = np.zeros(len(a), np.int8)
    kind[capital & ~shout & ~begins] = 2
    kind[np.isin(value, _UNITS)] = 3
    kind[number] = 1
    keep = ~joint
    # the value of a number is that of all its pieces
    piece = np.cumsum(keep) - 1
    total = np.zeros(int(keep.sum()), np.uint64)
    np.add.at(total, piece, np.where(joint, mix64(value + np.uint64(7)), value))
    kind = kind[keep]
    token = total.copy()
    for k, mark_ in ((1, NUM), (2, NAME), (3, UNIT)):
        token[kind == k] = mark_
    return token, total, kind, np.searchsorted(a[keep], starts), (capital & ~shout)[keep] & np.isin(kind, (0, 2))


def windows(token, value, kind, first, capital, size: int, both: bool):
    """(start, hash, exact, slots begin) of all windows of ``size`` words that lie in one text: exact ones, and template
    ones with enough literal words; with ``both`` also those whose capitalised first word is read the other way.
    Slots begin at the second word where the first is read as a literal, and at the first where as a slot."""
    n = len(token) - size + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool), np.empty(0, np.int8)
    text = np.searchsorted(first, np.arange(len(token)), "right")
    whole = text[:n] == text[size - 1 :]
    literal = np.concatenate([[0], np.cumsum(kind == 0)])
    least, held = min(LITERAL, max(3, size - 3)), literal[size:] - literal[:n]
    at, plain = np.flatnonzero(whole & (held >= least)), np.flatnonzero(whole)
    starts, hashes, kinds = [plain, at], [mix64(shingle_hashes(value, size) ^ np.uint64(EXACT))[plain], shingle_hashes(token, size)[at]], [np.zeros(len(plain), np.int8), kind[at] != 0]
    if both:
        literal_now = kind[:n] == 0
        at2 = np.flatnonzero(whole & capital[:n] & (held + np.where(literal_now, -1, 1) >= least))
        other = np.where(literal_now[at2], np.uint64(NAME), value[at2])
        out = np.full(len(at2), size, np.uint64)
        for j in range(size):
            out = out * np.uint64(0x9FB21C651E98DF25) + (token[at2 + j] if j else other)
        starts, hashes, kinds = [*starts, at2], [*hashes, mix64(out)], [*kinds, literal_now[at2]]
    exact = np.repeat([True, False], [len(plain), sum(map(len, starts)) - len(plain)])
    return np.concatenate(starts), np.concatenate(hashes), exact, np.concatenate(kinds).astype(np.int8)


HITS = "id long, rk long, size int, at int, hash long, exact boolean, slots array<long>"


def _rows(ids, rks, size, at, hashes, exact, slots):
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rks, pa.int64()), pa.array([size] * len(ids), pa.int32()), pa.array(at, pa.int32()), pa.array(hashes, pa.int64()), pa.array(exact, pa.bool_()), pa.array(slots, pa.list_(pa.int64()))], names=["id", "rk", "size", "at", "hash", "exact", "slots"])


def _window_task(sizes: list[int], wanted=None):
    """All windows of the texts (id, rk, text), or those whose hash is in the broadcast ``wanted[size]``."""

    def run(batches):
        for b in batches:
            ids, rks = b.column(0).to_pylist(), b.column(1).to_pylist()
            for at0, texts in batches_of_bytes(b.column(2)):
                token, value, kind, first, capital = canonical(texts)
                signed = value.astype(np.int64)
                for size in sizes:
                    pos, h, exact, slotted = windows(token, value, kind, first, capital, size, wanted is not None)
                    if wanted is not None:
                        known = wanted.value[size]
                        near = np.minimum(np.searchsorted(known, h), len(known) - 1)
                        hit = np.flatnonzero(known[near] == h)
                        pos, h, exact, slotted = pos[hit], h[hit], exact[hit], slotted[hit]
                    if not len(pos):
                        continue
                    who = np.searchsorted(first, pos, "right") - 1
                    # a document's exact window needs no slots: they are the item's
                    slots = [[] if e and wanted is not None else [int(signed[j]) for j in range(p, p + size) if (kind[j] if e or j > p else s)] for p, e, s in zip(pos.tolist(), exact.tolist(), slotted.tolist())]
                    yield _rows([ids[at0 + i] for i in who], [rks[at0 + i] for i in who], size, pos - first[who], h.astype(np.int64), exact, slots)

    return run


def _count_task(batches):
    for b in batches:
        out = []
        for _, texts in batches_of_bytes(b.column(1)):
            out += np.diff(canonical(texts)[3]).tolist()
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int32())], names=["rk", "words"])


LINES = "doc_id long, rk long, item_key long, item_id long, item_words int, n_slots long, words array<int>, plain array<int>"


def _line_task(batches):
    """Of each diagonal's windows: the item's words that exact windows cover, and those that consistent ones cover."""
    for b in batches:
        n_slots, words, plain = [], [], []
        for hits in b.column("hits").to_pylist():
            good = [h for h in hits if h["exact"]]
            same = {w for h in good for w in range(h["item_at"], h["item_at"] + h["size"])}
            runs: list = []
            for h in sorted((h for h in hits if not h["exact"]), key=lambda h: h["item_at"]):
                if not runs or h["item_at"] > runs[-1][-1]["item_at"] + h["size"]:
                    runs.append([])
                runs[-1].append(h)
            for run in runs:
                pairs = {p for h in run for p in zip(h["item_slots"], h["slots"])}
                forth, back = Counter(w for w, _ in pairs), Counter(x for _, x in pairs)
                good += [h for h in run if all(forth[w] == 1 and back[x] == 1 for w, x in zip(h["item_slots"], h["slots"]))]
            n_slots.append(len({w for h in good for w in h["item_slots"]}))
            words.append(sorted({w for h in good for w in range(h["item_at"], h["item_at"] + h["size"])}))
            plain.append(sorted(same))
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "rk", "item_key", "item_id", "item_words")), pa.array(n_slots, pa.int64()), pa.array(words, pa.list_(pa.int32())), pa.array(plain, pa.list_(pa.int32()))], names=["doc_id", "rk", "item_key", "item_id", "item_words", "n_slots", "words", "plain"])


_UPPER, _GAPS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def standing_alone(keyed: DataFrame, short: DataFrame) -> DataFrame | None:
    """Hits of items (item_key, item_id, item_words, text) that are a whole line, or the whole text, of rows (id, rk, text)."""
    words = lambda c: F.trim(F.regexp_replace(F.translate(c, _UPPER, _UPPER.lower()), _GAPS, " "))
    short = staged(short.withColumn("key", words("text")).where("key <> ''").drop("text"), "short-items")
    longest = short.agg(F.max(F.length("key"))).first()[0]
    if longest is None:
        return None
    alone = F.explode(F.concat(F.split("text", r"\R"), F.array("text")))
    # a longer key can equal none
    lines = keyed.select(F.col("id").alias("doc_id"), "rk", alone.alias("line")).select("doc_id", "rk", words(F.col("line")).alias("key")).where(F.length("key").between(1, longest))
    hits = lines.join(short, "key").select("doc_id", "rk", "item_key", "item_id", "item_words").distinct()
    return hits.select("doc_id", "rk", "item_id", F.col("item_words").cast("long").alias("words"), "item_words", F.lit(0).cast("long").alias("n_slots"), F.lit(False).alias("changed"))


def contamination(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_id="item_id", item_text="text") -> DataFrame:
    """(doc_id, rk, item_id, words, item_words, n_slots, changed): contaminated pairs, one for each item; rk is a hash of id and text."""
    spark = docs.sparkSession
    items = items.where(F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("id"), F.xxhash64(F.lit(31), item_id, item_text).alias("rk"), F.col(item_text).alias("text")).dropDuplicates(["id", "text"])
    counted = staged(items.select("rk", "text").mapInArrow(_count_task, "rk long, words int"), "items")
    lengths = counted.where(F.col("words") >= SHORTEST)
    short = items.join(counted.where(F.col("words") < SHORTEST), "rk").select(F.col("rk").alias("item_key"), F.col("id").alias("item_id"), F.col("words").alias("item_words"), "text")
    sizes = sorted(r.size for r in lengths.select(F.least("words", F.lit(WINDOW)).alias("size")).distinct().collect())  # at most WINDOW numbers
    out = items.mapInArrow(_window_task(sizes), HITS).join(lengths, "rk").where(F.col("size") == F.least("words", F.lit(WINDOW)))
    bench = staged(out.select(F.col("rk").alias("item_key"), F.col("id").alias("item_id"), F.col("words").alias("item_words"), "size", F.col("at").alias("item_at"), "hash", "exact", F.col("slots").alias("item_slots")), "windows")
    blocks = max(1, -(-bench.count() // BLOCK))
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.lit(29), id_col, text_col).alias("rk"), F.col(text_col).alias("text")).where("text is not null")
    alone, hits = standing_alone(keyed, short), None
    for k in range(blocks):
        part = bench.where(F.pmod(F.xxhash64("hash"), F.lit(blocks)) == k).select("size", "hash").distinct().collect()  # about BLOCK hashes
        known = {s: np.sort(np.array([r.hash for r in part if r.size == s], np.int64).astype(np.uint64)) for s in sizes}
        used = [s for s in sizes if len(known[s])]
        if not used:
            continue
        found = keyed.mapInArrow(_window_task(used, spark.sparkContext.broadcast(known)), HITS)
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return alone if alone is not None else spark.createDataFrame([], "doc_id long, rk long, item_id long, words long, item_words int, n_slots long, changed boolean")
    pairs = hits.distinct().join(bench, ["hash", "size", "exact"]).where("exact or size(slots) = size(item_slots)")
    who = ["doc_id", "rk", "item_key", "item_id", "item_words"]
    pairs = pairs.withColumn("doc_id", F.col("id")).groupBy(*who, (F.col("at") - F.col("item_at")).alias("diagonal")).agg(F.collect_list(F.struct("exact", "item_at", "size", "slots", "item_slots")).alias("hits"))  # no more than the item has windows
    lines = staged(pairs.mapInArrow(_line_task, LINES), "hits")
    word = lines.select(*who, "n_slots", "plain", F.explode("words").alias("word")).withColumn("same", F.when(F.array_contains("plain", F.col("word")), F.col("word")))
    found = word.groupBy(*who).agg(F.count_distinct("word").alias("words"), F.max("n_slots").alias("n_slots"), F.count_distinct("same").alias("same"))
    least = F.least("item_words", F.lit(LEAST))
    found = found.where(F.col("words") >= least).select("doc_id", "rk", "item_id", "words", "item_words", "n_slots", (F.col("same") < least).alias("changed"))
    return found if alone is None else found.unionByName(alone)


def remove_contaminated(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", **names) -> DataFrame:
    """docs without the contaminated ones."""
    bad = contamination(docs, items, id_col, text_col, **names).select(F.col("rk").alias("_dc_rk")).distinct()
    return docs.withColumn("_dc_rk", F.xxhash64(F.lit(29), id_col, text_col)).join(bad, "_dc_rk", "left_anti").drop("_dc_rk")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.max("words").alias("n_words"), F.max("item_words").alias("item_words"), F.max("n_slots").alias("n_slots"), F.min("changed").alias("reparameterised"))
