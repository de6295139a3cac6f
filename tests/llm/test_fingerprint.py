"""Fingerprints against a plain version of bins, densification, packing and edits."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from tallyspark.llm import fingerprint as fp

SCHEMA = "doc_id long, text string, n_chars string, _key int"


def shingles(text: str) -> set[str]:
    words = [w for w in re.split("[\\x20\\x09-\\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain(text: str) -> str:
    bins: dict[int, int] = {}
    for s in shingles(text):
        v = int(hashlib.md5(s.encode()).hexdigest()[:15], 16)
        bins[v >> 52] = min(v, bins.get(v >> 52, v))
    if not bins:
        return ""
    out = []
    for b in range(256):
        tried = [b] + [(b * a + c) % fp.PRIME % 256 for a, c in fp.PROBES]
        ranked = sorted(bins, key=lambda j: ((b + 1) * fp.ROOT % fp.PRIME * (j + 1) + b) % fp.PRIME)
        out.append("%x" % (bins[next(j for j in tried + ranked if j in bins)] & 15))
    return "".join(out)


def likeness(a: str, b: str) -> float:
    if not a or not b:
        return float(a == b)
    return max(0.0, (sum(x == y for x, y in zip(a, b)) / 256 - 1 / 16) / (15 / 16))


def test_query_equals_plain_version(spark, tmp_path):
    rng = random.Random(3)
    words = [f"Wörd{i}" for i in range(500)]
    rows = [(i * 3 - 20, " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 4, 5, 6, 40, 400])))) for i in range(80)]
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "é" * 9), (1004, "a b c d 𝒳𝒳𝒳"), (1005, "same text here for all of them"), (1006, "same text here for all of them")]
    rows += [(7777, "repeated row of some more words")] * 4 + [(7777, "another text of the same id")] + [(None, "no id at all, twice")] * 2 + [(9000, "long words " * 60_000)]
    spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = fp.op11_fingerprint(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    key = lambda r: hashlib.sha256(f"{'-' if r[0] is None else r[0]}:{r[1] or ''}".encode()).hexdigest()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, key(r)))
    want = []
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        t, u = t or "", u or ""
        cut = len(t) // 4
        new = t[: len(t) - cut] + u[:cut]
        a, b, c = plain(t), plain(new), plain(u)
        want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), a, b, likeness(a, b), likeness(a, c)))
    text = lambda r: tuple(str(v) for v in r)
    assert sorted(map(tuple, got.collect()), key=text) == sorted(want, key=text)


def test_estimate_is_near_jaccard(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(2000)]
    pairs = []
    for k in range(60):
        a = rng.choices(words, k=600)
        b = a[: 10 * k] + rng.choices(words, k=600 - 10 * k)
        pairs.append((k, " ".join(a), " ".join(b)))
    df = spark.createDataFrame(pairs, "k int, a string, b string")
    got = df.select("k", fp.likeness(fp.fingerprint(F.col("a")), fp.fingerprint(F.col("b"))).alias("s")).collect()
    off = [r.s - len(shingles(pairs[r.k][1]) & shingles(pairs[r.k][2])) / len(shingles(pairs[r.k][1]) | shingles(pairs[r.k][2])) for r in got]
    assert abs(sum(off) / len(off)) < 0.02 and max(map(abs, off)) < 0.15


def test_single_and_empty(spark, tmp_path):
    df = spark.createDataFrame([(4, "one two three four five six seven eight")], "doc_id long, text string")
    row = fp.edited_and_next(df).collect()
    assert len(row) == 1 and row[0].near_next == 1.0
    assert fp.edited_and_next(df.limit(0)).count() == 0


def test_main_path_has_no_python(spark):
    plan = fp.op11_fingerprint(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|MapIn|ExternalRDD", plan)
