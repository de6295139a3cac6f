import hashlib
import random
from collections import Counter

import numpy as np

from tallyspark.llm import suffix_dedup as sd

SCHEMA = "doc_id long, text string, n_chars long, rk string"


def brute(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


def made(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abé ") for _ in range(rng.randint(1, 5))) for _ in range(40)]
    passages = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(6)]
    texts = []
    for _ in range(60):
        kind = rng.random()
        if kind < 0.2 and texts:
            t = rng.choice(texts)
            at = rng.randrange(len(t) + 1) if t else 0
            t = t[:at] + rng.choice(["", "x", "yy"]) + t[at + rng.randint(0, 2) :]
        elif kind < 0.6:
            t = " ".join([rng.choice(words) for _ in range(20)] + [rng.choice(passages)] + [rng.choice(words) for _ in range(20)])
        elif kind < 0.7:
            t = "For " * rng.randint(0, 40)
        else:
            t = " ".join(rng.choice(words) for _ in range(rng.randint(0, 120)))
        texts.append(t or "")
    return texts


def digest(spark, rows, length, **how):
    def finish(left, runs):
        import pyarrow as pa

        texts = [t.encode() for t in left.column("text").to_pylist()]
        kept = [sd.kept_bytes(t, r) for t, r in zip(texts, runs)]
        return pa.table([left.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array([len(t) - len(k) for t, k in zip(texts, kept)], pa.int64()), pa.array(map(len, runs), pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sd.cut(df, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", length=length, **how).collect()


def test_against_brute_force(spark):
    for seed, hot in ((1, 4096), (2, 2)):
        texts = made(seed)
        texts += [texts[5], texts[5], ""]
        got = {r.doc_id: tuple(r)[1:] for r in digest(spark, list(enumerate(texts)), 25, hot=hot)}
        assert got == dict(enumerate(brute([t.encode() for t in texts], 25)))


def test_pieces(spark, monkeypatch):
    monkeypatch.setattr(sd, "PIECE", 100)
    texts = made(3)
    texts.append(texts[1] * 9)
    recs = sd.find_records(np.arange(len(texts)), [t.encode() for t in texts], 25)
    assert len({(r["rk"], r["pos"]) for r in recs}) == len(recs)
    monkeypatch.setattr(sd, "PIECE", 1 << 21)
    want = sd.find_records(np.arange(len(texts)), [t.encode() for t in texts], 25)
    assert {tuple(r) for r in recs} == {tuple(r) for r in want}


def test_deep_shallow_orders_out_repeats():
    rng = random.Random(4)
    buf = np.array([rng.choice(b"ab") for _ in range(3000)] * 2 + [rng.choice(b"ab") for _ in range(500)], np.uint8)
    start = np.arange(len(buf) - 40)
    text = buf.tobytes()
    seen = Counter(text[i : i + 40] for i in start)
    for shallow in (0, 1, 3):
        same = sd.deep_shallow(buf, start, np.zeros(len(start), np.int64), 40, shallow)
        assert same.tolist() == [seen[text[i : i + 40]] > 1 for i in start]


def test_nulls_repeats_and_extra_columns(spark):
    long = "abcdefgh " * 40
    rows = [(1, None, None, "x"), (2, "", 0, None), (None, long, 360, "y"), (None, long, 360, "y"), (5, "short", 5, "z")]
    out = sd.dedup_texts(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "text", "n_chars", "rk"]
    assert sorted(map(str, out.collect())) == sorted(map(str, spark.createDataFrame([rows[0], rows[1], rows[4]], SCHEMA).collect()))
    assert sd.dedup_texts(spark.createDataFrame([], SCHEMA)).count() == 0
