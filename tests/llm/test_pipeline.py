"""The pipeline against a plain version of its stages on a small fixture."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tallyspark.llm import quality
from tallyspark.llm.common import id_mod, table

from .test_ngram_join import shingles
from .test_suffix_dedup import brute


def fixture(spark, folder):
    rng = random.Random(8)
    words = [a + b + c for a in "bdfgk" for b in ("an", "er", "in", "ot") for c in ("ma", "lo", "ti", "sh")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = text(30)
    passage = text(70)
    rows = []
    for i in range(160):
        kind = i % 16
        t = text(rng.randint(60, 120))
        if kind == 3:
            t = " ".join(w.upper() + "!!" for w in t.split())
        elif kind == 5 and rows:
            w = rows[i - 1][1].split()
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        elif kind == 7:
            t = t + " " + item + " " + text(5)
        elif kind in (9, 11):
            t = t + " " + passage + " " + text(8)
        rows.append((i, t, "en", f"s{i % 3}" if i % 7 else None, len(t)))
    rows += [(900, None, "en", "s0", None), (901, "", "en", "s1", 0), rows[20]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 16 != 3), 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, item


def test_stages_equal_plain_version(spark, tmp_path):
    sf = str(tmp_path)
    rows, item = fixture(spark, sf)
    docs = table(spark, sf, "documents")
    out, columns = [], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        docs.write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        out.append([tuple(r) for r in docs.collect()])
    # quality: junk goes, prose stays
    kept = out[0]
    model = quality.train(table(spark, sf, "documents"), table(spark, sf, "labels"), training=id_mod("doc_id", 4) != 2)
    want = [r[1] for r in rows if model.scores([quality.features(r[1])])[0] >= quality.THRESHOLD]
    assert sorted(map(str, want)) == sorted(str(r[1]) for r in kept)
    assert not {r[0] for r in kept} & {i for i in range(160) if i % 16 == 3}
    assert {i for i in range(160) if i % 16 != 3} <= {r[0] for r in kept}
    # near copies: the smallest id of each component stays, once
    sets = {r[0]: shingles(r[1], 5) for r in kept}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if b < a and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert sorted(r[0] for r in out[1]) == [i for i in ids if find(i) == i]
    assert any(find(i) != i for i in ids)
    # repeats: bytes of strings of 200 that occur twice are cut
    raw = [(r[0], (r[1] or "").encode()) for r in out[1]]
    cut = {d: b for (d, _), b in zip(raw, brute([t for _, t in raw], 200))}
    now = {r[0]: r for r in out[2]}
    assert set(now) == {d for d, (n, gone, _, _) in cut.items() if not gone or n > gone}
    assert all(len((r[1] or "").encode()) == cut[d][0] - cut[d][1] for d, r in now.items())
    assert any(c[1] for c in cut.values())
    # contamination: who still holds 13 words of the item in a row
    grams = {tuple(item.split()[i : i + 13]) for i in range(18)}
    dirty = {d for d, r in now.items() if grams & {tuple((r[1] or "").split()[i : i + 13]) for i in range(len((r[1] or "").split()))}}
    assert {r[0] for r in out[3]} == set(now) - dirty
    # mix: every source near its target, documents at most twice
    words = lambda t: len(re.findall("[^\\x20\\x09-\\x0D]+", t or ""))
    total = sum(words(r[1]) for r in out[3])
    assert abs(sum(r[-2] for r in out[4]) - 1.5 * total) <= 4
    assert max(np.unique([r[0] for r in out[4]], return_counts=True)[1]) <= 2


def test_run_returns_the_last_stage(spark, tmp_path):
    fixture(spark, str(tmp_path))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns[-3:] == ["mix_pass", "mix_words", "mix_position"] and got.where(F.col("mix_words") <= 0).count() == 0
