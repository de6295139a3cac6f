"""Mixing, licences, quality, toxicity, html: edge cases and plain versions."""

import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import html_extract, licences, mixing, quality, toxicity

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def test_mixing_plain_version(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 30])), rng.choice(["a", "b", "c", None, "b" * 2]), "x") for i in range(200)]
    rows += [(None, None, "a", "x"), (3, "w w", "z", "x"), (3, "w w", "z", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    size = {}
    for _, t, s, _ in rows:
        size[s] = size.get(s, 0) + len(WORD.findall(t or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(size.values())
    while True:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
            free.discard(s)
    target |= {s: level * weight[s] for s in free}
    got = mixing.curriculum(df).collect()
    assert len(got) == len(rows) and "size" in got[0].asDict()
    taken = {}
    for r in got:
        words = sum(t["words"] for t in r._mx_takes)
        assert words <= 2 * r._mx_size and r._mx_target == pytest.approx(target[r.source])
        taken[r.source] = taken.get(r.source, 0) + words
    assert all(taken[s] == math.floor(target[s] + 0.5) for s in order)
    seq = mixing.training_order(df)
    assert seq.columns == [*df.columns, "mix_pass", "mix_words", "mix_position"]
    pos = [r.mix_position for r in seq.collect()]
    assert pos == sorted(pos) and sum(r.mix_words for r in seq.collect()) == sum(taken.values())
    assert mixing.training_order(df.limit(0)).count() == 0


def test_mixing_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    want = sorted(con.sql(f"select doc_id, size, source_size, target, taken, position from ({mixing.OP4_SQL})").fetchall())
    got = mixing.op4_mixing(spark, sf).select("doc_id", "size", "source_size", "target", "taken", "position").collect()
    assert sorted(map(tuple, got)) == want


def test_licences(spark):
    base = {tuple(p.split()): n for p, n in licences.BASE.items()}

    def plain(text):
        words = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        at = [(i, n) for i in range(len(words)) for p, n in base.items() if tuple(words[i : i + len(p)]) == p]
        return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({n for _, n in at}))

    texts = ["Under the MIT License, under the mit-license under the mit license", "cc by nc cc by nc", "Apache License, Version 2.0", "É apache license version 2", "", None, "x" * 10, "under the mit licensex", "CC-BY-NC/cc by\nnc by nc"]
    got = licences.licence_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [tuple(r)[1:6] for r in got] == [plain(t) for t in texts]
    assert got[4].labels == "" and got[4].score == 0 and all(0 <= r.score <= 1 for r in got)
    assert licences.postfix("MIT OR (GPL-2.0 AND BSD-3-Clause)") == ["mit", "gpl-2.0", "bsd-3-clause", "and", "or"]
    assert licences.postfix("(MIT") is None and licences.postfix("AND") is None
    assert licences.evaluate("MIT OR Apache-2.0 AND GPL-2.0 WITH Classpath") == ({"mit", "apache-2", "gpl-2.0 with classpath"}, 2)
    tagged = licences.scan("// SPDX-License-Identifier: (MIT OR Apache-2.0)\ncode")
    assert tagged[5] == "apache-2,mit" and tagged[6] > 0


def labelled(spark, n=240):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = [rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(rng.randint(20, 60))]
        if bad:
            words = [w.upper() + "!!" for w in words]
        if i % 5 == 0:
            words += ["awfulword", "nastyword"] * rng.randint(1, 3)
        docs.append((i, " ".join(words), "x"))
        labels.append((i, int(not bad), int(i % 5 == 0)))
    docs += [(1000, None, "x"), (1001, "", "x"), (None, "alpha", "x"), docs[3]]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark):
    docs, labels = labelled(spark)
    model = quality.train(docs, labels, training=F.col("doc_id") % 3 != 0)
    got = quality.score(docs, model, out="s").collect()
    assert len(got) == docs.count() and got[0].score == "x" and all(0 <= r.s <= 1 for r in got)
    wrong = [r.doc_id for r in got if r.doc_id is not None and r.doc_id < 1000 and (r.s >= 0.5) != (r.doc_id % 4 != 0)]
    assert len(wrong) <= 5
    rows = [quality.features("alpha beta gamma"), quality.features("")]
    idx, val, start = quality.flat(rows)
    val = model._standard(idx, val)
    pair = sum(float(model.v[idx[i]] @ model.v[idx[j]]) * val[i] * val[j] for i in range(start[1]) for j in range(i))
    assert model._raw(idx, val, start)[0][0] == pytest.approx(model.bias + float(model.w[idx[: start[1]]] @ val[: start[1]]) + pair)
    none = quality.train(docs, labels.limit(0))
    assert [r.s for r in quality.score(docs, none, out="s").collect()] == [0.5] * docs.count()
    assert quality.score(docs.limit(0), model, out="s").count() == 0


def test_toxicity_and_exact_neighbours(spark):
    docs, labels = labelled(spark)
    index = toxicity.build_index(docs, labels, training=F.col("doc_id") % 3 != 0)
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, index).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    assert all((got[i] >= 0.7) == (i % 5 == 0) for i in range(240))
    none = toxicity.build_index(docs, labels.limit(0))
    assert {r.score for r in toxicity.toxicity(docs, none).collect()} == {0.0}
    assert toxicity.toxicity(docs.limit(0), index).count() == 0


def test_block_max_index_equals_brute_force():
    rng = np.random.default_rng(3)
    for n, terms, k in ((300, 30, 15), (700, 2000, 15), (40, 8, 3), (5, 9, 15)):
        rows = [rng.choice(terms, int(rng.integers(1, min(terms, 12))), replace=False) for _ in range(n)]
        rows += rows[:3]  # copies tie
        of, h = np.repeat(np.arange(n + 3), [len(r) for r in rows]), np.concatenate([np.sort(r) for r in rows]).astype(np.uint64)
        index = toxicity.BlockMaxIndex(np.arange(terms, dtype=np.uint64), rng.random(terms) + 0.1, rng.integers(0, 2, n + 3).astype(float), np.arange(n + 3))
        known = index.known(of, h, rng.integers(1, 4, len(h)))
        plain = np.zeros((n + 3, terms))
        plain[known[0], known[1]] = known[2]
        place = index.build(*known)
        want = (plain @ plain.T)[:, index.ids]
        labels = index.labels
        for without in (None, place):
            if without is not None:
                want[np.arange(n + 3), place] = -1
            cos, _ = index.cosines(n + 3, *known, k=k, without=without)
            share, proof = index.votes(n + 3, *known, without=without)
            for i in range(n + 3):
                best = np.sort(want[i])[::-1][:k]
                assert np.allclose(np.sort(cos[i])[::-1][: (best > 0).sum()], best[best > 0])
                full = np.sort(want[i])[::-1][toxicity.NEAREST - 1 : toxicity.NEAREST]
                near = np.flatnonzero((want[i] > 1e-9) & (want[i] >= (full[0] if len(full) else -1) - 1e-9))
                assert sorted(proof[i]) == sorted(index.ids[near])
                assert np.isnan(share[i]) if not len(near) else np.isclose(share[i], (want[i][near] * labels[near]).sum() / want[i][near].sum())


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>x</p>";</script></head><body>
<nav class="menu"><ul><li><a href="/a">Home</a><li><a href="/b">About</a></ul></nav><div class="cookie-banner">We use cookies.</div>
<article><h1>Big &amp; Small</h1><p>First <b>para</b>graph of the text, with a   long\nline.<br><p>Second paragraph &lt;here&gt;, that goes on for a while and ends.</article>
<div id="comments"><h3>Comments</h3><p>Nice article, thanks for it all.</p></div><footer>&copy; 2020 Site</footer>"""


def test_html(spark):
    got = [t for t, _, _ in html_extract.leaves(PAGE)]
    assert got[:2] == ["Home", "About"] and "First paragraph of the text, with a long line." in got and got[-1] == "© 2020 Site"
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>"), (1, "u", PAGE)], "page_id long, url string, html string")
    rows = html_extract.extract(df).orderBy("page_id").collect()
    want = "Big & Small\nFirst paragraph of the text, with a long line.\nSecond paragraph <here>, that goes on for a while and ends."
    assert [(r.page_id, r.text) for r in rows] == [(1, want), (1, want), (2, ""), (3, ""), (4, "")] and rows[0].n_chars == len(want)
    made, wrong, n = html_extract.Templates(99), 0, 0
    net = html_extract.trained()
    for _ in range(60):
        html, y = made.page()
        got = html_extract.leaves(html)
        if len(got) == len(y):
            wrong += int(((net.labels([got])[0] >= 0.5) != np.array(y)).sum())
            n += len(y)
    assert wrong / n < 0.02


def test_lstm_gradients():
    net = html_extract.Labeller(1)
    rng = np.random.default_rng(0)
    x, mask, y = rng.random((4, 3, html_extract.PATH + html_extract.WORDS + html_extract.FIGURES)), np.ones((4, 3)), rng.integers(0, 2, (4, 3))
    mask[3, 1] = 0
    net.p = {k: v.astype(float) for k, v in net.p.items()}

    def loss():
        p, _ = net.forward(x, mask)
        return -((y * np.log(p) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum()

    g = net.gradients(x, y, mask)
    for k in ("Wf", "Ub", "cf", "O", "E"):
        at = tuple(s // 2 for s in net.p[k].shape)
        old, eps = net.p[k][at], 1e-4
        net.p[k][at] = old + eps
        up = loss()
        net.p[k][at] = old - eps
        down = loss()
        net.p[k][at] = old
        assert g[k][at] == pytest.approx((up - down) / (2 * eps), rel=2e-2, abs=1e-5)


def test_licences_later_versions_and_many_hits():
    assert licences.scan("SPDX-License-Identifier: GPL-2.0+")[5] == "gpl-2.0-or-later"
    assert licences.scan("SPDX-License-Identifier: (MIT AND GPL-3.0+)")[5] == "gpl-3.0-or-later,mit"
    text = "word cc by nc " * 20000
    n, base, first, last = licences.scan(text)[:4]
    assert (n, base, first, last) == (80000, 20000, 1, 79997)
