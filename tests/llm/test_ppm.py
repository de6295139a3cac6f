import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyspark.llm import ppm


def words(t):
    return ppm.normal((t or "").encode())[:-1].split()


def brute_ppm(train, text, order):
    """Straightforward trie with exclusion by sets."""
    trie = defaultdict(Counter)
    for t in train:
        s = b"\n" * order + ppm.normal((t or "").encode())
        for i in range(order, len(s)):
            for d in range(order + 1):
                trie[s[i - d : i]][s[i]] += 1
    s = b"\n" * order + ppm.normal((text or "").encode())
    total = 0.0
    for i in range(order, len(s)):
        gone = set()
        for d in range(order, -1, -1):
            node = {c: n for c, n in trie[s[i - d : i]].items() if c not in gone}
            if not node:
                continue
            weight = sum(node.values()) + len(node)
            if s[i] in node:
                total += math.log10(node[s[i]] / weight)
                break
            total += math.log10(len(node) / weight)
            gone |= set(node)
        else:
            total -= math.log10(max(256 - len(gone), 1))
    return total


def test_scores_equal_a_plain_trie(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["", "A b", None]) if i % 9 == 0 else " ".join(rng.choice(["ab", "abc", "Éa", "b", "ca", "zz" + str(i)]) for _ in range(rng.randint(1, 12))), i % 4 != 0) for i in range(60)]
    rows += [(7, "abc  ab", True)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, trained boolean")
    got = sorted(ppm.score_documents(df, df.trained).collect(), key=lambda r: (r.doc_id, r.score))
    train = [t for _, t, x in rows if x]
    counts = Counter(w for t in train for w in words(t))
    n, v, ends = sum(counts.values()) + len(train), len(counts) + 1, len(train)
    want = []
    for d, t, x in rows:
        ws = words(t)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws) + math.log10((ends + 1) / (n + v + 1))
        want.append((d, not x, len(ws) + 1, sum(counts[w] > 0 for w in ws) + 1, n, base, brute_ppm(train, t, ppm.ORDER)))
    want.sort(key=lambda r: (r[0], r[6]))
    for g, w in zip(got, want, strict=True):
        assert tuple(g)[:5] == w[:5]
        assert g.base_score == pytest.approx(w[5], rel=1e-9)
        assert g.score == pytest.approx(w[6], rel=1e-5)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    texts = [bytes(rng.choice(list(b"abc "), 80).tolist()) for _ in range(5)]
    g, _ = ppm.grams(texts, 3)
    ctx = np.unique(g >> np.uint64(8))[:20]
    pairs = np.zeros(1 << 16, np.int64)
    np.add.at(pairs, (g & np.uint64(0xFFFF)).astype(np.int64), 1)
    keys = np.unique(np.concatenate([g, (ctx[:, None] << np.uint64(8) | np.arange(256, dtype=np.uint64)).ravel()]))
    u, c = np.unique(g, return_counts=True)
    n = np.zeros(len(keys), np.int64)
    n[np.searchsorted(keys, u)] = c
    p = 10 ** ppm.code_lengths(keys, n, pairs, 3)
    for x in ctx:
        assert p[keys >> np.uint64(8) == x].sum() == pytest.approx(1)


def test_empty_table_and_no_training(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ppm.score_documents(empty, empty.doc_id > 0).count() == 0
    one = spark.createDataFrame([(None, "ab")], "doc_id long, text string")
    r = ppm.score_documents(one, one.doc_id.isNotNull()).collect()[0]
    assert (r.n_tokens, r.n_known, r.train_tokens) == (2, 0, 0) and r.score == pytest.approx(-3 * math.log10(256))
