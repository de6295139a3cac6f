import random
from fractions import Fraction

import numpy as np

from tallyspark.llm import ngram_join as nj


def shingles(text, k):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k, num, den):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows))


def made(seed, n=160):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.choice([2, 5, 12, 40, 150]))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base)) if rng.random() < 0.8 else [rng.choice(words) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            if w:
                w[rng.randrange(len(w))] = rng.choice(words + ["É x", "Z"])
        rows.append((1000 - i, rng.choice([" ", "\n"]).join(w)))
    return rows


def test_components_equal_brute_force(spark, monkeypatch):
    for seed, k, t in ((1, 3, Fraction(9, 10)), (2, 2, Fraction(4, 5))):
        monkeypatch.setattr(nj.blocks_of, "__defaults__", (4,))
        rows = made(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        got = sorted(tuple(r) for r in nj.component_ids(df, k, t).collect())
        assert got == brute(rows, k, t.numerator, t.denominator)
        assert len({r[2] for r in got}) < len(got)


def test_small_bounds_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(nj._shared_task, "__defaults__", (60,))
    monkeypatch.setattr(nj._late_task, "__defaults__", (9,))
    monkeypatch.setattr(nj, "SLOT_TOKENS", 100)
    monkeypatch.setattr(nj, "QUERIES", 3)
    rows = made(5, 120)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(tuple(r) for r in nj.component_ids(df, 2, Fraction(4, 5)).collect()) == brute(rows, 2, 4, 5)


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(4)
    a, b = (np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2)) for n in (300, 130))
    b = np.unique(np.concatenate([b, a[:100]]))
    wide, narrow = nj.bitmap(a), nj.bitmap(b)
    assert len(wide) > len(narrow) and (nj.folded(wide, len(narrow)) == nj.folded(np.array([wide, wide]), len(narrow))[1]).all()
    least = np.bitwise_count(nj.folded(wide, len(narrow)) & ~narrow).sum()
    assert 0 < least <= len(np.setdiff1d(a, b))


def test_parts_meet():
    parts, rng = nj.Parts(Fraction(9, 10)), np.random.default_rng(1)
    for n in (10, 19, 57, 300, 1111):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        most = int(len(a) // 19)  # J stays at 0.9 or more
        b = np.unique(np.concatenate([a[most:], rng.integers(0, 2**63, most).astype(np.uint64)]))
        if 10 * len(np.intersect1d(a, b)) >= 9 * len(np.union1d(a, b)) and len(a) > 9:
            assert len(np.intersect1d(*(np.concatenate([p for _, p in parts.signatures(x)]) for x in (a, b))))


def test_nulls_copies_and_extra_columns(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, None, "x"), (2, "", "x"), (3, text, None), (3, text, None), (None, text, "y"), (5, text + " end", "y"), (6, "two words", "y"), (7, "Two  Words", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in nj.component_ids(df, 3, Fraction(9, 10)).collect()}
    assert got == {(1, 0, 1), (2, 0, 2), (3, 48, 3), (None, 48, 3), (5, 49, 3), (6, 1, 6), (7, 1, 6)}
    kept = nj.keep_one(df, 3, Fraction(9, 10))
    assert kept.columns == df.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) in ([-1, 1, 2, 6], [1, 2, 3, 6])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert nj.component_ids(empty, 3, Fraction(9, 10)).count() == 0 and nj.keep_one(empty).count() == 0
