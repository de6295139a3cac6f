import numpy as np
from pyspark.sql import functions as F

from tallyspark.llm import ann


def test_recall_and_edge_cases(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 16))
    x = (centres[rng.integers(0, 6, 700)] + rng.normal(size=(700, 16)) * 0.7).astype(np.float32)
    rows = [(i, [float(v) for v in r], "x") for i, r in enumerate(x)]
    rows += [(700 + i, rows[7][1], "x") for i in range(30)]  # copies
    rows += [(800, None, "x"), (801, [0.0] * 16, "x"), (802, [float("nan")] * 16, "x"), (803, [1.0, None] + [0.0] * 14, "x"), (None, rows[1][1], "x"), rows[3]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").repartition(4)
    got = {}
    for r in ann.neighbours(df, F.expr("id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    good = {i: np.array(v, np.float64) for i, v, _ in rows[:730]}
    ids = np.array(sorted(good))
    m = np.array([good[i] for i in ids])
    m /= np.sqrt((m * m).sum(1))[:, None]
    hits = 0
    for q in range(0, 730, 50):
        s = m @ m[q]
        s[q] = -9
        want = ids[np.lexsort((ids, -np.round(s, 9)))[:5]].tolist()
        assert len(got[q]) == 5
        hits += len({v for v, _ in got[q]} & set(want))
        assert all(abs(score - s[v]) < 1e-9 for v, score in got[q])
    assert set(got) == set(range(0, 730, 50)) and hits / (5 * len(got)) >= 0.9
    assert [v for v, _ in got[700]] == [7, 701, 702, 703, 704]


def test_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id) for r in ann.neighbours(few, F.expr("id % 50 = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2)]
    assert ann.neighbours(few.limit(0), F.expr("id % 50 = 0")).count() == 0


def test_lengths_that_differ(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=d)]) for i, d in enumerate([8] * 120 + [3] * 60 + [5])]
    rows = [rows[int(i)] for i in rng.permutation(len(rows))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.neighbours(df, F.expr("id % 20 = 0")).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    by_id = dict(rows)
    for q in range(0, 181, 20):
        x = np.array(by_id[q])
        cos = {i: float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)) for i, v in by_id.items() if i != q and len(v) == len(x) for y in [np.array(v)]}
        assert got.get(q, []) == sorted(cos, key=lambda i: (-cos[i], i))[:5]


def test_an_id_with_two_vectors(spark):
    rows = [(0, [1.0, 0.0]), (5, [1.0, 0.1]), (5, [0.0, 1.0]), (7, [0.9, 0.1]), (8, [0.1, 0.9])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, round(r.score, 3)) for r in ann.neighbours(df, F.expr("id = 0")).orderBy("rank").collect()]
    assert got == [(5, 0.995), (7, 0.994), (8, 0.11), (5, 0.0)]
