"""Whitening against plain numpy, with repeated, broken and odd vectors."""

import numpy as np
import pytest

from tallyspark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n string, component int"


def plain(rows, most=16):
    """{(id, deviation, component): (n, whitened, explained)} of vectors of one length."""
    good = [(i, np.array(v, float)) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    xs = {i: [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for i, v in good}
    fit = np.array(sorted({tuple(x) for x in xs.values()}), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    away = (fit - s / n).astype(float)
    e, v = np.linalg.eigh(away.T @ away / n)
    e, v = e[::-1], v[:, ::-1]
    out = {}
    for i, x in xs.items():
        dev = int(((n * np.array(x, object) - s) ** 2).sum())
        for c in range(min(most, len(s))):
            out[i, c + 1] = (n, dev, float(((np.array(x, object) - s / n).astype(float)) @ v[:, c] / np.sqrt(e[c])), e[c] / e.sum())
    return out


def check(got, want):
    assert {(r.vec_id, r.component) for r in got} == set(want)
    sign = {}
    for r in got:
        n, dev, w, share = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, dev) and r.explained == pytest.approx(share, rel=1e-9)
        if abs(w) > 1e-3:
            sign.setdefault(r.component, np.sign(w) * np.sign(r.whitened))
        assert r.whitened == pytest.approx(w * sign.get(r.component, 1), abs=1e-7)
        assert r.identity_error < 1e-9


def test_query_equals_plain_version(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in rng.normal(0, 1, 20) * np.arange(1, 21)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)]  # a group of copies counts once
    rows += [(2000, None), (2001, [None] + [1.0] * 19), (2002, [float("nan")] * 20), (2003, [float("inf")] + [0.0] * 19), (2004, [])]
    spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(7).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = whitening.op13_whitening(spark, str(tmp_path))
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    check(got.collect(), plain(rows))


def test_repeated_and_null_ids_empty_and_constant(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0]), (3, [0.5, 2.0]), (3, [0.5, 2.0]), (4, [0.0, 2.0])], "vec_id long, embedding array<float>")
    got = whitening.whiten(df, whitening.fit(df)).collect()
    assert len(got) == 8 and {r.n for r in got} == {3}
    assert all((r.whitened is None) == (r.component == 2) for r in got)  # the second entry is constant
    one = df.limit(1)
    assert [(r.whitened, r.deviation, r.explained) for r in whitening.whiten(one, whitening.fit(one)).collect()] == [(None, "0", 0.0)] * 2
    assert whitening.whiten(df.limit(0), whitening.fit(df.limit(0))).count() == 0


def test_lengths_are_fitted_apart_and_large_numbers_are_exact(spark):
    rng = np.random.default_rng(1)
    two = [(i, rng.normal(size=2).tolist()) for i in range(50)]
    three = [(100 + i, (rng.normal(size=3) * 1e14).tolist()) for i in range(50)]
    df = spark.createDataFrame(two + three, "vec_id long, embedding array<double>")
    model = whitening.fit(df)
    assert set(model.axes) == {2, 3} and all(a.n == 50 for a in model.axes.values()) and model.identity_error < 1e-9
    got = {r.vec_id: r.deviation for r in whitening.whiten(df, model).collect()}
    xs = {i: [int(np.floor(64 * c)) + 1_000_000 for c in v] for i, v in three}
    s = [sum(x[k] for x in xs.values()) for k in range(3)]
    assert all(int(got[i]) == sum((50 * x[k] - s[k]) ** 2 for k in range(3)) for i, x in xs.items())


def test_chan_merge_equals_whole():
    x = np.random.default_rng(0).normal(5, 2, (100, 4))
    whole = whitening.Moments.of(x)
    part = whitening.Moments.of(x[:3]).merge(whitening.Moments.of(x[3:60])).merge(whitening.Moments.of(x[60:]))
    assert part.n == 100 and np.allclose(part.mean, whole.mean) and np.allclose(part.scatter, whole.scatter)
