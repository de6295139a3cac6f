import numpy as np
from pyspark.sql import functions as F

from tallyspark.llm import ann


def test_near_copies_are_told_apart(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(800, 64)).astype(np.float32)
    x[:400] = x[0] + 1e-3 * rng.normal(size=(400, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got: dict = {}
    for r in ann.neighbours(df, F.expr("id % 50 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    m = x.astype(np.float64)
    m /= np.sqrt((m * m).sum(1))[:, None]
    hits = 0
    for q in range(0, 400, 50):
        s = m @ m[q]
        s[q] = -9
        hits += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    assert hits >= 0.9 * 40


def test_effort_grows_with_the_table():
    assert [ann.degree_of(n) for n in (1, 2000, 10_000, 50_000)] == [20, 20, 30, 40]
    assert [ann.beam_of(n) for n in (1, 500, 10_000, 50_000)] == [100, 100, 316, 432]


def test_every_block_is_searched(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2000, 32)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got: dict = {}
    for r in ann.neighbours(df, F.expr("id % 50 = 0"), block=450).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    m = x.astype(np.float64)
    m /= np.sqrt((m * m).sum(1))[:, None]
    hits = 0
    for q in range(0, 2000, 50):
        s = m @ m[q]
        s[q] = -9
        hits += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    assert hits >= 0.95 * 200


def test_rounds_of_descent_and_search_are_no_jobs(spark):
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=32)]) for i in range(1500)], "vec_id long, embedding array<float>")
    spark.sparkContext.setJobGroup("ann-jobs", "")
    try:
        assert ann.neighbours(df, F.expr("id % 50 = 0")).count() == 150
    finally:
        spark.sparkContext.setJobGroup("other", "")
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("ann-jobs"))
    assert 0 < jobs < 50, jobs
