"""The manifest against a plain version: several levels, lone leaves, nulls, repeated rows, clashing names."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import merkle


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row) -> str:
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def proof_and_root(leaves: list[str], at: int, fanout: int):
    """Siblings of a leaf from its run to the top, the top, and the places in between."""
    path, nodes = [], leaves
    while len(nodes) > 1:
        run = nodes[at // fanout * fanout :][:fanout]
        path.append((run[: at % fanout], run[at % fanout + 1 :]))
        nodes = [h("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
        at //= fanout
    return path, nodes[0]


def plain(rows, fanout=16):
    """Per row (doc_id, source, lang, n_chars, text): doc_id, leaf, subroot, root, proof, folded root, verified."""
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        groups[s].sort(key=lambda x: x[:3])
    tops = [proof_and_root([x[2] for x in groups[s]], 0, fanout)[1] for s in order]
    for g, s in enumerate(order):
        over, root = proof_and_root(tops, g, fanout)
        leaves = [x[2] for x in groups[s]]
        for at, (_, _, leaf, r) in enumerate(groups[s]):
            path = proof_and_root(leaves, at, fanout)[0] + over
            tampered = zlib.crc32(str(r[0]).encode() if r[0] is not None else b"") % 5 == 0
            low = r[4] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
            folded = leaf_of((*r[:4], low)) if tampered else leaf
            for left, right in path:
                folded = h("".join([*left, folded, *right]))
            proof = h("".join("".join(left) + "".join(right) for left, right in path))
            yield r[0], leaf, tops[g], root, proof, folded, folded == root


def made(n=700):
    rng = random.Random(2)
    rows = [(i, rng.choice(["web", "web", "web", "é", "b", None]), rng.choice(["en", None]), rng.choice([None, i]), rng.choice(["Text ÉA", "", None, "same"]) and f"Text ÉA {i}") for i in range(n)]
    rows += [(n, "alone", "en", 3, "abc"), (n + 1, "", "en", 0, ""), (None, "web", None, None, None), (5, "web", "en", 5, "Other"), (5, "web", "en", 5, "Other"), (n + 2, "b", "en", 9, "Aé" * 300_000)]
    return rows


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.fixture(scope="module")
def store(tmp_path_factory):
    return tmp_path_factory.mktemp("merkle")


def test_query_equals_plain_version(spark, store):
    rows = made()
    spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", leaf string, _at int").write.parquet(str(store / "documents.parquet"))
    got = merkle.op12_merkle(spark, str(store))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    key = lambda r: tuple(str(v) for v in r)
    want = sorted(plain(rows), key=key)
    assert sorted(map(tuple, got.collect()), key=key) == want
    assert {v for *_, v in want} == {True, False}


def test_small_fanout_deep_trees_and_claims(spark):
    """A fanout of 2 gives levels above the blocks of 4 leaves, within and over the groups."""
    rows = [(i, f"s{i % 3}" if i < 60 else f"t{i}", "en", 1, f"t {i}") for i in range(75)]
    df = spark.createDataFrame(rows, SCHEMA)
    m = merkle.build(df, carry={"doc_id": F.col("doc_id")}, fanout=2)
    want = {r[0]: r for r in plain(rows, 2)}
    got = merkle.prove(m, carry=("doc_id",)).collect()
    assert len(got) == 75 and all(r.verified and r.folded_root == r.root for r in got)
    assert all((r.leaf, r.subroot, r.root, h(r.proof)) == want[r.doc_id][1:5] for r in got)


def test_lone_and_empty(spark, store):
    one = spark.createDataFrame([(1, None, None, None, "A")], SCHEMA)
    r = merkle.prove(merkle.build(one)).collect()[0]
    assert r.leaf == r.subroot == r.root == r.folded_root and r.proof == "" and r.verified
    assert merkle.prove(merkle.build(one.limit(0))).count() == 0


def test_sql_equals_query_on_documents(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    got = merkle.op12_merkle(spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"select {', '.join(got.columns)} from ({merkle.OP12_SQL})").fetchall())
