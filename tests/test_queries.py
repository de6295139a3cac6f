import duckdb
import pytest

from tallyspark.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, tmp_path, name):
    df = QUERIES[name](spark, SF)
    df.write.parquet(str(tmp_path / "out"))
    if name not in ORACLES:
        assert spark.read.parquet(str(tmp_path / "out")).count() > 0
        return
    cols = ", ".join(f'"{c}"' for c in sorted(df.columns))
    db.sql(f"create or replace temp table a as select {cols} from ({ORACLES[name]})")
    db.sql(f"create or replace temp table b as select {cols} from read_parquet('{tmp_path}/out/*.parquet')")
    assert db.sql("select * from a except all select * from b").fetchall() == []
    assert db.sql("select * from b except all select * from a").fetchall() == []
