"""Queries with SQL give the rows that DuckDB gives, on the small tables and on messy ones."""

import duckdb
import pytest

from lacewing.llm.queries import ORACLE_SQL, QUERIES


def same(spark, folder, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet{'' if '/testdata/' in folder else '/*.parquet'}')")
    df = QUERIES[name](spark, folder)
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    assert got == sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_small_tables(spark, sf_dir, name):
    same(spark, sf_dir, name)


@pytest.fixture(scope="module")
def messy_dir(spark, messy, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("messy"))
    messy.write.parquet(f"{folder}/documents.parquet")
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 2.0, 3.0, 4.0], [1.0, 2.0, 3.0, 4.1], [4.0, 3.0, 2.0, 1.0], [1.0, 2.0, 3.0, 4.0], None, [], [0.0] * 4, [nan, 1.0, 1.0, 1.0], [inf, 1.0, 1.0, 1.0], [1.0, None, 1.0, 1.0], [1.0, 2.0], [2.0, 4.0]]
    spark.createDataFrame([(i * 5 % 12, v, 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").write.parquet(
        f"{folder}/embeddings.parquet"
    )
    return folder


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_messy_tables(spark, messy_dir, name):
    same(spark, messy_dir, name)
