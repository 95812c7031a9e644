"""Every registered query with SQL gives the rows that DuckDB gives."""

import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lacewing.operators import multiply
from lacewing.plans.stored import free_all, held
from lacewing.queries import ORACLE, QUERIES, dense, heavy_matrix


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.fixture(autouse=True)
def freed():
    """What a query holds is freed after it."""
    mark = held()
    yield
    free_all(mark)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, sf_dir, db, name):
    df = QUERIES[name](spark, sf_dir)
    want = db.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    want = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*order).collect()), key=repr)
    assert len(got) == len(want)
    assert got == want


def test_batches_add_up_to_the_whole_product(spark, sf_dir):
    """Over all columns of the dense side."""
    batches = QUERIES["spmm_batched"](spark, sf_dir).groupBy("row", "j").agg(F.sum("c").alias("c"))
    whole = QUERIES["spmm_packed"](spark, sf_dir)
    assert whole.exceptAll(batches).count() == 0 and batches.count() == whole.count()


def test_heavy_columns_are_multiplied_by_the_whole_dense_side(spark, sf_dir):
    got = QUERIES["spmm_heavy_columns"](spark, sf_dir)
    want = multiply.shuffled(heavy_matrix(spark, sf_dir), dense(spark, sf_dir)).select("row", "j", "c")
    assert want.exceptAll(got).count() == 0 and got.count() == want.count()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
