"""Steps whose work a task must share or must not repeat as tables grow."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacewing.operators import layout, multiply, selection
from lacewing.plans.matrix import DenseMatrix, SparseMatrix
from lacewing.sources import generate, logs


def plan(df, kind="executedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


@pytest.fixture(scope="module")
def sides(spark):
    return generate.uniform(spark, 90, 70, 0.1), generate.dense(spark, 70, 20)


def test_few_shards_are_not_few_tasks(spark, sides):
    c = multiply.sharded(*sides, 2)
    assert c.select(F.spark_partition_id()).distinct().count() > 2


@pytest.mark.parametrize("name", ["baseline", "memopt", "multigpu"])
def test_sums_of_a_broadcast_product_are_not_shuffled(sides, name):
    """A part of the plan above the join deals nothing by row and column of the result."""
    text = plan(multiply.STRATEGIES[name](*sides))
    assert "Exchange" not in text[: text.index("BroadcastHashJoin")]


def test_sums_with_heavy_columns_are_not_shuffled(sides):
    """Dense rows go to the parts of rows, so nothing is dealt anew after the join."""
    text = plan(multiply.skewed(*sides, limit=8 * 20))
    assert "Exchange" not in text[: text.index("SortMergeJoin")]


@pytest.mark.parametrize("name", ["memopt", "unified", "skewed", "grid", "balanced", "multigpu"])
def test_no_element_is_a_row_before_the_sums(spark, sides, name):
    text = plan(multiply.STRATEGIES[name](*sides))
    assert text.index("posexplode") < text.index("HashAggregate") and text.count("posexplode") == 1


def test_batched_sums_come_before_elements(spark, sides):
    a, b = sides
    text = plan(multiply.batched(a.entries.withColumn("g", F.col("row") % 3), b, ["g"]))
    assert text.index("posexplode") < text.index("HashAggregate") and text.count("posexplode") == 1


def test_long_beyond_the_broadcast_joins_rows(sides, monkeypatch):
    a, b = sides
    want = sorted(map(tuple, multiply.long(a, b).collect()))
    monkeypatch.setattr(multiply, "BROADCAST_BYTES", 8)
    text = plan(multiply.long(a, b))
    assert text.index("posexplode") < text.index("HashAggregate") and text.count("posexplode") == 1
    assert sorted(map(tuple, multiply.long(a, b).collect())) == want


def test_long_broadcasts_dense_rows_whole(sides):
    """A row for each element takes several times the size that the limit counts."""
    text = plan(multiply.long(*sides))
    assert text.count("posexplode") == 1 and text.index("posexplode") < text.index("BroadcastHashJoin")


def test_rows_of_unequal_length_make_the_cells_they_reach(spark):
    a = SparseMatrix.from_entries(spark.createDataFrame([(0, 0, 2), (1, 1, 3), (2, 2, 5), (3, 7, 1)], "row long, col long, val long"), 4, 8)
    b = DenseMatrix(spark.createDataFrame([(0, [1, 2, 3]), (1, [4]), (2, [])], "k long, b array<bigint>"), 8, 3)
    want = [(0, 0, 2), (0, 1, 4), (0, 2, 6), (1, 0, 12)]
    for f in (multiply.long, multiply.packed, multiply.block, multiply.shuffled, lambda x, y: multiply.wide(x, y, 2), lambda x, y: multiply.sharded(x, y, 2)):
        assert sorted(map(tuple, f(a, b).select("row", "j", "c").collect())) == want


@pytest.mark.parametrize("size", [1, 1 << 12, 32 << 20])
def test_tiles_of_any_size_give_the_product(sides, monkeypatch, size):
    """Also with several tiles to a task."""
    monkeypatch.setattr(multiply, "TILE_BYTES", size)
    monkeypatch.setattr(multiply, "MOST_TASKS", 3)
    a, b = sides
    want = sorted(map(tuple, multiply.packed(a, b).collect()))
    assert sorted(map(tuple, multiply.block(a, b).collect())) == want


def test_dense_rows_do_not_travel_with_blocks(sides):
    """A dense row goes once to each band of rows, and a task gives sums of rows."""
    a, b = sides
    text = plan(multiply.block(a, b))
    assert "Join" not in text and text.index("posexplode") < text.index("HashAggregate") < text.index("MapInArrow")


@pytest.mark.parametrize("half", [False, True])
def test_blocks_have_their_zeros(spark, half):
    cells = {(0, 0): 7, (0, 15): 1, (15, 15): 2, (3, 4): -5, (16, 16): 3, (40, 1): 0, (41, 2): 9}
    a = SparseMatrix.from_entries(spark.createDataFrame([(*at, v) for at, v in cells.items()], "row long, col long, val long"), 48, 32)
    df = layout.bsr_blocks(a, half)
    got = {(r["br"], r["bc"]): r["block"] for r in df.collect()}
    whole = np.zeros((48, 32))
    for at, v in cells.items():
        whole[at] = v
    assert sorted(got) == [(0, 0), (1, 1), (2, 0)]
    for (i, j), block in got.items():
        assert block == whole[16 * i : 16 * i + 16, 16 * j : 16 * j + 16].ravel().tolist()
    assert "map_from_entries" not in plan(df, "optimizedPlan")


def test_a_line_is_split_once_whatever_the_conditions(spark):
    lines = spark.range(3).select(F.concat(F.lit("\n\t kernel=k m=1 k=2 n=3 nnz="), F.col("id").cast("string"), F.lit(" m=5  time_ms=1.5 gflops=2 \x0b")).alias("value"))
    df = logs.parse_lines(lines)
    assert plan(df, "optimizedPlan").count("split(") == 1
    assert sorted(map(tuple, df.collect())) == [("k", 5, 2, 3, i, None, 1.5, 2.0) for i in range(3)]


def test_two_medians_take_the_passes_of_one(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 1000 / 8).alias("v"))
    both = selection.several_medians(rows, ["g"], "v", {"upper": True, "middle": False}, limit=0)
    text = plan(both, "optimizedPlan")
    assert text.count("Range (0, 1000") == 5  # four digits and the rest
    assert "LOG2" not in text.upper() and "POWER" not in text.upper()
    got = {r["g"]: (r["upper"], r["middle"]) for r in both.collect()}
    for g in range(3):
        v = sorted(i * 7 % 1000 / 8 for i in range(g, 1000, 3))
        assert got[g] == (v[len(v) // 2], (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2)
