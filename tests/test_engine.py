"""Edge cases of the engine on hand-made matrices."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacewing.cli import main
from lacewing.functions.scalars import ceil_div, to_half, upper_median
from lacewing.operators import analytics, evaluate, layout, multiply
from lacewing.plans import planner
from lacewing.plans.matrix import DenseMatrix, SparseMatrix
from lacewing.sources import csr_binary, generate, logs


def sparse(spark, entries, m, k):
    return SparseMatrix.from_entries(spark.createDataFrame(entries, "row long, col long, val long"), m, k)


def dense(spark, rows):
    return DenseMatrix(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "k long, b array<bigint>"), len(rows), len(rows[0]))


def grid(df, m, n):
    out = np.zeros((m, n), np.int64)
    for r in df.collect():
        out[r["row"], r["j"]] = r["c"]
    return out


@pytest.mark.parametrize("strategy", [s for s in multiply.STRATEGIES if s != "tiled_v2"])
def test_empty_rows_and_duplicates(spark, strategy):
    a = sparse(spark, [(0, 1, 2), (2, 0, 3), (2, 0, 4)], 4, 2)
    c = multiply.matmul(a, dense(spark, [[1, 2], [3, 4]]), strategy)
    assert c.count() == 8
    assert grid(c, 4, 2).tolist() == [[6, 8], [0, 0], [7, 14], [0, 0]]


def test_strategies_agree_with_numpy(spark):
    a, b = generate.uniform(spark, 70, 50, 0.08), generate.dense(spark, 50, 32)
    left, right = np.zeros((70, 50), np.int64), np.array([r["b"] for r in b.rows.orderBy("k").collect()])
    for r in a.entries.collect():
        left[r["row"], r["col"]] = r["val"]
    for f in (multiply.long, multiply.packed, multiply.block, multiply.shuffled, lambda x, y: multiply.wide(x, y, 7), lambda x, y: multiply.sharded(x, y, 3)):
        assert (grid(f(a, b), 70, 32) == left @ right).all()


def test_missing_dense_rows_are_zero_and_tiles_are_checked(spark):
    b = dense(spark, [[1] * 16] * 17)
    c = multiply.block(sparse(spark, [(0, 16, 1)], 2, 17), b)
    assert grid(c, 2, 16).tolist() == [[1] * 16, [0] * 16]
    with pytest.raises(ValueError):
        multiply.aligned_wide(sparse(spark, [(0, 0, 1)], 1, 17), b)
    with pytest.raises(ValueError):
        multiply.matmul(sparse(spark, [(0, 0, 1)], 1, 17), b, "nothing")


def test_planner(spark):
    empty = planner.choose(sparse(spark, [], 16, 16), 16)
    assert empty.backend is planner.Backend.BLOCK and empty.fill_in_ratio == 0
    full = [(i, j, 1) for i in range(16) for j in range(8)]
    at_limit = planner.choose(sparse(spark, full, 16, 16), 16)
    assert at_limit.backend is planner.Backend.BLOCK and at_limit.fill_in_ratio == 2.0
    assert planner.choose(sparse(spark, full[1:], 16, 16), 16).backend is planner.Backend.CSR
    odd = planner.choose(sparse(spark, full, 16, 16), 17)
    assert odd.backend is planner.Backend.CSR and odd.reason == planner.REASONS["unaligned"]


def test_half_precision(spark):
    x = [0.0, 1 + 2**-11, 65519.0, 65520.0, -65520.0, 2.0**-25, 3 * 2.0**-25, -1.5, 0.1, 6e-8, 1e-300]
    rng = np.random.default_rng(0)
    x += (rng.normal(size=500) * 10.0 ** rng.integers(-9, 5, 500)).tolist()
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double").orderBy("i").select(to_half(F.col("x"))).collect()]
    with np.errstate(over="ignore"):
        assert got == np.array(x, np.float32).astype(np.float64).astype(np.float16).astype(float).tolist() or got == np.array(x).astype(np.float16).astype(float).tolist()


def test_slices_shards_and_pointers(spark):
    a = sparse(spark, [(0, 0, 1), (0, 1, 1), (3, 0, 1), (3, 1, 1), (3, 2, 1), (5, 0, 1)], 7, 3)
    ptr = [(r["n"], r["ptr"]) for r in layout.row_ptr(a, 2).orderBy("row").collect()]
    assert ptr == [(2, 0), (0, 2), (0, 2), (3, 2), (0, 5), (1, 5), (0, 6)]
    assert [r["shard"] for r in layout.nnz_shards(a, 3).orderBy("row").collect()] == [0, 1, 1, 1, 2, 2, 2]
    zero = layout.nnz_shards(sparse(spark, [], 4, 4), 3)
    assert {r["shard"] for r in zero.collect()} == {2}
    assert [tuple(r) for r in a.slice_rows(3, 5).entries.orderBy("col").collect()] == [(0, 0, 1), (0, 1, 1), (0, 2, 1)]
    for begin, end in ((3, 2), (0, 8), (-1, 2)):
        with pytest.raises(ValueError):
            a.slice_rows(begin, end)


def test_errors_and_verdicts(spark):
    frame = lambda v: spark.createDataFrame([(0, j, float(x)) for j, x in enumerate(v)], "row long, j int, c double")
    at_floor = evaluate.error_stats(frame([1000, 2]), frame([1000, 1])).first()
    assert (at_floor["max_abs"], at_floor["max_rel"]) == (1.0, 0.0)
    assert evaluate.error_stats(frame([1, 2]), frame([0, 0])).first()["rel_l2"] == 0
    v = spark.createDataFrame([(0.001,), (0.01,), (math.nan,)], "x double").select(evaluate.verdict(F.col("x")))
    assert [r[0] for r in v.collect()] == ["[PASS]", "[FAIL]", "[FAIL]"]
    m = spark.createDataFrame([(float(i),) for i in (4, 2, 1, 3)], "x double")
    assert m.agg(upper_median("x")).first()[0] == 3 and m.limit(0).agg(upper_median("x")).first()[0] == 0
    assert [r[0] for r in spark.range(5).select(ceil_div("id", "2")).collect()] == [0, 1, 1, 2, 2]


def test_generators(spark):
    assert generate.banded(spark, 4, 40, 0).entries.count() == 4
    assert generate.banded(spark, 40, 4, 1).entries.where("row > 4").count() == 0
    with pytest.raises(ValueError):
        generate.block_diagonal(spark, 8, 8, 16)
    with pytest.raises(ValueError):
        generate.uniform(spark, 2, 2, 1.5)
    d = 0.01
    a = generate.uniform(spark, 512, 512, d)
    fill = planner.block_stats(a).first()["fill_in_ratio"]
    assert fill == pytest.approx((1 - (1 - d) ** 256) / d, rel=0.1)
    p = generate.power_law(spark, 200, 60, 8).entries
    assert p.count() == p.select("row", "col").distinct().count()
    assert p.groupBy("row").count().agg(F.max("count")).first()[0] <= 60


def test_binary_round_trip_and_short_file(spark, tmp_path):
    a = SparseMatrix(generate.banded(spark, 30, 20, 3).entries.withColumn("val", F.col("val") / 4.0), 33, 20)
    path = f"file://{tmp_path}/a.bin"
    csr_binary.write(a, path)
    back = csr_binary.read(spark, path, 7)
    assert (back.n_rows, back.n_cols) == (33, 20)
    key = lambda df: sorted(tuple(r) for r in df.select("row", "col", F.col("val").cast("double")).collect())
    assert key(back.entries) == key(a.entries)
    raw = (tmp_path / "a.bin").read_bytes()
    (tmp_path / "b.bin").write_bytes(raw[:-4])
    with pytest.raises(Exception, match="short read"):
        csr_binary.read(spark, f"file://{tmp_path}/b.bin").entries.count()


def test_logs(spark, tmp_path):
    text = spark.createDataFrame([("intro\n====== A1 ======\nDRAM 5\nx\n====== B2 ======\nnothing",)], "value string")
    assert [tuple(r) for r in logs.sections(text, "DRAM").collect()] == [("A1", "DRAM 5\nx\n")]
    rows = spark.createDataFrame([("k1", 1024, 1024, 256, 10, 0.5, 1.25)], logs.SWEEP)
    line = rows.select(logs.result_line().alias("value"))
    assert logs.parse_lines(line).select("kernel", "m", "nnz").first()[:] == ("k1", 1024, 10)
    logs.write_csv(rows, f"{tmp_path}/t")
    assert logs.read_table(spark, f"{tmp_path}/t").count() == 1
    assert logs.with_pattern(rows).first()["pattern"] == "uniform"
    (tmp_path / "n.ipynb").write_text(
        '{"cells": [{"cell_type": "code", "source": ["a", "b"], "outputs": [{"text": ["c", "d"]}, {"text": "e"}, {"data": {"text/plain": ["f"]}}, {"data": {"image/png": "x"}}]},'
        ' {"cell_type": "markdown", "source": ["no"]}, {"cell_type": "code", "source": "d"}]}'
    )
    assert [tuple(r) for r in logs.read_notebook(spark, f"{tmp_path}/n.ipynb").collect()] == [(0, "ab", "cdef"), (2, "d", "")]
    (tmp_path / "p.csv").write_text("m,kernel,nnz,sm_pct,l1tex_pct,dram_pct\n1,k,2,3,4,5\n1,k,2,9,9,9\n,k,2,3,4,5\n1,,2,3,4,5\n1,j,x,3,4,5\n")
    assert [tuple(r) for r in logs.read_profiles(spark, f"{tmp_path}/p.csv").collect()] == [("k", 1, 2, 5.0, 4.0, 3.0)]
    (tmp_path / "odd.csv").write_text("kernel=a m=1 k=1 n=1 nnz=1 time_ms=1 gflops=2\n")
    assert [r["gflops"] for r in logs.read_rows(spark, f"{tmp_path}/odd.csv").collect()] == [2.0]
    assert analytics.size_label("m") is not None


def test_devices(spark):
    there = multiply.device_count(spark)
    assert [multiply.clamp_devices(spark, n) for n in (-1, 0, 1, there, there + 5)] == [1, 1, 1, there, there]


def test_speedups_keep_variants_of_a_label(spark):
    rows = [("p", 1, 1, "baseline", 10.0, 0), ("p", 1, 1, "hybrid[csr]", 20.0, 1), ("p", 1, 1, "hybrid[wmma]", 50.0, 2), ("p", 2, 1, "baseline", 0.0, 3), ("p", 2, 1, "k", 1.0, 4)]
    df = spark.createDataFrame(rows, "pattern string, m int, nnz long, kernel string, gflops double, seq int")
    got = {(r["m"], r["kernel"]): r["speedup"] for r in analytics.speedups(df).collect()}
    assert got == {(1, "baseline"): 1.0, (1, "hybrid"): 3.5}
    assert [r["kernel"] for r in analytics.speedups(df, kernels=["hybrid"]).collect()] == ["hybrid"]


def test_power_law_keeps_mean_and_range(spark):
    p = generate.power_law(spark, 3000, 500, 16, 2.5).entries
    d = [r["count"] for r in p.groupBy("row").count().collect()]
    assert len(d) == 3000 and abs(np.mean(d) - 16) < 1 and min(d) >= 1 and max(d) <= 500
    assert p.count() == p.distinct().count()
    full = generate.power_law(spark, 20, 8, 30, 1.2).entries
    assert full.groupBy("row").count().agg(F.max("count")).first()[0] == 8


def test_command_line(spark, capsys):
    assert main(["run", "--m", "64", "--k", "64", "--n", "16", "--pattern", "blockdiag", "--param", "16", "--multi-gpu", "--gpus", "3"], spark) == 0
    out = capsys.readouterr().out
    assert "multigpu_split gpus=3 gpu0:rows=" in out and "bsr_stats blocks=4 " in out and "mode=multigpu" in out and "density=0.25" in out
    assert main(["run", "--m", "32", "--k", "32", "--n", "16", "--pattern", "banded", "--param", "2", "--unified", "--no-verify"], spark) == 0
    assert "mode=unified" in capsys.readouterr().out
    assert main(["run", "--m", "64", "--k", "64", "--n", "16", "--pattern", "blockdiag", "--param", "16"], spark) == 0
    assert "[PASS]" in capsys.readouterr().out
    assert main(["bench", "--m", "32", "--k", "32", "--n", "16", "--pattern", "uniform", "--param", "0.1", "--kernel", "baseline", "--runs", "1"], spark) == 0
    assert capsys.readouterr().out.startswith("kernel=baseline m=32 k=32 n=16")
    with pytest.raises(SystemExit):
        main(["bench", "--kernel", "nothing"], spark)
