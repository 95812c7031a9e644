"""Plan and memory properties of the engine's operators, on matrices and groups with a heavy part."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacewing.cli import main
from lacewing.functions.scalars import ordered_bits
from lacewing.operators import analytics, evaluate, layout, multiply, selection
from lacewing.plans import planner, stored
from lacewing.plans.matrix import DenseMatrix, SparseMatrix
from lacewing.sources import csr_binary, generate, logs


def plan_of(df):
    """The plan that ran, after adaptive changes."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(plan):
    return len(re.findall(r"(?m)^[ :+|\-*()\d]*Exchange (hash|range|Single)", plan.split("== Initial Plan ==")[0]))


@pytest.fixture(scope="module")
def heavy(spark):
    """20000 rows: column 7 holds an entry of each, half of all; the rest is spread."""
    rows = spark.range(20_000)
    half = rows.select(F.col("id").alias("row"), F.lit(7).cast("long").alias("col"), (F.col("id") % 5 + 1).alias("val"))
    rest = rows.select(F.col("id").alias("row"), (F.col("id") * 7919 % 3000 + 8).alias("col"), (F.col("id") % 3 + 1).alias("val"))
    return SparseMatrix.from_entries(half.union(rest), 20_000, 3100)


def test_heavy_columns_are_found_and_the_product_is_right(spark, heavy):
    assert [r["col"] for r in multiply.heavy_columns(heavy, 32).collect()] == [7]
    b = generate.dense(spark, 3100, 3)
    key = lambda df: sorted(tuple(r) for r in df.select("row", "j", "c").collect())
    want = key(multiply.long(heavy, b))
    for limit in (3 * 8, 3 * 8 * 40, 1 << 20, 1):  # one column's row, 40 rows, all, none
        assert key(multiply.skewed(heavy, b, limit)) == want


def test_no_task_of_the_join_holds_the_heavy_column(spark, heavy):
    """Dealt by column, one task has half of all; by the heavy-column join, tasks are even."""
    b = generate.dense(spark, 3100, 2)
    for key, value in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(key, value)
    try:
        where = lambda df: [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        rows = b.rows.withColumnRenamed("k", "col")
        plain = where(heavy.entries.join(rows.hint("merge"), "col"))
        assert max(plain) > 3 * np.median(plain)
        heavy_cols = multiply.heavy_columns(heavy, 32)
        near = heavy.entries.join(F.broadcast(heavy_cols), "col", "left_semi")
        far = heavy.entries.join(F.broadcast(heavy_cols), "col", "left_anti").join(rows.hint("merge"), "col")
        for part in (near, far):
            sizes = where(part)
            assert max(sizes) <= 2 * np.median(sizes)
        plan = plan_of(multiply.skewed(heavy, b, 2 * 8 * 32))
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan and "approx_top_k" in plan
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_entries_without_a_column_add_nothing_beside_heavy_columns(spark, heavy):
    b = generate.dense(spark, 3100, 2)
    none = spark.createDataFrame([(3, None, 5), (20_000, None, 1), (20_000, 3099, None), (20_001, 5000, 2)], "row long, col long, val long")
    odd = SparseMatrix(heavy.entries.union(none), 20_002, 3100)
    got, want = multiply.skewed(odd, b, 2 * 8 * 2), multiply.shuffled(odd, b)
    assert want.exceptAll(got).count() == 0 and got.count() == want.count() == 2 * 20_001


def test_a_small_limit_does_not_hide_a_heavy_column(spark, heavy, monkeypatch):
    """Half of all entries is much, also where two dense rows fit the limit."""
    found, real = [], multiply.heavy_columns
    monkeypatch.setattr(multiply, "heavy_columns", lambda *x: found.append(real(*x)) or found[-1])
    multiply.skewed(heavy, generate.dense(spark, 3100, 2), 2 * 8 * 2)
    assert [r["col"] for r in found[0].collect()] == [7]


def test_a_heavy_column_without_a_dense_row_adds_nothing(spark, heavy):
    b = DenseMatrix(generate.dense(spark, 3100, 2).rows.where("k <> 7"), 3100, 2)
    got = multiply.skewed(heavy, b, 2 * 8 * 32)
    assert got.exceptAll(multiply.long(heavy, b)).count() == 0 and got.count() == 40_000


@pytest.mark.parametrize("n_shards,columns", [(1, 65_536), (7, 10), (16, 500), (50_000, 3)])
def test_entry_shards_are_even_whatever_the_rows(spark, n_shards, columns):
    """A row with 90% of all entries; empty rows and rows of one entry."""
    long_row = spark.range(9000).select(F.lit(5).cast("long").alias("row"), F.col("id").alias("col"))
    others = spark.range(1000).select((F.col("id") % 400 * 3).alias("row"), (F.col("id") * 13 % 9000).alias("col"))
    a = SparseMatrix(long_row.union(others).distinct().withColumn("val", F.col("col") + 1), 1300, 9000)
    entries = sorted((r["row"], r["col"], r["val"]) for r in a.entries.collect())
    got = sorted(layout.entry_shards(a, n_shards, columns).collect(), key=lambda r: r["pos"])
    assert [tuple(r)[:3] for r in got] == entries and [r["pos"] for r in got] == list(range(len(entries)))
    sizes = np.bincount([r["shard"] for r in got], minlength=n_shards)
    assert sizes.max() - sizes.min() <= 1 and [r["shard"] for r in got] == sorted(r["shard"] for r in got)
    if n_shards == 7:
        b = generate.dense(spark, 9000, 2)
        assert multiply.entry_sharded(a, b, 7).exceptAll(multiply.long(a, b)).count() == 0
        with pytest.raises(ValueError):
            layout.entry_shards(a, 0)


def test_each_shard_is_a_task_and_the_source_is_read_once(spark, sf_dir):
    from lacewing.queries import dense, supplier_matrix

    a, b = supplier_matrix(spark, sf_dir), dense(spark, sf_dir)
    before = stored.held()
    with stored.hold(a) as kept:
        assert stored.held() == before + 1
        dealt = layout.entry_shards(kept, 5).repartitionById(5, "shard").select("shard", F.spark_partition_id().alias("task"))
        assert all(r["shard"] == r["task"] for r in dealt.distinct().collect())
        plan = multiply.entry_sharded(kept, b, 5)._jdf.queryExecution().optimizedPlan().toString()
        assert "InMemoryRelation" in plan and len(re.findall(r"Relation \[l_orderkey", plan)) == 0
        chosen = planner.choose(kept, b.n_cols)
        assert chosen.backend in planner.Backend
        want = multiply.long(a, b)
        assert multiply.hybrid(kept, b).exceptAll(want).count() == 0
    assert stored.held() == before
    stored.hold(b)
    stored.free_all(before)
    assert stored.held() == before


def test_timing_is_of_the_product_alone(spark):
    builds = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            builds.add(1)
            yield batch

    before = stored.held()
    entries = generate.banded(spark, 40, 40, 2).entries.coalesce(1).mapInArrow(count, "row long, col long, val long")
    median, each = evaluate.benchmark_product(multiply.packed, SparseMatrix(entries, 40, 40), generate.dense(spark, 40, 4), warmup=1, runs=3)
    assert len(each) == 3 and median == sorted(each)[1]
    assert builds.value == 1 and stored.held() == before


def test_observed_numbers_come_with_the_result(spark):
    a, b = generate.banded(spark, 30, 30, 2), generate.dense(spark, 30, 4)
    c = multiply.packed(a, b)
    out, seen = evaluate.observed(c, c.withColumn("c", F.col("c") + 1), "both")
    rows = out.collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, c.collect()))
    assert seen.get["cells"] == len(rows) and seen.get["total"] == sum(r["c"] for r in rows) and seen.get["max_abs"] == 1
    assert seen.get["peak"] == max(abs(r["c"]) for r in rows)
    empty, seen = evaluate.observed(c.limit(0), name="empty")
    empty.collect()
    assert seen.get == {"cells": 0, "total": 0.0, "peak": 0.0}


def test_batched_products_are_each_right(spark):
    parts = [generate.uniform(spark, 20, 15, 0.2, salt).entries.withColumn("id", F.lit(None if salt == 3 else salt)) for salt in (1, 2, 3)]
    b = generate.dense(spark, 15, 4)
    got = multiply.batched(parts[0].union(parts[1]).union(parts[2]), b, ["id"])
    for part, salt in zip(parts, (1, 2, None)):
        want = multiply.long(SparseMatrix(part.drop("id"), 20, 15), b)
        assert got.where(F.col("id").eqNullSafe(F.lit(salt))).drop("id").exceptAll(want).count() == 0


def test_top_one_has_no_window_and_one_exchange(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("cell"), (F.col("id") % 50).alias("score"), F.col("id").alias("seq"), F.lit("t").alias("text"))
    for df in (analytics.best_per_cell(rows, ["cell"], "score", "seq"), analytics.keep_first(rows, ["cell"], ["score", "seq"])):
        plan = plan_of(df)
        assert "Window" not in plan and exchanges(plan) == 1
    speed = rows.select(
        F.lit("p").alias("pattern"), F.lit(1).alias("m"), (F.col("seq") % 40).alias("nnz"), F.col("cell").cast("string").alias("kernel"), F.col("score").cast("double").alias("gflops"), "seq",
    )
    assert "row_number" not in plan_of(analytics.speedups(speed, "1"))


def test_top_one_of_odd_values(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, 1.0, 5), (1, nan, 7), (1, nan, 6), (2, None, 1), (2, -inf, 2), (3, None, 2), (3, None, 1), (None, 2.0, 1), (None, 3.0, 2), (4, 0.0, 2), (4, -0.0, 1)]
    df = spark.createDataFrame(data, "cell int, score double, seq int")
    got = {r["cell"]: r["seq"] for r in analytics.best_per_cell(df, ["cell"], "score", "seq").collect()}
    assert got == {1: 6, 2: 2, 3: 1, None: 2, 4: 1}
    whole = spark.createDataFrame([(1, -(2**63), 1), (1, 2**63 - 1, 2), (2, None, 1), (2, -(2**63), 2)], "cell int, score long, seq int")
    assert {r["cell"]: r["seq"] for r in analytics.best_per_cell(whole, ["cell"], "score", "seq").collect()} == {1: 2, 2: 2}
    money = df.where("score = 2 OR score = 3").withColumn("score", F.col("score").cast("decimal(10,2)"))
    assert [r["seq"] for r in analytics.best_per_cell(money, ["cell"], "score", "seq").collect()] == [2]
    with pytest.raises(ValueError):
        analytics.best_per_cell(df.withColumn("score", F.lit("x")), ["cell"], "score", "seq")
    assert {r["cell"]: r["seq"] for r in analytics.keep_first(df, ["cell"], "seq").collect()} == {1: 5, 2: 1, 3: 1, None: 1, 4: 1}


def test_bits_are_in_the_order_of_doubles(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([
        rng.integers(0, 2**64, 5000, dtype=np.uint64).view(np.float64), 2.0 ** np.arange(-1074, 1024), np.nextafter(2.0 ** np.arange(-1022, 1024), 0),
        [0.0, -0.0, np.inf, -np.inf, np.nan, 5e-324, -5e-324, 1.7976931348623157e308],
    ])
    got = [r[0] for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double").orderBy("i").select(ordered_bits(F.col("x"))).collect()]
    size = np.abs(x).view(np.int64)
    want = np.where(np.isnan(x), 2047 * 2**52 + 1, np.where(x < 0, -size, size))
    assert got == want.tolist()


@pytest.mark.parametrize("limit", [0, 3, 1_000_000])
@pytest.mark.parametrize("kind", ["double", "long", "float"])
def test_medians_of_odd_groups(spark, limit, kind):
    rng = np.random.default_rng(1)
    groups = {1: rng.normal(size=101).tolist(), 2: [3.0] * 50 + [4.0] * 50, None: rng.integers(-9, 9, 40).tolist(), 4: [7.0], 5: [None, None], 6: [1.0, 2.0], 7: [-1e300 if kind == "double" else -5.0, 0.0, None]}
    if kind != "long":
        groups[8] = [float("nan"), 1.0, float("inf")]
        groups[9] = [float("nan")] * 3 + [1.0]
    rows = [(k, None if v is None else int(v) if kind == "long" else float(v)) for k, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, f"g int, v {kind}").repartition(5)
    read = {}
    for r in df.collect():
        read.setdefault(r["g"], []).append(r["v"])
    order = lambda v: (math.isnan(v), v)
    upper = {r["g"]: r["median"] for r in selection.exact_medians(df, ["g"], "v", upper=True, limit=limit).collect()}
    middle = {r["g"]: r["median"] for r in selection.exact_medians(df, ["g"], "v", limit=limit).collect()}
    for g, values in read.items():
        s = sorted((float(v) for v in values if v is not None), key=order)
        if not s:
            assert upper[g] == 0 and middle[g] is None
            continue
        assert upper[g] == s[len(s) // 2] or math.isnan(upper[g]) and math.isnan(s[len(s) // 2])
        want = (s[(len(s) - 1) // 2] * 0.5 + s[len(s) // 2] * 0.5) if len(s) % 2 == 0 else s[len(s) // 2]
        assert middle[g] == pytest.approx(want, rel=1e-15) or math.isnan(middle[g]) and math.isnan(want)
    assert set(upper) == set(read) == set(middle)


def test_a_large_group_is_counted_and_never_gathered(spark):
    """3 million distinct values in one group: every pass hands on counts of digits alone."""
    n = 3_000_000
    df = spark.range(n).select(F.lit(1).alias("g"), ((F.col("id") * 7919) % n).cast("double").alias("v"))
    found = selection.exact_medians(df, ["g"], "v", limit=1000)
    plan = plan_of(found)
    assert found.collect()[0]["median"] == (n - 1) / 2
    assert exchanges(plan) >= 4
    many = selection.exact_medians(spark.range(1000).select((F.col("id") % 250).alias("g"), F.col("id").alias("v")), ["g"], "v", limit=0, most_hot=100)
    assert many.count() == 250  # none has more than a hundredth: all plain


def test_the_format_is_read_by_rows_and_written_in_parallel(spark, tmp_path):
    a = generate.power_law(spark, 500, 90, 9)
    a = SparseMatrix(a.entries.withColumn("val", F.col("val") / 8.0), 503, 90)
    path = f"file://{tmp_path}/a.bin"
    words = csr_binary.WORDS
    csr_binary.WORDS = 700  # many tasks
    try:
        csr_binary.write(a, path)
    finally:
        csr_binary.WORDS = words
    assert [p.name for p in tmp_path.iterdir()] == ["a.bin"]
    entries = sorted((r["row"], r["col"], r["val"]) for r in a.entries.collect())
    raw = np.fromfile(tmp_path / "a.bin", "<i4")
    ptr = np.searchsorted([e[0] for e in entries], np.arange(504))
    assert raw[:3].tolist() == [503, 90, len(entries)] and raw[3:507].tolist() == ptr.tolist()
    assert raw[507 : 507 + len(entries)].tolist() == [e[1] for e in entries]
    assert raw[507 + len(entries) :].view("<f4").tolist() == [e[2] for e in entries]
    back = csr_binary.read(spark, path, 64)
    assert (back.n_rows, back.n_cols) == (503, 90)
    assert sorted((r["row"], r["col"], r["val"]) for r in back.entries.collect()) == entries


def test_rows_out_of_bounds_are_not_read(spark, tmp_path):
    a = generate.banded(spark, 200, 150, 3)
    path = f"file://{tmp_path}/a.bin"
    csr_binary.write(a, path)
    whole = sorted(r["row"] for r in a.entries.collect())
    for begin, end in ((20, 35), (0, 1), (41, 41), (190, 999), (-5, 3), (300, 400), (50, None)):
        found = csr_binary.read(spark, path, 10, begin, end)
        assert (found.n_rows, found.n_cols) == (200, 150)
        assert sorted(r["row"] for r in found.entries.collect()) == [r for r in whole if begin <= r < (200 if end is None else end)]
    assert csr_binary.read(spark, path, 10).entries.rdd.getNumPartitions() == 20
    assert csr_binary.read(spark, path, 10, 20, 35).entries.rdd.getNumPartitions() == 2
    rows = csr_binary.read(spark, path, 10).entries
    both = rows.where("row < 20").union(rows.where("row >= 40"))
    assert sorted(r["row"] for r in both.collect()) == [r for r in whole if r < 20 or r >= 40]
    # The last values are cut off: only a read that reaches them fails.
    (tmp_path / "cut.bin").write_bytes((tmp_path / "a.bin").read_bytes()[:-40])
    assert csr_binary.read(spark, f"file://{tmp_path}/cut.bin", 10, 0, 20).entries.count() == len([r for r in whole if r < 20])
    with pytest.raises(Exception, match="short read"):
        csr_binary.read(spark, f"file://{tmp_path}/cut.bin", 10).entries.count()


def test_a_failed_write_leaves_no_file(spark, tmp_path):
    boom = F.udf(lambda x: 1 // 0, "double")
    a = SparseMatrix(generate.banded(spark, 20, 20, 1).entries.withColumn("val", boom("val")), 20, 20)
    with pytest.raises(Exception, match="ZeroDivision"):
        csr_binary.write(a, f"file://{tmp_path}/x.bin")
    assert list(tmp_path.iterdir()) == []
    with pytest.raises(ValueError, match="file:"):
        csr_binary.write(a, "s3://bucket/x.bin")


def test_block_product_keeps_rows_with_entries_alone(spark):
    """Blocks are filled in NumPy: stored zeros count as entries, rows without any give no cell."""
    a = SparseMatrix.from_entries(spark.createDataFrame([(0, 0, 0), (3, 17, 2), (3, 40, 5), (47, 40, -1)], "row long, col long, val long"), 48, 41)
    b = generate.dense(spark, 41, 5)
    got = sorted(tuple(r) for r in multiply.block(a, b).select("row", "j", "c").collect())
    assert got == sorted(tuple(r) for r in multiply.long(a, b).select("row", "j", "c").collect())
    assert {r[0] for r in got} == {0, 3, 47}
    plan = plan_of(multiply.block(a, b))
    assert "map_from_entries" not in plan and "LeftSemi" not in plan


def test_roofline_table(spark, tmp_path):
    (tmp_path / "r.csv").write_text("pct_roofline,kernel,m,nnz,pct_dram_bw,gflops\n5.5,k1,4,9,1.5,2\n,k1,4,9,1.5,2\n5,k2,x,9,1,2\n7,wmma,4,9,1,99\n6,k3,4,9,1,3\n8,k3,4,8,1,3\n")
    rows = logs.read_roofline(spark, f"{tmp_path}/r.csv")
    assert rows.columns == ["kernel", "m", "nnz", "gflops", "pct_dram_bw", "pct_roofline"] and rows.count() == 4
    best = analytics.best_per_cell(rows.withColumn("seq", F.col("pct_roofline")), ["m", "nnz"], "gflops", "seq", F.col("kernel") == "wmma")
    assert sorted((r["nnz"], r["kernel"]) for r in best.collect()) == [(8, "k3"), (9, "k3")]


def test_bench_lines_have_errors_and_names(spark, capsys):
    args = ["bench", "--m", "32", "--k", "32", "--n", "16", "--pattern", "blockdiag", "--param", "16", "--runs", "1", "--warmup", "0", "--kernel"]
    before = stored.held()
    assert main([*args, "hybrid"], spark) == 0
    out = capsys.readouterr().out.splitlines()
    assert out[0].startswith("hybrid_plan backend=wmma fill_in=1.00 ") and out[1].startswith("kernel=hybrid[wmma] m=32 k=32 n=16 nnz=512 density=0.500000 time_ms=")
    assert out[1].endswith("max_abs_err=0.000e+00 max_rel_err=0.000e+00 rel_l2_err=0.000e+00")
    assert main([*args, "both"], spark) == 0
    names = [line.split()[0] for line in capsys.readouterr().out.splitlines()]
    assert names == ["kernel=baseline", "kernel=memopt"] and stored.held() == before
    line = spark.createDataFrame([(out[1],)], "value string")
    assert logs.parse_lines(line).first()["kernel"] == "hybrid[wmma]"


def shuffled(df):
    """Bytes that each exchange of the plan wrote, without adaptive changes."""
    spark, sizes = df.sparkSession, []
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df.select("*")._jdf.queryExecution().executedPlan()
        plan.executeCollect()

        def walk(node):
            if node.nodeName() == "Exchange":
                sizes.append(node.metrics().apply("shuffleBytesWritten").value())
            for i in range(node.children().size()):
                walk(node.children().apply(i))

        walk(plan)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    return sizes


@pytest.mark.parametrize("m,k", [(1, 1), (16, 16), (17, 33), (4000, 4000), (50, 600_000)])
def test_blocks_by_bits_are_those_by_rows(spark, m, k):
    ids = spark.range(3000)
    entries = ids.select((F.col("id") * 7919 % m).alias("row"), (F.col("id") * F.col("id") * 104_729 % k).alias("col"), F.lit(0).alias("val")).distinct()
    a = SparseMatrix(entries, m, k)
    bits, rows = (planner.block_stats(a, b).collect() for b in (True, False))
    assert bits == rows and bits[0]["n_blocks"] > 0
    none = SparseMatrix(entries.limit(0), m, k)
    assert planner.block_stats(none, True).collect() == planner.block_stats(none, False).collect()


def test_bits_shuffle_a_tenth_of_rows(spark):
    ids = spark.range(0, 400_000, 1, 8)
    entries = ids.select((F.xxhash64("id") % 2000 + 2000).alias("row"), (F.xxhash64("id", "id") % 2000 + 2000).alias("col"), F.lit(1).alias("val"))
    a = SparseMatrix(entries, 4000, 4000)
    bits, rows = (sum(shuffled(planner.block_stats(a, b))) for b in (True, False))
    assert 0 < 10 * bits < rows


def test_a_stored_grid_is_not_shuffled_again(spark, heavy):
    """One exchange, of partial sums; the heavy column lies in many buckets; the tables go."""
    b = generate.dense(spark, 3100, 3)
    key = lambda df: sorted(tuple(r) for r in df.select("row", "j", "c").collect())
    want, before = key(multiply.long(heavy, b)), stored.held()
    with stored.hold_grid(heavy, b, row_blocks=16, buckets=8) as grid:
        c = multiply.gridded(grid)
        sizes = shuffled(c)
        assert len(sizes) == 1
        plan = plan_of(c).split("== Initial Plan ==")[0]
        assert "SortMergeJoin" in plan and "Broadcast" not in plan and plan.count("Bucketed: true") == 2
        assert key(c) == want
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            joined = grid.left.join(grid.right.hint("merge"), ["rb", "k"])
            tasks = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        finally:
            spark.conf.unset("spark.sql.adaptive.enabled")
        assert len(tasks) == 8 and max(tasks) <= 2 * np.median(tasks)
        names = list(grid.tables)
        assert all(spark.catalog.tableExists(n) for n in names)
    assert not any(spark.catalog.tableExists(n) for n in names) and stored.held() == before
    where = spark._jvm.org.apache.hadoop.fs.Path(grid.path)
    assert not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def test_grids_of_odd_sides(spark, heavy):
    empty = DenseMatrix(generate.dense(spark, 3100, 2).rows.where("k < 0"), 3100, 2)
    with stored.hold_grid(heavy, empty, row_blocks=1, buckets=3) as grid:
        assert multiply.gridded(grid).count() == 0
    none = SparseMatrix(heavy.entries.limit(0), 20_000, 3100)
    with stored.hold_grid(none, generate.dense(spark, 3100, 2), 2, 2) as grid:
        assert multiply.gridded(grid).count() == 0
    with pytest.raises(ValueError):
        stored.hold_grid(heavy, empty, row_blocks=0)
