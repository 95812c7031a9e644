"""The engine's registered queries over the driver's tables, each with SQL for the same rows.

Values are whole numbers, or one final division or root of them, so that engines agree.
A is supplier x (part modulo V), V the number of embeddings, with summed quantities; B is the
embeddings in millionths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacewing.functions.scalars import gflops, to_half
from lacewing.operators import analytics, evaluate, layout, multiply, selection, sweep
from lacewing.plans import planner
from lacewing.plans.matrix import DenseMatrix, SparseMatrix
from lacewing.plans.stored import hold, hold_grid, scratch
from lacewing.sources import csr_binary, generate, logs

SHARDS = 4
HALF_SCALE = 1024.0


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dense(spark, sf_dir) -> DenseMatrix:
    rows = _table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("k"), F.transform("embedding", lambda x: F.rint(x.cast("double") * 1000000).cast("long")).alias("b")
    )
    size = rows.agg(F.count("*").alias("k"), F.max(F.size("b")).alias("n")).first()
    return DenseMatrix(rows, size["k"], size["n"] or 0)


def supplier_matrix(spark, sf_dir, n_cols: int | None = None) -> SparseMatrix:
    n_cols = n_cols or _table(spark, sf_dir, "embeddings").count()
    entries = _table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("row"), (F.col("l_partkey") % n_cols).alias("col"), F.col("l_quantity").cast("long").alias("val")
    )
    n_rows = (_table(spark, sf_dir, "lineitem").agg(F.max("l_suppkey")).first()[0] or -1) + 1
    return SparseMatrix.from_entries(entries, n_rows, n_cols)


A = """v AS (SELECT count(*) AS v FROM embeddings),
a AS (SELECT l_suppkey AS row, l_partkey % (SELECT v FROM v) AS col,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS val FROM lineitem GROUP BY 1, 2),
nr AS (SELECT max(l_suppkey) + 1 AS n FROM lineitem)"""
B = """e AS (SELECT vec_id AS k, unnest(range(len(embedding))) AS j, unnest(embedding) AS x FROM embeddings),
b AS (SELECT k, CAST(j AS INTEGER) AS j, CAST(round_even(CAST(x AS DOUBLE) * 1000000, 0) AS BIGINT) AS b FROM e)"""
C = "c AS (SELECT a.row, b.j, CAST(sum(a.val * b.b) AS BIGINT) AS c FROM a JOIN b ON a.col = b.k GROUP BY 1, 2)"
PTR = """n AS (SELECT r.row, count(a.row) AS n FROM (SELECT unnest(range((SELECT n FROM nr))) AS row) r LEFT JOIN a ON a.row = r.row GROUP BY 1),
p AS (SELECT row, CAST(n AS BIGINT) AS n, CAST(coalesce(sum(n) OVER (ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ptr FROM n)"""
S = f"""t AS (SELECT count(*) AS t FROM a),
s AS (SELECT row, n, ptr, CAST({" + ".join(f"(ptr >= (t * {g}) // {SHARDS})::INT" for g in range(1, SHARDS))} AS INTEGER) AS shard FROM p, t)"""
STATS = """blk AS (SELECT row // 16 AS br, col // 16 AS bc, count(*) AS n FROM a GROUP BY 1, 2),
st AS (SELECT CAST(count(*) AS BIGINT) AS n_blocks, CAST(count(*) * 256 AS BIGINT) AS stored_elements, CAST(sum(n) AS BIGINT) AS original_nnz,
  count(*) * 256.0::DOUBLE / sum(n) AS fill_in_ratio,
  count(*)::DOUBLE / (((SELECT n FROM nr) + 15) // 16 * (((SELECT v FROM v) + 15) // 16)) AS block_density FROM blk)"""
HALF = "CASE WHEN x = 0 THEN x WHEN abs(x) >= 65520 THEN sign(x) * 'inf'::DOUBLE ELSE round_even(x / q, 0) * q END"
HALF_STEP = "pow(2.0, greatest(floor(log2(abs(x))), -14) - 10)"
PRODUCT = f"WITH {A}, {B}, {C} SELECT row, j, c FROM c"

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _product(name, strategy):
    def run(spark, sf_dir):
        return strategy(supplier_matrix(spark, sf_dir), dense(spark, sf_dir)).select("row", "j", "c")

    run.__name__ = name
    query(PRODUCT)(run)


_product("spmm_supplier_embedding", multiply.long)
_product("spmm_tiled", lambda a, b: multiply.wide(a, b))
_product("spmm_long", multiply.long)
_product("spmm_packed", multiply.packed)
_product("spmm_tiled_16", lambda a, b: multiply.wide(a, b, 16))
_product("spmm_tiled_aligned", lambda a, b: multiply.aligned_wide(a, b, 32))
_product("spmm_tiled_256", lambda a, b: multiply.wide(a, b, 256))
_product("spmm_block", multiply.block)
_product("spmm_hybrid", multiply.hybrid)
_product("spmm_sharded", lambda a, b: multiply.sharded(a, b, SHARDS))
_product("spmm_shuffled", multiply.shuffled)


#: Every second line of an order meets in column 0, so it holds an entry of nearly every row.
HEAVY = """h AS (SELECT l_orderkey AS row, CASE WHEN l_linenumber % 2 = 1 THEN 0 ELSE l_partkey % (SELECT count(*) FROM embeddings) END AS col,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS val FROM lineitem GROUP BY 1, 2)"""


def heavy_matrix(spark, sf_dir) -> SparseMatrix:
    n_cols = _table(spark, sf_dir, "embeddings").count()
    lines = _table(spark, sf_dir, "lineitem")
    col = F.when(F.col("l_linenumber") % 2 == 1, F.lit(0)).otherwise(F.col("l_partkey") % n_cols).cast("long")
    entries = lines.select(F.col("l_orderkey").cast("long").alias("row"), col.alias("col"), F.col("l_quantity").cast("long").alias("val"))
    return SparseMatrix.from_entries(entries, (lines.agg(F.max("l_orderkey")).first()[0] or -1) + 1, n_cols)


@query(f"WITH {HEAVY}, {B} SELECT h.row, b.j, CAST(sum(h.val * b.b) AS BIGINT) AS c FROM h JOIN b ON h.col = b.k GROUP BY 1, 2")
def spmm_heavy_columns(spark, sf_dir):
    """A column that nearly every row has; the dense side is over the limit that is set."""
    return multiply.skewed(heavy_matrix(spark, sf_dir), dense(spark, sf_dir), limit=1024).select("row", "j", "c")


_product("spmm_grid", lambda a, b: multiply.gridded(hold_grid(a, b, row_blocks=4)))
_product("spmm_entry_sharded", lambda a, b: multiply.entry_sharded(hold(a).matrix, b, SHARDS))


@query(
    f"WITH {A}, o AS (SELECT row, col, val, row_number() OVER (ORDER BY row, col) - 1 AS pos, count(*) OVER () AS n FROM a) SELECT row, col, val, pos, (pos * 7 // n)::INTEGER AS shard FROM o"
)
def entry_shards(spark, sf_dir):
    return layout.entry_shards(supplier_matrix(spark, sf_dir), 7, columns=64)


@query(PRODUCT)
def spmm_hybrid_stored(spark, sf_dir):
    """The matrix is built and stored once for the choice and the product."""
    return multiply.hybrid(hold(supplier_matrix(spark, sf_dir)).matrix, dense(spark, sf_dir)).select("row", "j", "c")


@query(
    f"""WITH {B}, a AS (SELECT l_returnflag, l_linestatus, l_suppkey AS row, l_partkey % (SELECT count(*) FROM embeddings) AS col, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS val
FROM lineitem GROUP BY 1, 2, 3, 4) SELECT l_returnflag, l_linestatus, a.row, b.j, CAST(sum(a.val * b.b) AS BIGINT) AS c FROM a JOIN b ON a.col = b.k GROUP BY 1, 2, 3, 4"""
)
def spmm_batched(spark, sf_dir):
    """A matrix for each return flag and line status, all in one plan."""
    b = dense(spark, sf_dir)
    keys = ["l_returnflag", "l_linestatus"]
    entries = _table(spark, sf_dir, "lineitem").select(
        *keys, F.col("l_suppkey").alias("row"), (F.col("l_partkey") % b.n_rows).alias("col"), F.col("l_quantity").cast("long").alias("val")
    )
    return multiply.batched(entries, b, keys)


@query(
    f"WITH {A}, {B}, {C} SELECT CAST(r.row AS BIGINT) AS row, CAST(g.j AS INTEGER) AS j, coalesce(c.c, 0) AS c FROM (SELECT unnest(range((SELECT n + 3 FROM nr))) AS row) r "
    "CROSS JOIN (SELECT DISTINCT j FROM b) g LEFT JOIN c ON c.row = r.row AND c.j = g.j"
)
def spmm_dense_output(spark, sf_dir):
    a = supplier_matrix(spark, sf_dir)
    a.n_rows += 3  # rows without entries
    return multiply.matmul(a, dense(spark, sf_dir), "tiled_v3")


@query(
    """WITH w AS (SELECT * FROM (VALUES ('click', 1, 2), ('view', 3, 5), ('purchase', 7, 11)) t(event_type, w0, w1)),
a AS (SELECT user_id AS row, event_type, count(*) AS val FROM events GROUP BY 1, 2)
SELECT row, CAST(sum(val * w0) AS BIGINT) AS c0, CAST(sum(val * w1) AS BIGINT) AS c1 FROM a JOIN w USING (event_type) GROUP BY 1"""
)
def spmm_event_profile(spark, sf_dir):
    w = spark.createDataFrame([("click", 1, 2), ("view", 3, 5), ("purchase", 7, 11)], "event_type string, w0 long, w1 long")
    a = _table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("row"), "event_type").agg(F.count("*").alias("val"))
    return a.join(F.broadcast(w), "event_type").groupBy("row").agg(F.sum(F.expr("val * w0")).alias("c0"), F.sum(F.expr("val * w1")).alias("c1"))


@query(
    f"WITH {A}, {B}, x AS (SELECT k, j, b / 1000000.0::DOUBLE AS x FROM b), q AS (SELECT *, {HALF_STEP} AS q FROM x), "
    f"h AS (SELECT k, j, CAST(round_even(({HALF}) * {HALF_SCALE}, 0) AS BIGINT) AS b FROM q) "
    "SELECT a.row, h.j, CAST(sum(a.val * h.b) AS BIGINT) AS c FROM a JOIN h ON a.col = h.k GROUP BY 1, 2"
)
def spmm_fp16(spark, sf_dir):
    b = dense(spark, sf_dir)
    near = F.transform("b", lambda x: F.rint(to_half(x / F.lit(1000000.0)) * HALF_SCALE).cast("long"))
    half = DenseMatrix(b.rows.select("k", near.alias("b")), b.n_rows, b.n_cols)
    return multiply.block(supplier_matrix(spark, sf_dir), half).select("row", "j", "c")


@query(
    f"WITH {A}, {B}, x AS (SELECT k, j, b / 1000000.0::DOUBLE AS x FROM b), q AS (SELECT *, {HALF_STEP} AS q FROM x), "
    f"h AS (SELECT k, j, CAST(round_even(({HALF}) * {HALF_SCALE}, 0) AS BIGINT) AS b FROM q), "
    f"av AS (SELECT row, col, val * 17.0::DOUBLE AS x FROM a), aq AS (SELECT *, {HALF_STEP} AS q FROM av), ah AS (SELECT row, col, {HALF} AS val FROM aq) "
    "SELECT ah.row, h.j, CAST(sum(ah.val * h.b) AS BIGINT) AS c FROM ah JOIN h ON ah.col = h.k GROUP BY 1, 2"
)
def spmm_fp16_both(spark, sf_dir):
    """Both sides rounded; the sparse one is scaled so that rounding shows."""
    a, b = supplier_matrix(spark, sf_dir), dense(spark, sf_dir)
    near = F.transform("b", lambda x: F.rint(to_half(x / F.lit(1000000.0)) * HALF_SCALE).cast("double"))
    half = DenseMatrix(b.rows.select("k", near.alias("b")), b.n_rows, b.n_cols)
    scaled = SparseMatrix(a.entries.withColumn("val", F.col("val") * F.lit(17.0)), a.n_rows, a.n_cols)
    return multiply.block(scaled, half, half=True).select("row", "j", F.col("c").cast("long").alias("c"))


@query(
    f"WITH x AS (SELECT vec_id, unnest(range(len(embedding))) AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), q AS (SELECT *, {HALF_STEP} AS q FROM x) "
    f"SELECT vec_id, CAST(j AS INTEGER) AS j, {HALF} AS h FROM q"
)
def half_round(spark, sf_dir):
    x = _table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("j", "x"))
    return x.select("vec_id", "j", to_half(F.col("x")).alias("h"))


@query(f"WITH {A} SELECT row, list(col ORDER BY col) AS cols, list(val ORDER BY col) AS vals FROM a GROUP BY 1")
def csr_rows(spark, sf_dir):
    return layout.csr_rows(supplier_matrix(spark, sf_dir))


@query(f"WITH {A}, {PTR} SELECT CAST(row AS BIGINT) AS row, n, ptr FROM p")
def csr_row_ptr(spark, sf_dir):
    return layout.row_ptr(supplier_matrix(spark, sf_dir))


@query(f"WITH {A} SELECT row - 3 AS row, col, val FROM a WHERE row >= 3 AND row < 8")
def csr_slice(spark, sf_dir):
    return supplier_matrix(spark, sf_dir).slice_rows(3, 8).entries


@query(f"WITH {A} SELECT row, col, val FROM a")
def coo_dedup(spark, sf_dir):
    return supplier_matrix(spark, sf_dir).entries


@query(f"WITH {A} SELECT row, col, val FROM a WHERE val >= 40 AND col % 2 = 0")
def nonzero_positions(spark, sf_dir):
    return supplier_matrix(spark, sf_dir).entries.where("val >= 40 AND col % 2 = 0")


@query(
    f"WITH {A}, g AS (SELECT DISTINCT row // 16 AS br, col // 16 AS bc FROM a), i AS (SELECT unnest(range(256)) AS i), "
    "f AS (SELECT br, bc, i, coalesce(val, 0) AS val FROM g CROSS JOIN i LEFT JOIN a ON a.row = br * 16 + i // 16 AND a.col = bc * 16 + i % 16) "
    "SELECT br, bc, list(val ORDER BY i) AS block FROM f GROUP BY 1, 2"
)
def bsr_blocks(spark, sf_dir):
    return layout.bsr_blocks(supplier_matrix(spark, sf_dir))


@query(
    f"WITH {A}, g AS (SELECT DISTINCT row // 16 AS row, col // 16 AS col FROM a), "
    "n AS (SELECT r.row, count(g.row) AS n FROM (SELECT unnest(range((SELECT (n + 15) // 16 FROM nr))) AS row) r LEFT JOIN g ON g.row = r.row GROUP BY 1) "
    "SELECT CAST(row AS BIGINT) AS row, CAST(n AS BIGINT) AS n, CAST(coalesce(sum(n) OVER (ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ptr FROM n"
)
def bsr_row_ptr(spark, sf_dir):
    return layout.bsr_row_ptr(supplier_matrix(spark, sf_dir))


@query(f"WITH {A} SELECT row, col, val FROM a WHERE val <> 0")
def bsr_unpack(spark, sf_dir):
    return layout.unpack_blocks(layout.bsr_blocks(supplier_matrix(spark, sf_dir)))


@query(f"WITH {A}, {STATS} SELECT * FROM st")
def bsr_stats(spark, sf_dir):
    return planner.block_stats(supplier_matrix(spark, sf_dir))


@query(f"WITH {A}, {STATS} SELECT * FROM st")
def bsr_stats_rows(spark, sf_dir):
    """The same numbers by a row for each block, as a large grid takes them."""
    return planner.block_stats(supplier_matrix(spark, sf_dir), bits=False)


@query(
    """WITH blk AS (SELECT l_orderkey // 16 AS br, l_partkey // 16 AS bc, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY 1, 2)
SELECT count(*) AS n_blocks, CAST(count(*) * 256 AS BIGINT) AS stored_elements, CAST(sum(n) AS BIGINT) AS original_nnz, count(*) * 256.0::DOUBLE / sum(n) AS fill_in_ratio,
  count(*)::DOUBLE / (((SELECT max(l_orderkey) FROM lineitem) + 16) // 16 * (((SELECT max(l_partkey) FROM lineitem) + 16) // 16)) AS block_density FROM blk"""
)
def bsr_stats_orders(spark, sf_dir):
    """Orders by parts: a grid of many bitmaps with few bits each."""
    lines = _table(spark, sf_dir, "lineitem")
    size = lines.agg(F.max("l_orderkey").alias("m"), F.max("l_partkey").alias("k")).first()
    entries = lines.select(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col"), F.lit(1).alias("val"))
    return planner.block_stats(SparseMatrix.from_entries(entries, (size["m"] or -1) + 1, (size["k"] or -1) + 1))


@query(
    f"WITH {A}, {STATS} SELECT CASE WHEN fill_in_ratio <= 2.0 THEN 'wmma' ELSE 'csr' END AS backend, fill_in_ratio, block_density, 2.0::DOUBLE AS threshold, "
    f"true AS n_aligned, CASE WHEN fill_in_ratio <= 2.0 THEN '{planner.REASONS['dense']}' ELSE '{planner.REASONS['sparse']}' END AS reason FROM st"
)
def hybrid_plan(spark, sf_dir):
    return planner.plan_row(planner.block_stats(supplier_matrix(spark, sf_dir)), 64)


@query(
    f"WITH {A}, {STATS} SELECT 'csr' AS backend, fill_in_ratio, block_density, 2.0::DOUBLE AS threshold, false AS n_aligned, '{planner.REASONS['unaligned']}' AS reason FROM st"
)
def hybrid_plan_unaligned(spark, sf_dir):
    return planner.plan_row(planner.block_stats(supplier_matrix(spark, sf_dir)), 65)


@query(f"WITH {A}, {PTR}, {S} SELECT CAST(row AS BIGINT) AS row, n, ptr, shard FROM s")
def nnz_shards(spark, sf_dir):
    return layout.nnz_shards(supplier_matrix(spark, sf_dir), SHARDS)


@query(f"WITH {A}, {PTR}, {S} SELECT shard, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(n) AS BIGINT) AS nnz FROM s GROUP BY 1")
def shard_summary(spark, sf_dir):
    return layout.shard_summary(supplier_matrix(spark, sf_dir), SHARDS)


def _scaled_results(spark, sf_dir):
    c = multiply.wide(supplier_matrix(spark, sf_dir), dense(spark, sf_dir))
    exact = c.select("row", "j", F.expr("c div 1000000").alias("c"))
    return exact.select("row", "j", F.expr("c + CAST((row + j) % 3 = 0 AS BIGINT)").alias("c")), exact


ERRORS = f"""WITH {A}, {B}, {C}, r AS (SELECT row, j, c // 1000000 AS q FROM c), pk AS (SELECT max(abs(q)) AS peak FROM r),
d AS (SELECT q, ((row + j) % 3 = 0)::INT AS d FROM r),
es AS (SELECT max(d)::DOUBLE AS max_abs, coalesce(max(CASE WHEN abs(q) > 1e-3 * peak THEN d::DOUBLE / abs(q) END), 0.0) AS max_rel,
  sqrt(sum(d)::DOUBLE / sum(q * q)::DOUBLE) AS rel_l2 FROM d, pk)"""


@query(f"{ERRORS} SELECT * FROM es")
def error_stats(spark, sf_dir):
    return evaluate.error_stats(*_scaled_results(spark, sf_dir))


@query(f"{ERRORS} SELECT CASE WHEN rel_l2 < 0.01 THEN '[PASS]' ELSE '[FAIL]' END AS verdict, '[unverified]' AS without FROM es")
def verdict(spark, sf_dir):
    row = evaluate.error_stats(*_scaled_results(spark, sf_dir))
    return row.select(evaluate.verdict(F.col("rel_l2")).alias("verdict"), evaluate.verdict(F.col("rel_l2"), F.lit(False)).alias("without"))


@query("SELECT event_type, CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY value DESC) AS DOUBLE) AS median FROM events GROUP BY 1")
def upper_median_by_type(spark, sf_dir):
    return selection.exact_medians(_table(spark, sf_dir, "events"), ["event_type"], "value", upper=True)


@query("SELECT event_type, median(value) AS median FROM events GROUP BY 1")
def interpolated_median(spark, sf_dir):
    return selection.exact_medians(_table(spark, sf_dir, "events"), ["event_type"], "value")


@query(
    """WITH x AS (SELECT l_returnflag AS flag, l_extendedprice::DOUBLE AS v FROM lineitem),
o AS (SELECT flag, v, row_number() OVER (PARTITION BY flag ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY flag) AS n FROM x)
SELECT flag, max(CASE WHEN k = n // 2 THEN v END) AS upper, (max(CASE WHEN k = (n - 1) // 2 THEN v END) * 0.5::DOUBLE + max(CASE WHEN k = n // 2 THEN v END) * 0.5::DOUBLE) AS middle FROM o GROUP BY 1"""
)
def median_by_digits(spark, sf_dir):
    """Every group selected digit by digit, as large ones are."""
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").cast("double").alias("v"))
    return selection.several_medians(rows, ["flag"], "v", {"upper": True, "middle": False}, limit=0)


@query(
    """WITH m AS (SELECT event_type, user_id % 4 AS device, CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY value DESC) AS DOUBLE) AS m FROM events GROUP BY 1, 2)
SELECT event_type, max(m) AS makespan FROM m GROUP BY 1"""
)
def makespan(spark, sf_dir):
    times = _table(spark, sf_dir, "events").withColumn("device", F.col("user_id") % 4)
    return evaluate.makespan(times, "event_type", "device", "value")


@query(
    f"WITH {A}, r AS (SELECT row, count(*) AS nnz FROM a GROUP BY 1) SELECT row, 2.0::DOUBLE * nnz * 64 / ((row + 1) * 1e6) AS gflops, nnz::DOUBLE / (SELECT v FROM v) AS density FROM r"
)
def gflops_density(spark, sf_dir):
    a = supplier_matrix(spark, sf_dir)
    rows = a.entries.groupBy("row").agg(F.count("*").alias("nnz"))
    return rows.select("row", gflops(F.col("nnz"), 64, F.col("row") + 1).alias("gflops"), (F.col("nnz") / F.lit(float(a.n_cols))).alias("density"))


# A result row for each line of an order: sizes, time and rate from its numbers.
_CELLS = """cells AS (SELECT 'k' || l_linenumber AS kernel, (l_suppkey + 1)::INTEGER AS m, (l_partkey + 1)::INTEGER AS k, 256 AS n, (l_orderkey * 64 + 1)::BIGINT AS nnz,
  l_quantity::DOUBLE AS time_ms, l_extendedprice::DOUBLE AS gflops FROM lineitem)"""


def _cells(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("k"), F.col("l_linenumber").cast("string")).alias("kernel"), (F.col("l_suppkey") + 1).cast("int").alias("m"), (F.col("l_partkey") + 1).cast("int").alias("k"),
        F.lit(256).alias("n"), (F.col("l_orderkey") * 64 + 1).cast("long").alias("nnz"), F.col("l_quantity").cast("double").alias("time_ms"), F.col("l_extendedprice").cast("double").alias("gflops"),
    )


@query(
    f"""WITH {_CELLS}, x AS (SELECT *, 2.0::DOUBLE * nnz * n AS flops, 8 * nnz + 4 * (m::BIGINT + 1) + 4 * k::BIGINT * n + 4 * m::BIGINT * n AS dram_bytes FROM cells),
y AS (SELECT *, flops / dram_bytes AS ai, least(8140.0::DOUBLE, flops / dram_bytes * 320) AS ceiling, dram_bytes / (time_ms * 1e6) AS eff_bw FROM x)
SELECT kernel, m, k, n, nnz, time_ms, gflops, flops, dram_bytes, ai, ceiling, 100 * gflops / 8140 AS pct_peak, 100 * gflops / ceiling AS pct_roof,
eff_bw, 100 * eff_bw / 320 AS pct_bw, CASE WHEN ai > 25.4375 THEN 'compute/L2' ELSE 'memory' END AS bound, 4 * k::BIGINT * n <= 4194304 AS b_fits FROM y"""
)
def roofline(spark, sf_dir):
    return analytics.roofline(_cells(spark, sf_dir))


_BEST = """WITH t AS (SELECT user_id, event_type, value, event_id FROM events WHERE event_type <> 'error')
SELECT user_id, event_type, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM t) WHERE k = 1"""


@query(_BEST)
def best_per_cell(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id")
    return analytics.best_per_cell(rows, ["user_id"], "value", "event_id", F.col("event_type") == "error")


# Two variants of one label in many cells, a baseline that is missing or zero in others.
_SPEED = """WITH t AS (SELECT user_id % 3 AS pattern, event_id % 2 AS m, user_id % 50 AS nnz, event_type AS name, round(value) AS rate, event_id AS seq FROM events),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pattern, m, nnz, name ORDER BY seq DESC) AS k FROM t) WHERE k = 1),
b AS (SELECT l.*, c.rate AS base FROM l JOIN l c ON c.name = 'click' AND l.pattern = c.pattern AND l.m = c.m AND l.nnz = c.nnz WHERE c.rate <> 0)
SELECT pattern, m, CASE WHEN name IN ('view', 'purchase') THEN 'hybrid' ELSE name END AS kernel, median(rate / base) AS speedup
FROM b WHERE name IN ('view', 'purchase', 'click', 'login') GROUP BY 1, 2, 3"""


@query(_SPEED)
def speedup_median(spark, sf_dir):
    kind = F.col("event_type")
    kernel = F.when(kind == "view", F.lit("hybrid[csr]")).when(kind == "purchase", F.lit("hybrid[wmma]")).otherwise(kind)
    rows = _table(spark, sf_dir, "events").select(
        (F.col("user_id") % 3).alias("pattern"), (F.col("event_id") % 2).alias("m"), (F.col("user_id") % 50).alias("nnz"),
        kernel.alias("kernel"), F.round("value").alias("gflops"), F.col("event_id").alias("seq"),
    )
    return analytics.speedups(rows, "click", ["hybrid", "click", "login"])


@query(
    "SELECT k1, event_type, event_id FROM (SELECT nullif(user_id % 7, 0) AS k1, event_type, event_id, row_number() OVER (PARTITION BY nullif(user_id % 7, 0), event_type ORDER BY event_id) AS k FROM events) WHERE k = 1"
)
def keep_first(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select(F.nullif(F.col("user_id") % 7, F.lit(0)).alias("k1"), "event_type", "event_id")
    return analytics.keep_first(rows, ["k1", "event_type"], "event_id")


@query("SELECT DISTINCT l_linenumber * 1024 AS m, concat(CAST(l_linenumber AS VARCHAR), 'k') AS label FROM lineitem")
def distinct_sizes(spark, sf_dir):
    sizes = _table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") * 1024).alias("m")).distinct()
    return sizes.select("m", analytics.size_label("m").alias("label"))


# Cells of a notebook, one or two for each supplier: a profile alone (again in the next cell), a bundle of two, or no profile.
_BODY = "GPU Speed Of Light\nMemory Throughput   %   61.5\nDRAM Throughput % {}\nL1/TEX Cache Throughput % {}\nL2 Cache Throughput % 20\nCompute (SM) Throughput % 70.25\nDuration {}\n"


@query(
    """WITH s AS (SELECT s_suppkey::INTEGER AS c, s_suppkey % 10 * 10.0::DOUBLE AS pct, (s_suppkey + 1)::DOUBLE AS ms, s_suppkey::BIGINT * 1000 + 1 AS nnz FROM supplier),
p AS (SELECT 2 * c AS cell, concat('profile ', c) AS source, 'k1' AS kernel, 1024 AS m, 1024 AS k, 256 AS n, nnz, pct, c::DOUBLE AS l1, ms FROM s WHERE c % 3 = 0
UNION ALL SELECT 2 * c, 'a.txt', NULL, NULL, NULL, NULL, NULL, pct, c + 0.5::DOUBLE, ms FROM s WHERE c % 3 = 1
UNION ALL SELECT 2 * c, 'b.txt', 'k2', 2048, 1024, 256, nnz, 50.0, c::DOUBLE, 0.5 FROM s WHERE c % 3 = 1),
q AS (SELECT *, 8 * nnz + 4 * (m + 1) + 4 * k * n + 4 * m * n AS need, round_even(pct / 100 * 320 * ms, 1) AS mb FROM p)
SELECT cell, source, kernel, m, k, n, nnz, 61.5::DOUBLE AS mem_pct, pct AS dram_pct, l1 AS l1tex_pct, 20.0::DOUBLE AS l2_pct, 70.25::DOUBLE AS sm_pct, ms AS duration_ms, mb AS measured_dram_mb,
  round_even(2.0::DOUBLE * nnz * n / need, 2) AS ai_compulsory, CASE WHEN mb <> 0 THEN round_even(2.0::DOUBLE * nnz * n / (mb * 1e6), 2) END AS ai_measured,
  CASE WHEN mb <> 0 THEN round_even(mb * 1e6 / need, 1) END AS traffic_ratio FROM q"""
)
def profile_extract(spark, sf_dir):
    c = F.col("s_suppkey").cast("int")
    line = lambda kernel, m: F.concat(F.lit(f"kernel={kernel} m={m} k=1024 n=256 nnz="), (F.col("s_suppkey") * 1000 + 1).cast("string"), F.lit(" density=0.01 time_ms=0.03 gflops=177.3\n"))
    head, mid, tail, _ = _BODY.replace("Duration {}", "{}Duration ").split("{}")

    def body(pct, l1, duration):
        return F.concat(F.lit(head), pct.cast("string"), F.lit(mid), l1.cast("string"), F.lit(tail + "Duration "), duration, F.lit("\n"))

    pct, ms = c % 10 * 10, c + 1
    alone = F.concat(line("k1", 1024), body(pct, c, F.concat(F.lit("us "), F.format_number(ms * 1000, 0))))
    bundle = F.concat(
        F.lit("pre\n========== a.txt ==========\n"), body(pct, c + F.lit(0.5), F.concat(F.lit("ms "), ms.cast("string"))),
        F.lit("========== b.txt ==========\n"), F.lit("kernel=hybrid[csr] m=1 k=1 n=1 nnz=1 density=1 time_ms=1 gflops=1\n"), line("k2", 2048), body(F.lit(50), c, F.lit("ms 0.5")),
    )
    cell = lambda k, source, text: F.struct((2 * c + k).alias("cell"), source.alias("source"), text.alias("text"))
    title = F.concat(F.lit("# profile "), c.cast("string"), F.lit("\nrun()"))
    cells = F.when(c % 3 == 0, F.array(cell(0, title, alone), cell(1, F.lit("again"), alone))).when(c % 3 == 1, F.array(cell(0, F.lit("bundle"), bundle)))
    rows = _table(spark, sf_dir, "supplier").select(F.inline(F.coalesce(cells, F.array(cell(0, F.lit("nothing"), F.lit("DRAM Throughput % 50"))))))
    return logs.profiles(rows)


@query(
    """SELECT concat('A', s_suppkey) AS name, concat('DRAM ', s_nationkey, chr(10), 'x', chr(10)) AS body FROM supplier
UNION ALL SELECT concat('C ', s_nationkey), concat('more DRAM of ', s_suppkey) FROM supplier"""
)
def sections(spark, sf_dir):
    key, nation = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    text = F.concat(
        F.lit("intro\n====== A"), key, F.lit(" ======\nDRAM "), nation, F.lit("\nx\n====== B"), key, F.lit(" ======\nnothing\n====== C "), nation, F.lit(" ======\nmore DRAM of "), key
    )
    return logs.sections(_table(spark, sf_dir, "supplier").select(text.alias("value")), "DRAM")


def _log_lines(spark, sf_dir):
    """A line of a log for each line of an order, by its order's number: as it should be; with blanks
    around it, two between fields, and a label; with a field that comes twice and a note; without a
    number; or of another kind."""
    f = {k: v.cast("string") for k, v in ((c, F.col(c)) for c in _cells(spark, sf_dir).columns)}
    part = lambda *names: F.concat(*(x for k in names for x in (F.lit(f"{k}="), f[k], F.lit(" "))))
    kinds = F.expr("(nnz - 1) div 64 % 5")
    line = (
        F.when(kinds == 0, F.concat(part("kernel", "m", "k", "n", "nnz"), F.lit("density=0.25 "), part("time_ms", "gflops")))
        .when(kinds == 1, F.concat(F.lit("  kernel=hybrid[csr] "), part("m"), F.lit(" "), part("k", "n", "nnz", "time_ms", "gflops"), F.lit("\t")))
        .when(kinds == 2, F.concat(part("kernel"), F.lit("m=7 "), part("k", "n", "nnz", "m"), F.lit("(again) gflops=3 "), part("time_ms", "gflops")))
        .when(kinds == 3, part("kernel", "m", "k", "n", "time_ms", "gflops"))
        .otherwise(F.concat(F.lit("bsr_stats blocks=12 "), part("m", "k", "n", "nnz", "time_ms", "gflops")))
    )
    return _cells(spark, sf_dir).select(line.alias("value"))


_PARSED = f"""WITH {_CELLS}, parsed AS (SELECT CASE WHEN (nnz - 1) // 64 % 5 = 1 THEN 'hybrid[csr]' ELSE kernel END AS kernel, m, k, n, nnz,
  CASE WHEN (nnz - 1) // 64 % 5 = 0 THEN 0.25::DOUBLE END AS density, time_ms, gflops FROM cells WHERE (nnz - 1) // 64 % 5 < 3)"""


@query(f"{_PARSED} SELECT * FROM parsed")
def log_parse(spark, sf_dir):
    return logs.parse_lines(_log_lines(spark, sf_dir))


@query(
    f"""{_PARSED} SELECT 'log' AS origin, 'uniform' AS pattern, kernel, m, nnz, gflops FROM parsed
UNION ALL SELECT 'table', CASE WHEN nnz % 4 = 1 THEN 'uniform' ELSE 'banded' END, kernel, m, nnz, gflops FROM cells WHERE m % 4 <> 2"""
)
def csv_or_log(spark, sf_dir):
    """The same loader on a table with columns in an order of its own and on a log."""
    table, log = scratch(spark, "table") + ".csv", scratch(spark, "log") + ".txt"
    text = {c: F.col(c).cast("string") for c in ("m", "nnz", "kernel", "gflops", "time_ms")}
    # Some rows lack a pattern, in others a number is none.
    nnz = F.when(F.col("m") % 4 == 2, F.lit("x")).otherwise(text["nnz"])
    pattern = F.when(F.col("nnz") % 4 == 1, F.lit("")).otherwise(F.lit("banded"))
    rows = _cells(spark, sf_dir).select(nnz.alias("nnz"), pattern.alias("pattern"), *(text[c].alias(c) for c in ("gflops", "kernel", "time_ms", "m")))
    rows.write.csv(table, header=True)
    _log_lines(spark, sf_dir).write.text(log)
    out = None
    for name, path in (("table", table), ("log", log)):
        part = logs.read_rows(spark, path).select(F.lit(name).alias("origin"), "pattern", "kernel", "m", "nnz", "gflops")
        out = part if out is None else out.union(part)
    return out


def _hash_sql(*keys: str, salt: int = 42) -> str:
    h = str(salt) + "::BIGINT"
    for k in keys:
        h = f"(({h} * 1103515245 + ({k})::BIGINT * 2654435761 + 12345) % 2147483648)"
        h = f"(({h} * 69069 + {h} // 65536) % 2147483648)"
    return h


_VALUE = f"CAST({_hash_sql('row', 'col', salt=7)} % 2000 - 1000 AS BIGINT) AS val"


# Matrices as high and wide as tables are long.
_M, _K = "(SELECT 16 + count(*) FROM supplier)", "(SELECT count(*) FROM embeddings)"
_GRID = f"(SELECT unnest(range({_M})) AS row) CROSS JOIN (SELECT unnest(range({_K})) AS col)"


def _sizes(spark, sf_dir) -> tuple[int, int]:
    return 16 + _table(spark, sf_dir, "supplier").count(), _table(spark, sf_dir, "embeddings").count()


@query(f"SELECT row, col, {_VALUE} FROM {_GRID} WHERE {_hash_sql('row', 'col')} < {int(0.02 * generate.SCALE)}")
def gen_uniform_hash(spark, sf_dir):
    return generate.uniform(spark, *_sizes(spark, sf_dir), 0.02).entries


@query(f"SELECT row, col, {_VALUE} FROM {_GRID} WHERE abs(row - col) <= 9")
def gen_banded(spark, sf_dir):
    return generate.banded(spark, *_sizes(spark, sf_dir), 9).entries


@query(f"SELECT row, col, {_VALUE} FROM {_GRID} WHERE row // 16 = col // 16 AND row // 16 < least({_M}, {_K}) // 16")
def gen_blockdiag(spark, sf_dir):
    return generate.block_diagonal(spark, *_sizes(spark, sf_dir), 16).entries


def _power_law_sql(rows, cols, mean: float, alpha: float) -> str:
    """(row, col) of the power-law generator."""
    return f"""WITH u AS (SELECT row, pow(({_hash_sql('row', salt=11)} + 0.5::DOUBLE) / {generate.SCALE}, {-1.0 / alpha}::DOUBLE) AS raw FROM (SELECT unnest(range({rows})) AS row)),
d AS (SELECT row, least({cols}, greatest(1, round_even(raw * ({float(mean)}::DOUBLE / (SELECT sum(raw) / count(*) FROM u)), 0)))::INT AS d FROM u),
i AS (SELECT row, d, unnest(range(3 * d + 21)) AS i FROM d),
f AS (SELECT row, d, {_hash_sql('row', 'i', salt=13)} % {cols} AS col, min(i) AS i FROM i GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY i) AS k, count(*) OVER (PARTITION BY row) AS n FROM f),
x AS (SELECT row, d, unnest(range({cols})) AS c FROM (SELECT DISTINCT row, d FROM r WHERE n < d)),
y AS (SELECT row, d, c, row_number() OVER (PARTITION BY row ORDER BY {_hash_sql('row', 'c', salt=17)}, c) AS k FROM x)
SELECT row, col FROM r WHERE n >= d AND k <= d UNION ALL SELECT row, c AS col FROM y WHERE k <= d"""


@query(f"SELECT row, col, {_VALUE} FROM ({_power_law_sql(_M, _K, 8, 1.1)})")
def gen_powerlaw_hash(spark, sf_dir):
    return generate.power_law(spark, *_sizes(spark, sf_dir), 8, 1.1).entries


@query(f"SELECT k, CAST(j AS INTEGER) AS j, CAST({_hash_sql('k', 'j', salt=43)} % 2000 - 1000 AS BIGINT) AS b FROM (SELECT unnest(range({_K})) AS k) CROSS JOIN (SELECT unnest(range(24)) AS j)")
def gen_dense_hash(spark, sf_dir):
    return generate.dense(spark, _sizes(spark, sf_dir)[1], 24).long()


def _pattern_sql(name: str, where: str) -> str:
    return f"""SELECT '{name}' AS pattern, CAST({_M} AS INTEGER) AS m, count(*) AS n_blocks, sum(n)::BIGINT AS nnz, count(*) * 256.0::DOUBLE / sum(n) AS fill_in
FROM (SELECT count(*) AS n FROM {_GRID} WHERE {where} GROUP BY row // 16, col // 16)"""


@query(f"{_pattern_sql('banded', 'abs(row - col) <= 32')} UNION ALL {_pattern_sql('blockdiag', f'row // 16 = col // 16 AND row // 16 < least({_M}, {_K}) // 16')}")
def pattern_stats(spark, sf_dir):
    out, (m, k) = None, _sizes(spark, sf_dir)
    for name, a in (("banded", generate.banded(spark, m, k, 32)), ("blockdiag", generate.block_diagonal(spark, m, k, 16))):
        part = planner.block_stats(a).select(
            F.lit(name).alias("pattern"), F.lit(m).alias("m"), "n_blocks", F.col("original_nnz").alias("nnz"), F.col("fill_in_ratio").alias("fill_in")
        )
        out = part if out is None else out.union(part)
    return out


def _sweep_sql(sizes, n: int) -> str:
    cells = {
        "uniform": lambda m: f"SELECT row, col FROM (SELECT unnest(range({m})) AS row) CROSS JOIN (SELECT unnest(range({m})) AS col) WHERE {_hash_sql('row', 'col')} < {int(0.01 * generate.SCALE)}",
        "banded": lambda m: f"SELECT row, col FROM (SELECT unnest(range({m})) AS row) CROSS JOIN (SELECT unnest(range({m})) AS col) WHERE abs(row - col) <= 32",
        "block-diagonal": lambda m: f"SELECT row, col FROM (SELECT unnest(range({m})) AS row) CROSS JOIN (SELECT unnest(range({m})) AS col) WHERE row // 16 = col // 16 AND row // 16 < {m} // 16",
        "power-law": lambda m: _power_law_sql(m, m, 32, 2.5),
    }
    parts = []
    for name, sql in cells.items():
        for m in sizes:
            b = f"SELECT k, j, {_hash_sql('k', 'j', salt=43)} % 2000 - 1000 AS b FROM (SELECT unnest(range({m})) AS k) CROSS JOIN (SELECT unnest(range({n})) AS j)"
            parts.append(
                f"SELECT '{name}' AS pattern, CAST({m} AS INTEGER) AS m, (SELECT count(*) FROM ({sql(m)})) AS nnz, count(*) AS cells, CAST(sum(c) AS BIGINT) AS total FROM "
                f"(SELECT row, j, sum(val * b) AS c FROM (SELECT row, col, {_VALUE} FROM ({sql(m)})) JOIN ({b}) ON col = k GROUP BY 1, 2)"
            )
    return " UNION ALL ".join(parts)


@query(_sweep_sql(("(SELECT 16 + count(*) FROM nation)", _M), 16))
def pattern_sweep(spark, sf_dir):
    return sweep.pattern_sweep(spark, (16 + _table(spark, sf_dir, "nation").count(), _sizes(spark, sf_dir)[0]), 16)


@query(f"WITH {A} SELECT row, col, CAST(val AS BIGINT) AS val FROM a")
def csr_binary_roundtrip(spark, sf_dir):
    path = scratch(spark, "matrix") + ".bin"
    csr_binary.write(hold(supplier_matrix(spark, sf_dir)).matrix, path)
    return csr_binary.read(spark, path, 64).entries.withColumn("val", F.col("val").cast("long"))


@query(f"WITH {A} SELECT row, col, CAST(val AS BIGINT) AS val FROM a WHERE row BETWEEN 11 AND 37 AND col % 3 = 1")
def csr_binary_rows(spark, sf_dir):
    """A range of rows of a file, of which no other row is read."""
    path = scratch(spark, "matrix") + ".bin"
    csr_binary.write(supplier_matrix(spark, sf_dir), path)
    found = csr_binary.read(spark, path, 8, begin=11, end=38).entries.where("col % 3 = 1")
    return found.withColumn("val", F.col("val").cast("long"))
