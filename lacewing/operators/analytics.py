"""Analytics of benchmark logs: roofline, best of a cell, speed-ups, keep-first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NumericType

from lacewing.functions.scalars import strategy_label
from lacewing.operators.selection import exact_medians

# The studied device's FP32 peak in GFLOP/s, memory bandwidth in GB/s, and
# second-level cache in bytes.
PEAK, BANDWIDTH, CACHE = 8140.0, 320.0, 4 << 20


def compulsory_bytes(m, k, n, nnz):
    return 8 * nnz.cast("long") + 4 * (m.cast("long") + 1) + 4 * k.cast("long") * n + 4 * m.cast("long") * n


def roofline(rows: DataFrame) -> DataFrame:
    """Places each row (kernel, m, k, n, nnz, time_ms, gflops) under the roof. Bandwidth is that
    of the compulsory bytes in the measured time."""
    m, k, n, nnz = F.col("m"), F.col("k"), F.col("n"), F.col("nnz").cast("long")
    out = rows.withColumn("flops", 2.0 * nnz * n).withColumn("dram_bytes", compulsory_bytes(m, k, n, nnz))
    out = out.withColumn("ai", F.col("flops") / F.col("dram_bytes")).withColumn("eff_bw", F.col("dram_bytes") / (F.col("time_ms") * 1e6))
    out = out.withColumn("ceiling", F.least(F.lit(PEAK), F.col("ai") * BANDWIDTH))
    return out.select(
        "kernel", "m", "k", "n", "nnz", "time_ms", "gflops", "flops", "dram_bytes", "ai", "ceiling",
        (100 * F.col("gflops") / PEAK).alias("pct_peak"),
        (100 * F.col("gflops") / F.col("ceiling")).alias("pct_roof"),
        "eff_bw",
        (100 * F.col("eff_bw") / BANDWIDTH).alias("pct_bw"),
        F.when(F.col("ai") > PEAK / BANDWIDTH, F.lit("compute/L2")).otherwise(F.lit("memory")).alias("bound"),
        (4 * k.cast("long") * n <= CACHE).alias("b_fits"),
    )


def _first(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The row of the least ``order`` of each key. It is an aggregate, so each task hands on one row
    for a key that it holds, and no key's rows are sorted in one task."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_row")).select("_row.*")


def _descending(rows: DataFrame, name: str) -> list:
    """Keys that ascend as a number descends; NaN comes first and null last."""
    kind, x = rows.schema[name].dataType, F.col(name)
    if not isinstance(kind, NumericType):
        raise ValueError(f"{name} must be a number")
    if isinstance(kind, IntegralType):
        return [x.isNull().alias("o0"), F.bitwise_not(x).alias("o1")]
    order = [x.isNull().alias("o0"), (-x).alias("o2")]
    return order if kind.typeName().startswith("decimal") else [order[0], (~F.isnan(x)).alias("o1"), order[1]]


def best_per_cell(rows: DataFrame, cell: list[str], score: str, order: str, skip=None) -> DataFrame:
    """The row of the best score in each cell; the first wins ties."""
    rows = rows if skip is None else rows.where(~skip)
    return _first(rows, cell, [*_descending(rows, score), F.col(order).alias("o3")])


def keep_first(rows: DataFrame, keys: list[str], order: str | list[str]) -> DataFrame:
    """The first row of each key; nulls are equal to each other."""
    return _first(rows, keys, [F.col(o).alias(f"o{i}") for i, o in enumerate([order] if isinstance(order, str) else order)])


def speedups(rows: DataFrame, baseline: str = "baseline", kernels: list[str] | None = None) -> DataFrame:
    """Median over nnz of a kernel's rate over the baseline's, by (pattern, m, kernel); rows are
    (pattern, m, nnz, kernel, gflops, seq). The last row of a name in a cell counts; cells
    without a baseline, or with one of zero, go. Names are put under one label only after
    that, so that several variants of one label all count. ``kernels`` are labels to keep. Of a
    cell only its last rows by name are gathered, so as many as there are names."""
    last = rows.groupBy("pattern", "m", "nnz", "kernel").agg(F.max_by("gflops", "seq").alias("gflops"))
    cells = last.groupBy("pattern", "m", "nnz").agg(
        F.max(F.when(F.col("kernel") == baseline, F.col("gflops"))).alias("base"), F.collect_list(F.struct("kernel", "gflops")).alias("each")
    )
    rates = cells.where("base <> 0").select("pattern", "m", "base", F.inline("each"))
    rates = rates.select("pattern", "m", strategy_label(F.col("kernel")).alias("kernel"), (F.col("gflops") / F.col("base")).alias("rate"))
    if kernels is not None:
        rates = rates.where(F.col("kernel").isin(kernels))
    return exact_medians(rates, ["pattern", "m", "kernel"], "rate", "speedup")


def size_label(m):
    return F.concat(F.expr(f"CAST({m} div 1024 AS STRING)"), F.lit("k"))


def profile_numbers(rows: DataFrame) -> DataFrame:
    """Adds to profiles (m, k, n, nnz, dram_pct, duration_ms) the measured MB, the compulsory and
    the measured intensity and the traffic ratio, rounded half to even; null where a part is
    missing, and measured ones also where no MB were."""
    nnz, n = F.col("nnz").cast("long"), F.col("n")
    flops = 2.0 * nnz * n
    need = compulsory_bytes(F.col("m"), F.col("k"), n, nnz)
    mb = F.bround(F.col("dram_pct") / 100 * BANDWIDTH * F.col("duration_ms"), 1)
    some = F.when(F.col("measured_dram_mb") != 0, F.col("measured_dram_mb") * 1e6)
    rows = rows.withColumn("measured_dram_mb", mb).withColumn("ai_compulsory", F.bround(flops / need, 2))
    return rows.withColumn("ai_measured", F.bround(flops / some, 2)).withColumn("traffic_ratio", F.bround(some / need, 1))
