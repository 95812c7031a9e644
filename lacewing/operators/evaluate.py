"""Errors of a result against a reference, verdicts, and timing summaries."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lacewing.operators.selection import exact_medians
from lacewing.plans.matrix import DenseMatrix, SparseMatrix
from lacewing.plans.stored import hold


def error_stats(ours: DataFrame, reference: DataFrame) -> DataFrame:
    """One row: max_abs, max_rel (where the reference is above a thousandth of its peak) and
    rel_l2 (0 if the reference is all zero). Both are (row, j, c); absent cells are zero."""
    a, b = (x.select("row", "j", F.col("c").cast("double").alias(n)) for x, n in ((ours, "x"), (reference, "r")))
    both = a.join(b, ["row", "j"], "full").select(F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("r", F.lit(0.0)).alias("r"))
    peak = reference.agg(F.coalesce(F.max(F.abs(F.col("c").cast("double"))), F.lit(0.0)).alias("peak"))
    d = F.abs(F.col("x") - F.col("r"))
    big = F.abs("r") > F.lit(1e-3) * F.col("peak")
    return both.crossJoin(F.broadcast(peak)).agg(
        F.coalesce(F.max(d), F.lit(0.0)).alias("max_abs"),
        F.coalesce(F.max(F.when(big, d / F.abs("r"))), F.lit(0.0)).alias("max_rel"),
        F.when(F.sum(F.col("r") * F.col("r")) > 0, F.sqrt(F.sum(d * d) / F.sum(F.col("r") * F.col("r")))).otherwise(0.0).alias("rel_l2"),
    )


def verdict(l2, verified=None):
    """[PASS] below 0.01, [FAIL] else, NaN too; [unverified] where there was no reference."""
    found = F.when((l2 < 1e-2) & ~F.isnan(l2), F.lit("[PASS]")).otherwise(F.lit("[FAIL]"))
    return found if verified is None else F.when(verified, found).otherwise(F.lit("[unverified]"))


def makespan(times: DataFrame, group: str, device: str, ms: str) -> DataFrame:
    """The largest of the devices' upper medians."""
    return exact_medians(times, [group, device], ms, "m", upper=True).groupBy(group).agg(F.max("m").alias("makespan"))


def benchmark(make, warmup: int = 1, runs: int = 5) -> tuple[float, list[float]]:
    """Upper median of the seconds that running a DataFrame takes, and all of them."""
    taken = []
    for k in range(warmup + runs):
        began = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        if k >= warmup:
            taken.append(time.perf_counter() - began)
    return (sorted(taken)[len(taken) // 2] if taken else 0.0), taken


def benchmark_product(strategy, a: SparseMatrix, b: DenseMatrix, warmup: int = 1, runs: int = 5) -> tuple[float, list[float]]:
    """As ``benchmark``, of the product alone: both sides are stored first and freed after."""
    with hold(a) as left, hold(b) as right:
        return benchmark(lambda: strategy(left, right), warmup, runs)


def observed(c: DataFrame, reference: DataFrame | None = None, name: str = "product") -> tuple[DataFrame, Observation]:
    """The result, unchanged, and an observation that holds, once the result has been run, its
    cells, sum and largest magnitude. Against a reference, joined to it by cell, also the
    largest difference: one pass for the result and its numbers."""
    seen = Observation(name)
    value = F.col("c").cast("double")
    numbers = [F.count("*").alias("cells"), F.coalesce(F.sum(value), F.lit(0.0)).alias("total"), F.coalesce(F.max(F.abs(value)), F.lit(0.0)).alias("peak")]
    if reference is None:
        return c.observe(seen, *numbers), seen
    both = c.join(reference.select("row", "j", F.col("c").cast("double").alias("_r")), ["row", "j"], "left")
    apart = F.abs(value - F.coalesce("_r", F.lit(0.0)))
    return both.observe(seen, *numbers, F.coalesce(F.max(apart), F.lit(0.0)).alias("max_abs")).drop("_r"), seen
