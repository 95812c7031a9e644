"""Command line: ``run`` one product with a plan and a verdict, ``bench`` strategies."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lacewing.operators import evaluate, layout, multiply
from lacewing.plans import planner
from lacewing.plans.stored import hold, hold_frame
from lacewing.sources import csr_binary, generate

PATTERNS = {
    "uniform": lambda s, m, k, p: generate.uniform(s, m, k, float(p)),
    "banded": lambda s, m, k, p: generate.banded(s, m, k, int(float(p))),
    "blockdiag": lambda s, m, k, p: generate.block_diagonal(s, m, k, int(float(p))),
    "powerlaw": lambda s, m, k, p: generate.power_law(s, m, k, float(p)),
}


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="lacewing")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("run", "bench"):
        c = commands.add_parser(name)
        c.add_argument("--m", type=int, default=1024)
        c.add_argument("--k", type=int, default=1024)
        c.add_argument("--n", type=int, default=64)
        c.add_argument("--pattern", choices=PATTERNS, default="uniform")
        c.add_argument("--param", default="0.01", help="density, bandwidth, block or mean degree")
        c.add_argument("--bin", help="a binary matrix instead of a pattern")
        c.add_argument("--threshold", type=float, default=planner.THRESHOLD)
        if name == "run":
            c.add_argument("--multi-gpu", action="store_true", help="rows in shards, one for each device")
            c.add_argument("--gpus", type=int, help="shards; as many as there are, if not given")
            c.add_argument("--unified", action="store_true", help="never broadcast the dense side")
            c.add_argument("--no-verify", action="store_true")
        if name == "bench":
            c.add_argument("--kernel", choices=[*multiply.STRATEGIES, "reference", "both", "all"], default="all", help="both: baseline and memopt")
            c.add_argument("--warmup", type=int, default=1)
            c.add_argument("--runs", type=int, default=3)
    return parser


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    a = csr_binary.read(spark, args.bin) if args.bin else PATTERNS[args.pattern](spark, args.m, args.k, args.param)
    a.entries = a.entries.withColumn("val", F.col("val").cast("long")) if not args.bin else a.entries
    b = generate.dense(spark, a.n_cols, args.n)
    nnz = a.entries.count()
    shape = f"m={a.n_rows} k={a.n_cols} n={args.n} nnz={nnz} density={nnz / max(a.n_rows * a.n_cols, 1):.6f}"
    if args.command == "run":
        stats = planner.block_stats(a).first()
        print(f"bsr_stats blocks={stats['n_blocks']} stored_elems={stats['stored_elements']} original_nnz={stats['original_nnz']} "
              f"fill_in_ratio={stats['fill_in_ratio']:.4f} block_density={stats['block_density']:.6f}")  # fmt: skip
        plan = planner.choose(a, args.n, args.threshold)
        print(f"hybrid_plan backend={plan.backend.value} fill_in={plan.fill_in_ratio:.4f} block_density={plan.block_density:.6f} "
              f"threshold={plan.threshold:.2f} n_aligned={int(plan.n_aligned)} reason=\"{plan.reason}\"")  # fmt: skip
        mode, product = "hybrid", lambda: multiply.hybrid(a, b, args.threshold)
        if args.multi_gpu or args.gpus:
            shards = multiply.clamp_devices(spark, args.gpus if args.gpus is not None else multiply.device_count(spark))
            mode, product = "multigpu", lambda: multiply.sharded(a, b, shards)
            split = {r["shard"]: r for r in layout.shard_summary(a, shards).collect()}
            parts = [f"gpu{g}:rows={split[g]['n_rows'] if g in split else 0},nnz={split[g]['nnz'] if g in split else 0}" for g in range(shards)]
            print(f"multigpu_split gpus={shards} {' '.join(parts)}")
        elif args.unified:
            mode, product = "unified", lambda: multiply.shuffled(a, b)
        seconds, _ = evaluate.benchmark(product, 1, 1)
        rate = 2.0 * nnz * args.n / max(seconds * 1e9, 1e-9)
        line = f"run mode={mode} {shape} time_ms={1000 * seconds:.4f} gflops={rate:.4f}"
        if args.no_verify:
            print(f"{line} rel_l2_err=nan [unverified]")
            return 0
        found = evaluate.error_stats(product(), multiply.long(a, b))
        row = found.select("rel_l2", evaluate.verdict(F.col("rel_l2")).alias("verdict")).first()
        print(f"{line} rel_l2_err={row['rel_l2']:.3e} {row['verdict']}")
        return 0 if row["verdict"] == "[PASS]" else 1
    names = {"all": ["reference", *multiply.STRATEGIES], "both": ["baseline", "memopt"]}.get(args.kernel, [args.kernel])
    with hold(a) as left, hold(b) as right, hold_frame(multiply.packed(left, right)) as reference:
        for name in names:
            if name == "tiled_v2" and args.n % 128:
                continue
            strategy, label = multiply.STRATEGIES.get(name, multiply.packed), name
            if name == "hybrid":
                plan = planner.choose(left, args.n, args.threshold)
                print(f"hybrid_plan backend={plan.backend.value} fill_in={plan.fill_in_ratio:.2f} block_density={plan.block_density:.4f} "
                      f"threshold={plan.threshold:.2f} n_aligned={int(plan.n_aligned)} reason=\"{plan.reason}\"")  # fmt: skip
                strategy, label = multiply.BACKENDS[plan.backend], f"hybrid[{plan.backend.value}]"
            seconds, _ = evaluate.benchmark(lambda: strategy(left, right), args.warmup, args.runs)  # noqa: B023
            rate = 2.0 * nnz * args.n / max(seconds * 1e9, 1e-9)
            err = evaluate.error_stats(strategy(left, right), reference).first()
            print(f"kernel={label} {shape} time_ms={1000 * seconds:.4f} gflops={rate:.2f} "
                  f"max_abs_err={err['max_abs']:.3e} max_rel_err={err['max_rel']:.3e} rel_l2_err={err['rel_l2']:.3e}")  # fmt: skip
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
