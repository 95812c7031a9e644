"""Connected components over an edge table, by alternating large-star and small-star steps.

Each step re-hangs the neighbours of every node under the least of them; the two steps
alternate until the edges no longer change, in a number of rounds that grows with the
logarithm of the longest chain. A hub's neighbours are never gathered: the least neighbour
is a map-side-combined aggregate, joined back to the edges by a join that adaptive execution
may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize, release


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
    hung = both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return hung.where("src > dst").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges lead from the greater to the smaller node here."""
    least = edges.groupBy("src").agg(F.min("dst").alias("m"))
    hung = edges.join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return hung.union(least.select("src", F.col("m").alias("dst"))).where("src > dst").distinct()


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """``edges`` (src long, dst long, either direction, repeats allowed) -> one row (node,
    component) for each node that is not the least of its component."""
    pair = edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    now, mark = materialize(pair.distinct(), "edges"), None
    for _ in range(most_rounds):
        row = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("src", "dst")).alias("x")).first()
        if (row["n"], row["x"]) == mark or not row["n"]:
            return now.select(F.col("src").alias("node"), F.col("dst").alias("component"))
        mark = (row["n"], row["x"])
        after = materialize(_small_star(_large_star(now)), "edges")
        release(now)
        now = after
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
