"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its shuffled documents, offered again up to ``most_epochs``
times. A document's virtual finish time is its source's tokens up to and including it,
divided by the source's weight. All offers are put in the order of finish times and the mix
is that order cut off at the total budget. A source that runs out leaves the others to be
served faster, so the mix meets the targets that water-filling gives.

Sums along a queue never run in one task: documents are dealt to slices of their source by
the shuffle's hash, slices small enough to be summed alone, and the totals of the slices
before are added, which are themselves summed in blocks. The order over all sources is dealt
the same way, into ranges of finish time. The number of slices follows the number of documents; a document larger than a slice
is one of its own.

Collected to the driver: a row for each source, at most ``MOST_SOURCES``.

Defined cases: null or wordless text has size 0 and is taken in epoch 0 if its turn comes
before the cut-off; null is a source of its own, last; repeated rows count as documents each;
sources of size 0 get target 0; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import documents, materialize, n_words

MOST_SOURCES = 1_000_000


def shuffle_key(seed: int = 20) -> Column:
    """The order of a source's queue: 60 bits of a hash of the row's id and text."""
    hashed = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))))
    return F.conv(F.substring(hashed, 1, 15), 16, 10).cast("long")


def source_totals(sized: DataFrame) -> list[tuple]:
    """(source, size, documents, largest document) by code point of the source, null last."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("total"), F.count("*").alias("n"), F.max("size").alias("most")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    return sorted(((r["source"], r["total"] or 0, r["n"], r["most"] or 0) for r in rows), key=lambda r: (r[0] is None, r[0] or ""))


def targets(sizes: list[int], weights: list[float], budget: float, most_epochs: float = 3) -> list[float]:
    """Shares of the budget by weight; what is above ``most_epochs`` times a source's size
    is shared again among the others by weight, until none is above."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(budget)
    while open_:
        weight = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] > most_epochs * sizes[i] * weight}
        if not over:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = float(most_epochs * sizes[i])
            left -= out[i]
        open_ -= over
    return out


def sums_before(totals: DataFrame, by: list[str], at: str, value: str, out: str, per_block: int = 4096) -> DataFrame:
    """(by, at, out): the sum of ``value`` over lesser ``at``, within ``by``. Blocks of
    ``per_block`` are summed alone, so that no task orders more than a block or all blocks."""
    blocks = totals.withColumn("block", F.floor(F.col(at) / per_block))
    whole = W.partitionBy(*by).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = blocks.groupBy(*by, "block").agg(F.sum(value).alias("n_block"))
    before = before.select(
        *(F.col(c).alias(f"b_{c}") for c in by), F.col("block").alias("b_block"), F.coalesce(F.sum("n_block").over(whole), F.lit(0)).alias("b_before")
    )
    inner = W.partitionBy(*by, "block").orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    same = F.col("block") == F.col("b_block")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"b_{c}"))
    placed = blocks.withColumn("inner", F.coalesce(F.sum(value).over(inner), F.lit(0))).join(before, same)
    return placed.select(*by, at, (F.col("b_before") + F.col("inner")).alias(out))


def repeating_weights(sizes: list[int]) -> list[float]:
    return [float(1 + k % 3) for k in range(len(sizes))]


def mix(
    docs: DataFrame,
    weights=repeating_weights,
    budget: float | None = None,
    most_epochs: int = 3,
    seed: int = 20,
    documents_per_slice: int = 4_000,
) -> tuple[DataFrame, DataFrame]:
    """The mix in order, and the sized documents.

    ``weights`` gives each source's weight from the sizes of all, in the order of
    :func:`source_totals`. The first result has a row for each taken offer: row_id, doc_id,
    source, size, shuffle, epoch, finish (virtual finish time) and position (tokens of the mix
    before it). The second has a row for each document: row_id, doc_id, source, size, shuffle,
    and the source's source_size and target."""
    spark = docs.sparkSession
    # Written, a row's id is the same wherever it is read, and tells copies apart.
    row_id = F.monotonically_increasing_id().alias("row_id")
    sized = materialize(
        docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), shuffle_key(seed).alias("shuffle"), row_id), "sizes"
    )
    rows = source_totals(sized)
    sizes = [r[1] for r in rows]
    w = weights(sizes)
    total = float(sum(sizes)) if budget is None else float(budget)
    goal = targets(sizes, w, total, most_epochs)
    listed = [(*r[:3], float(x), g, max(1, -(-r[2] // documents_per_slice))) for r, x, g in zip(rows, w, goal)]
    sources = spark.createDataFrame(listed, "source string, source_size long, n long, weight double, target double, slices int").drop("n")
    same = lambda a: F.broadcast(a)  # noqa: E731  at most MOST_SOURCES rows
    small = same(sources.withColumnRenamed("source", "of_source")) if len(rows) <= 10_000 else sources.withColumnRenamed("source", "of_source")
    known = sized.join(small, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")

    unit = F.shiftright(F.col("shuffle"), 7) / F.lit(float(1 << 53))
    sliced = known.withColumn("slice", F.floor(unit * F.col("slices")).cast("int"))
    before = sliced.groupBy(F.col("source").alias("s_source"), F.col("slice").alias("s_slice")).agg(F.sum("size").alias("n"))
    before = sums_before(before, ["s_source"], "s_slice", "n", "before")
    within = W.partitionBy("source", "slice").orderBy("shuffle", "doc_id", "row_id").rowsBetween(W.unboundedPreceding, 0)
    summed = sliced.withColumn("within", F.sum("size").over(within))
    placed = summed.join(
        before, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("slice") == F.col("s_slice"))
    ).withColumn("served", F.col("before") + F.col("within"))
    epochs = F.explode(F.sequence(F.lit(0), F.lit(most_epochs - 1)))
    offers = placed.select("row_id", "doc_id", "source", "size", "shuffle", "source_size", "target", "weight", "served", epochs.alias("epoch"))
    finish = (F.col("served") + F.col("epoch") * F.col("source_size")) / F.col("weight")
    offers = offers.withColumn("finish", finish.cast("double"))
    # By the time at which the targets are met, each source has served its target but for
    # the document in service; a largest document later the budget is spent, so that no
    # later offer can be in the mix. The exact cut-off is by the summed order below.
    meet = max((g / x for g, x in zip(goal, w) if g > 0), default=0.0)
    spent = meet + max((r[3] / x for r, x in zip(rows, w)), default=0.0)
    offers = offers.where(F.col("finish") <= spent * (1 + 1e-9))
    n_offers = most_epochs * sum(r[2] for r in rows)
    ranges = max(1, int(-(-n_offers // documents_per_slice)))
    wide = max(meet, 1e-9) / ranges
    by_time = F.when(F.col("finish") <= meet, F.floor(F.col("finish") / wide)).otherwise(
        F.lit(ranges) + F.floor((F.col("finish") - meet) / wide)
    )
    offers = materialize(offers.withColumn("range", by_time.cast("long")), "offers")
    # Sources without a word finish at time 0, before any word is taken: all of their offers are
    # in the mix at its start, and none is put in order, which one range would have to do.
    first = offers.where("source_size = 0").withColumns({"position": F.lit(0).cast("long"), "end": F.lit(0).cast("long")})
    offers = offers.where("source_size > 0")
    by_range = offers.groupBy("range").agg(F.sum("size").alias("n"))
    by_range = sums_before(by_range, [], "range", "n", "range_before").where(F.col("range_before") <= total)
    in_range = W.partitionBy("range").orderBy("finish", "source", "epoch", "shuffle", "doc_id", "row_id").rowsBetween(W.unboundedPreceding, 0)
    taken = offers.join(by_range, "range").withColumn("end", F.col("range_before") + F.sum("size").over(in_range))
    taken = taken.where(F.col("end") <= total).withColumn("position", F.col("end") - F.col("size"))
    taken = materialize(taken.unionByName(first, allowMissingColumns=True), "taken")
    return taken, known


def repeats(taken: DataFrame, known: DataFrame) -> tuple[DataFrame, list]:
    """How often the mix takes rows of one (doc_id, shuffle, source): ``times`` for each of
    its copies. The copies of a document follow each other in their queue, so the cut-off
    leaves at most one such group of a source with some copies taken once more than others:
    these are the second result, (doc_id, shuffle, source, more)."""
    key = ["doc_id", "shuffle", "source"]
    copies = known.groupBy(*key).agg(F.count("*").alias("copies"))
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"t_{c}"))
    total = taken.groupBy(*(F.col(c).alias(f"t_{c}") for c in key)).agg(F.count("*").alias("n"))
    both = materialize(copies.join(total, same).select(*key, "n", "copies"), "repeats")
    uneven = both.where("n % copies > 0").select(*key, (F.col("n") % F.col("copies")).cast("long").alias("more")).collect()
    return both.select(*key, F.expr("n div copies").alias("times")), uneven


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with what the mix takes of it, repeated rows each their own."""
    taken, known = mix(documents(spark, sf_dir))
    by_row = taken.groupBy(F.col("row_id").alias("t_row")).agg(F.sum("size").alias("taken"))
    return known.join(by_row, F.col("row_id") == F.col("t_row"), "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


#: The same mix as one sorted table: sources capped in the order of their size by weight,
#: queues and the order of finish times by window sums.
OP2_SQL = r"""
WITH sized AS (
  SELECT row_number() OVER () AS row_id, doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('20|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS shuffle
  FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM sized GROUP BY source
), filled AS (
  SELECT *, sum(source_size) OVER () AS total,
         sum(source_size) OVER () - coalesce(3 * sum(source_size) OVER (
           ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
         sum(weight) OVER (ORDER BY source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM totals
), capped AS (
  SELECT *, remaining * weight > 3 * source_size * open_weight AS full_up FROM filled
), aims AS (
  SELECT source, source_size, weight, total,
         CASE WHEN full_up THEN (3 * source_size)::DOUBLE
              ELSE (total - coalesce(sum(3 * source_size) FILTER (full_up) OVER (), 0))::DOUBLE * weight
                   / sum(weight) FILTER (NOT full_up) OVER () END AS target
  FROM capped
), queued AS (
  SELECT z.row_id, z.doc_id, z.source, z.size, z.shuffle, a.source_size, a.weight, a.total, a.target,
         sum(z.size) OVER (PARTITION BY z.source ORDER BY z.shuffle, z.doc_id NULLS FIRST, z.row_id ROWS UNBOUNDED PRECEDING) AS served
  FROM sized z JOIN aims a ON z.source IS NOT DISTINCT FROM a.source
), offers AS (
  SELECT *, (served + epoch * source_size)::DOUBLE / weight::DOUBLE AS finish
  FROM queued, (SELECT unnest([0, 1, 2]) AS epoch)
), ordered AS (
  SELECT row_id, size, total, sum(size) OVER (
    ORDER BY finish, source NULLS FIRST, epoch, shuffle, doc_id NULLS FIRST, row_id ROWS UNBOUNDED PRECEDING) AS until
  FROM offers
), mixed AS (
  SELECT row_id, sum(size) AS taken FROM ordered WHERE until <= total GROUP BY row_id
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM queued LEFT JOIN mixed USING (row_id)
"""
