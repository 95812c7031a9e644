"""Exact medians of groups of any size.

A group's values are never gathered. Values map to whole numbers in the same order (a
double's bits), and the wanted rank is found from the top digits down: a pass counts the
values by their next 16 bits, combined before the shuffle, and keeps the digit in which the
rank lies; four passes settle all 64 bits, whatever the size of a group. A pass's table has at
most 65536 rows for each group and task.

Only groups above a share of all rows need this, and there are at most ``most_hot`` of them, so
their ranks are broadcast. All others are small and take the built-in percentile.

Nulls are left out, NaN is the largest value, null keys are equal to each other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType, IntegralType

from lacewing.functions.scalars import ordered_bits
from lacewing.ship import ship

DIGITS = (48, 32, 16, 0)


def _same(left: list[str], right: list[str]) -> Column:
    return reduce(Column.__and__, (F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)), F.lit(True))


def _order(rows: DataFrame, value: str) -> Column:
    kind = rows.schema[value].dataType
    if isinstance(kind, IntegralType):
        return F.col(value).cast("long")
    if isinstance(kind, FractionalType) and not kind.typeName().startswith("decimal"):
        return ordered_bits(F.col(value).cast("double"))
    raise ValueError(f"{value} must be a whole number, a float or a double")


def select_ranks(data: DataFrame, ranks: DataFrame, keys: list[str]) -> DataFrame:
    """``data`` (keys, _v, _o), ``ranks`` (keys as k0, k1, ...; _which, _r): the _r-th least value
    (from 0) of each group, in four passes over the data. ``ranks`` is broadcast."""
    names = [f"k{i}" for i in range(len(keys))]
    state = ranks
    for at, shift in enumerate(DIGITS):
        here = _same(keys, names)
        if at:
            here = here & (F.shiftright("_o", DIGITS[at - 1]) == F.col("_prefix"))
        found = data.join(F.broadcast(state.drop("_v")), here)
        counted = found.groupBy(*names, "_which", "_r", F.shiftright("_o", shift).alias("_next")).agg(F.count("*").alias("_n"), F.min("_v").alias("_v"))
        upto = F.sum("_n").over(W.partitionBy(*names, "_which").orderBy("_next"))
        placed = counted.withColumn("_c", upto).where("_r < _c AND _r >= _c - _n")
        state = placed.select(*names, "_which", F.expr("_r - (_c - _n)").alias("_r"), F.col("_next").alias("_prefix"), "_v")
    return state.select(*(F.col(n).alias(k) for n, k in zip(names, keys)), "_which", "_v")


def exact_medians(rows: DataFrame, keys: list[str], value: str, name: str = "median", upper: bool = False, limit: int = 1_000_000, most_hot: int = 100_000) -> DataFrame:
    """(keys, median double) of each group. ``upper``: element n // 2 of the sorted values and 0
    for none; else the mean of the two middle ones, null for none. Groups of over ``limit`` values
    and over a ``most_hot``-th of all are selected by digits; a count, run here, tells whether there
    are any."""
    return several_medians(rows, keys, value, {name: upper}, limit, most_hot)


def several_medians(rows: DataFrame, keys: list[str], value: str, names: dict[str, bool], limit: int = 1_000_000, most_hot: int = 100_000) -> DataFrame:
    """As ``exact_medians``, with a column for each of ``names`` ({name: upper}): all of them are
    selected in the same passes. The large groups' counts come to the driver, ``most_hot`` at most."""
    spark = rows.sparkSession
    ship(spark)
    data = rows.select(*keys, F.col(value).alias("_v"), _order(rows, value).alias("_o"))
    counts = data.groupBy(*keys).agg(F.count("_v").alias("_n"))
    total = F.broadcast(counts.agg(F.sum("_n").alias("_all")))  # one row
    mid = [f"k{i}" for i in range(len(keys))]
    large = counts.crossJoin(total).where((F.col("_n") > limit) & (F.col("_n") * most_hot > F.col("_all")))
    large = large.select(*(F.col(k).alias(n) for k, n in zip(keys, mid)), "_n")
    plain = {True: "coalesce(CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY _v DESC) AS DOUBLE), 0.0D)", False: "CAST(percentile(_v, 0.5D) AS DOUBLE)"}
    plain = [F.expr(plain[upper]).alias(n) for n, upper in names.items()]
    found = large.collect()
    if not found:
        return data.groupBy(*keys).agg(*plain)
    large = spark.createDataFrame(found, large.schema)
    wanted = F.array(F.expr("_n div 2")) if all(names.values()) else F.array_distinct(F.array(F.expr("(_n - 1) div 2"), F.expr("_n div 2")))
    ranks = large.select(*mid, F.posexplode(wanted).alias("_which", "_r"))
    middle = select_ranks(data.where("_v IS NOT NULL"), ranks, keys).groupBy(*keys)
    # Halves are added, as of two values; of one, its half is taken twice.
    mean = F.sum(F.col("_v").cast("double") * 0.5) * F.when(F.count("*") > 1, 1.0).otherwise(2.0)
    hot = middle.agg(*((F.max_by(F.col("_v").cast("double"), "_which") if upper else mean).alias(n) for n, upper in names.items()))
    rest = data.join(F.broadcast(large.select(*mid)), _same(keys, mid), "left_anti").groupBy(*keys)
    return hot.union(rest.agg(*plain))
