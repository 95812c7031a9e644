"""Benchmark logs, tables and profiler notebooks as DataFrames."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SWEEP = "kernel STRING, m INT, k INT, n INT, nnz BIGINT, time_ms DOUBLE, gflops DOUBLE"
ROOFLINE = "kernel STRING, m INT, nnz BIGINT, gflops DOUBLE, pct_dram_bw DOUBLE, pct_roofline DOUBLE"
PROFILES = "kernel STRING, m INT, nnz BIGINT, dram_pct DOUBLE, l1tex_pct DOUBLE, sm_pct DOUBLE"

# The header of a bundled profile, and a profile's lines.
BUNDLE = r"={10}\s+(\S+\.txt)\s+={10}"
MARKER = "GPU Speed Of Light"
PERCENTS = {
    "mem_pct": "Memory Throughput",
    "dram_pct": "DRAM Throughput",
    "l1tex_pct": "L1/TEX Cache Throughput",
    "l2_pct": "L2 Cache Throughput",
    "sm_pct": "Compute (SM) Throughput",
}
DURATION = r"Duration\s+(us|ms)\s+([\d.,]+)"


def _typed(schema: str) -> list[tuple[str, str]]:
    return [tuple(f.split()) for f in schema.split(", ")]


def _part(parts: Column, name: str, kind: str) -> Column:
    """The value of the last ``name=value`` among a line's parts."""
    found = F.filter(parts, lambda x: x.startswith(f"{name}="))
    return F.substring(F.try_element_at(found, F.lit(-1)), len(name) + 2, 1 << 20).try_cast(kind)


def _field(line: Column, name: str, kind: str) -> Column:
    """The value of the last ``name=value`` among a line's parts between blanks."""
    return _part(F.split(line, r"\s+"), name, kind)


def parse_lines(lines: DataFrame) -> DataFrame:
    """Result lines of a column ``value``, trimmed: fields in any order, the last of a name
    counts, density may be absent. Other lines and lines that lack a number are left out."""
    # Rows of one-element arrays: a filter on what a generator gives is not pushed below it, where Spark
    # would make the line and split it again for each condition.
    parts = lines.select(F.explode(F.array(F.split(F.btrim("value", F.lit(" \t\n\x0b\f\r")), r"\s+"))).alias("parts"))
    kinds = [*_typed(SWEEP)[:5], ("density", "DOUBLE"), *_typed(SWEEP)[5:]]
    fields = F.struct(*(_part(F.col("parts"), k, kind).alias(k) for k, kind in kinds))
    rows = parts.where(F.get("parts", F.lit(0)).startswith("kernel=")).select(F.inline(F.array(fields)))
    return rows.where("kernel <> ''").dropna(subset=["m", "k", "n", "nnz", "time_ms", "gflops"])


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path))


def _by_name(spark: SparkSession, path: str, kinds) -> DataFrame:
    """Columns of a CSV table by the names in its header, in any order; null where the table
    lacks them or the text is no such number."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    missing = F.lit(None).cast("string")
    return raw.select(*((F.col(f"`{k}`") if k in raw.columns else missing).try_cast(kind).alias(k) for k, kind in kinds))


def read_table(spark: SparkSession, path: str, schema: str = SWEEP, required=("m", "nnz", "time_ms", "gflops")) -> DataFrame:
    """A CSV table with a header; rows without every required number are left out."""
    return _by_name(spark, path, _typed(schema)).dropna(subset=[c for c, _ in _typed(schema) if c in required])


def read_roofline(spark: SparkSession, path: str) -> DataFrame:
    """A table of rows under the roof; those that lack a kernel or a number are left out."""
    return read_table(spark, path, ROOFLINE, tuple(c for c, _ in _typed(ROOFLINE)))


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """A profile table: rows with kernel and all numbers, the first of each (kernel, m, nnz)."""
    from lacewing.operators.analytics import keep_first

    rows = _by_name(spark, path, _typed(PROFILES)).where("kernel <> ''").dropna().withColumn("_at", F.monotonically_increasing_id())
    return keep_first(rows, ["kernel", "m", "nnz"], "_at").drop("_at")


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """(pattern, kernel, m, nnz, gflops, seq) of a CSV table or of a log: a name that ends in
    .csv is a table unless its first 200 characters hold a result line. Rows that lack a
    number are left out; a missing pattern is uniform; seq tells the order of rows."""
    head = "\n".join(r["value"] for r in spark.read.text(path).head(200))[:200]
    if path.endswith(".csv") and "kernel=" not in head:
        kinds = [("pattern", "STRING"), ("kernel", "STRING"), ("m", "INT"), ("nnz", "BIGINT"), ("gflops", "DOUBLE")]
        rows = with_pattern(_by_name(spark, path, kinds).dropna(subset=["kernel", "m", "nnz", "gflops"]))
    else:
        text = spark.read.text(path)
        rows = with_pattern(parse_lines(text).select("kernel", "m", "nnz", "gflops")).select("pattern", "kernel", "m", "nnz", "gflops")
    return rows.withColumn("seq", F.monotonically_increasing_id())


def with_pattern(rows: DataFrame) -> DataFrame:
    """A missing pattern is uniform."""
    pattern = F.coalesce(F.nullif(F.col("pattern"), F.lit("")), F.lit("uniform")) if "pattern" in rows.columns else F.lit("uniform")
    return rows.withColumn("pattern", pattern)


def result_line(kernel: str = "kernel", errors: bool = False) -> Column:
    """A line as the log has them; density of square and other matrices from nnz, m and k."""
    text = "kernel=%s m=%d k=%d n=%d nnz=%d density=%.6f time_ms=%.4f gflops=%.2f"
    density = F.col("nnz") / (F.col("m").cast("double") * F.col("k"))
    columns = [kernel, "m", "k", "n", "nnz", density, "time_ms", "gflops"]
    if errors:
        text += " max_abs_err=%.6e max_rel_err=%.6e rel_l2_err=%.6e"
        columns += ["max_abs", "max_rel", "rel_l2"]
    return F.format_string(text, *columns)


def sections(text: DataFrame, marker: str) -> DataFrame:
    """(name, body) of the parts of ``value`` under ====== name ====== headers that hold a
    marker."""
    parts = F.split("value", r"(?m)^====== ")
    one = text.select(F.posexplode(parts).alias("at", "part")).where("at > 0")
    cut = F.split("part", " ======\\n?", 2)
    return one.select(F.get(cut, F.lit(0)).alias("name"), F.get(cut, F.lit(1)).alias("body")).where(F.col("body").contains(marker))


def read_notebook(spark: SparkSession, path: str) -> DataFrame:
    """(cell, source, text) of a notebook's code cells: source, and output as text or, where an
    output has none, as plain-text data."""
    output = "STRUCT<text: STRING, data: STRUCT<`text/plain`: STRING>>"
    rows = spark.read.json(path, multiLine=True, schema=f"cells ARRAY<STRUCT<cell_type: STRING, source: STRING, outputs: ARRAY<{output}>>>")
    cells = rows.select(F.posexplode("cells").alias("cell", "c")).where("c.cell_type = 'code'")
    as_list = lambda x: F.when(x.startswith("["), F.concat_ws("", F.from_json(x, "array<string>"))).otherwise(x)
    one = lambda o: F.coalesce(as_list(o["text"]), as_list(o["data"]["text/plain"]), F.lit(""))
    outputs = F.transform(F.coalesce("c.outputs", F.array().cast(f"array<{output}>")), one)
    return cells.select("cell", F.coalesce(as_list(F.col("c.source")), F.lit("")).alias("source"), F.concat_ws("", outputs).alias("text"))


def profiles(cells: DataFrame) -> DataFrame:
    """Metrics of the profiles in cells (cell, source, text): a row for each text, or each
    bundled part of one, that holds the profiler's marker. Percentages, duration in ms, and
    the numbers of the first result line; the first of rows with equal metrics stays."""
    from lacewing.operators.analytics import keep_first, profile_numbers

    names, bodies = F.regexp_extract_all("text", F.lit(BUNDLE), F.lit(1)), F.split("text", BUNDLE)
    bundled = F.arrays_zip(names.alias("name"), F.slice(bodies, 2, F.greatest(F.size(names), F.lit(1))).alias("body"))
    alone = F.array(F.struct(F.lit(None).cast("string").alias("name"), F.col("text").alias("body")))
    parts = cells.select("cell", "source", F.posexplode(F.when(F.size(names) > 0, bundled).otherwise(alone)).alias("at", "p"))
    parts = parts.where(F.col("p.body").contains(MARKER))
    found = lambda pattern, k, kind: F.nullif(F.regexp_extract("p.body", pattern, k), F.lit("")).try_cast(kind)
    label = F.substring(F.trim(F.regexp_replace(F.regexp_extract(F.trim("source"), r"^([^\n]*)", 1), r"^[# ]+", "")), 1, 70)
    ms = F.regexp_replace(found(DURATION, 2, "string"), ",", "").try_cast("double")
    numbers = (("kernel", "string"), ("m", "int"), ("k", "int"), ("n", "int"), ("nnz", "bigint"), ("density", "double"), ("time_ms", "double"), ("gflops", "double"))
    told = F.transform(F.split("p.body", "\n"), lambda x: F.struct(*(_field(x, k, kind).alias(k) for k, kind in numbers)))
    whole = F.filter(told, lambda r: reduce(Column.__and__, (r[k].isNotNull() for k, _ in numbers)) & r["kernel"].rlike(r"^\w+$"))
    result = F.try_element_at(whole, F.lit(1))
    rows = parts.select(
        "cell", "at", F.coalesce("p.name", label).alias("source"), *(result[k].alias(k) for k, _ in numbers[:5]),
        *(found(re.sub(r"([()/])", r"\\\1", text) + r"\s+%\s+([\d.]+)", 1, "double").alias(k) for k, text in PERCENTS.items()),
        (ms / F.when(found(DURATION, 1, "string") == "us", 1000.0).otherwise(1.0)).alias("duration_ms"),
    )
    rows = keep_first(rows, ["dram_pct", "l1tex_pct", "l2_pct", "duration_ms"], ["cell", "at"]).drop("at")
    return profile_numbers(rows)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)
