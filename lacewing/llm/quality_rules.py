"""Quality rules as a bitmask ledger, in DataFrame functions alone.

Every rule is evaluated once; a document's ledger row holds the measurements and one long
whose bit k says that rule k failed. Policies are versioned masks over those bits: applying
one is a bitwise and, and the effect of leaving out each rule (its ablation) is one
aggregate over the masks. No text is read again for either.

Repeated words: 5-word windows are hashed in order, and only a text whose hashes are not
distinct has them sorted with their positions to find the covered words. Windows of a text
are held equal if their 64-bit hashes are.

Defined cases: a null or empty text has 0 words and fails ``few_words``; repeated rows and
null ids give a row each; an empty table gives none; other columns are ignored. Lengths are
in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import documents, words

#: Rules in bit order: each is true for a document that fails it. New rules are appended, so
#: that the bits of stored ledgers keep their meaning.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "many_symbols": "10 * n_symbols > word_chars",
    "many_duplicate_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
    "many_marks": "10 * n_marks > word_chars",
    "few_letters": "10 * n_letters < 6 * word_chars",
    "all_capitals": "n_words >= 10 AND 10 * n_capitals > 7 * n_letters",
}

#: Versioned policies: the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "many_symbols", "many_duplicate_lines"),
    "v2": tuple(RULES),
}


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(policy: str) -> int:
    return sum(bit(r) for r in POLICIES[policy])


def _windows(w: Column, width: int = 5) -> Column:
    """Hash of each run of ``width`` words, in order."""
    n = F.size(w) - (width - 1)
    parts = lambda i: [F.get(w, i + k) for k in range(width)]
    return F.when(n >= 1, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*parts(i)))).otherwise(
        F.array().cast("array<bigint>")
    )


def _covered(h: Column, width: int = 5) -> Column:
    """Words in windows whose hash occurs twice or more in ``h``."""
    placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    twice = lambda s: F.filter(s, lambda x, k: same(F.get(s, k - 1), x) | same(F.get(s, k + 1), x))
    starts = lambda s: F.array_sort(F.transform(twice(s), lambda x: x["i"]))
    held = F.transform(F.array(placed), lambda s: starts(s))[0]
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    add = lambda acc, i: F.struct(
        (acc["n"] + width - F.greatest(acc["end"] - i, F.lit(0))).cast("long").alias("n"), (i + width).alias("end")
    )
    return F.aggregate(held, start, add, lambda acc: acc["n"])


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements that the rules use, one row for each document."""
    text = F.coalesce("text", F.lit(""))
    gone = lambda c, pattern: F.length(c) - F.length(F.regexp_replace(c, pattern, ""))
    lines = F.filter(F.split("t", "\n"), lambda s: F.rlike(s, F.lit(r"[^\x20\x09-\x0D]")))
    first = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t")).select(
        "doc_id",
        words(F.col("t")).alias("w"),
        F.regexp_replace("t", r"[\x20\x09-\x0D]+", "").alias("c"),
        lines.alias("l"),
    )
    second = first.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length("c").cast("long").alias("word_chars"),
        gone(F.col("c"), r"[#*$%&|<>]+").cast("long").alias("n_symbols"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        gone(F.col("c"), r"[!?;:=_~^+/\\]+").cast("long").alias("n_marks"),
        gone(F.col("c"), r"\p{L}+").cast("long").alias("n_letters"),
        gone(F.col("c"), r"\p{Lu}+").cast("long").alias("n_capitals"),
        _windows(F.col("w")).alias("h"),
    )
    repeats = F.when(F.size(F.array_distinct("h")) < F.size("h"), _covered(F.col("h"))).otherwise(F.lit(0)).cast("long")
    return second.withColumn("n_repeat_words", repeats).drop("h")


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and ``failures``, the bitmask of the rules that a document fails."""
    failed = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, rule in enumerate(RULES.values())]
    total = failed[0]
    for f in failed[1:]:
        total = total.bitwiseOR(f)
    return measure(docs).withColumn("failures", total)


def apply_policy(rows: DataFrame, policy: str) -> DataFrame:
    """Adds ``kept``: no rule of the policy failed."""
    return rows.withColumn("kept", F.col("failures").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0)


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents that fail it, those that it alone rejects, and
    those kept without it. One aggregate of map-side-combined counts over the masks."""
    m = mask(policy)
    hit = F.col("failures").bitwiseAND(F.lit(m).cast("long"))
    by_mask = rows.groupBy(hit.alias("hit")).agg(F.count("*").alias("n"))
    rules = [F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).cast("long").alias("b")) for r in POLICIES[policy]]
    each = by_mask.select("hit", "n", F.explode(F.array(*rules)).alias("r")).select("hit", "n", "r.rule", "r.b")
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy("rule").agg(
        some(F.col("hit").bitwiseAND(F.col("b")) != 0).alias("n_failed"),
        some(F.col("hit") == F.col("b")).alias("n_failed_alone"),
        some((F.col("hit") == 0) | (F.col("hit") == F.col("b"))).alias("n_kept_without"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(documents(spark, sf_dir)), "v2")
    base = F.col("failures").bitwiseAND(F.lit(mask("base")).cast("long")) != 0
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failures"
    )


#: The ledger of policy v2, windows compared as texts.
OP8_SQL = r"""
WITH read AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t FROM documents
), cut AS (
  SELECT row_id, doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g') AS c,
         list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS l
  FROM read
), placed AS (
  SELECT row_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i, len(w) AS n_words FROM cut
), spans AS (
  SELECT row_id, i, i + 4 <= n_words AS full_width,
         string_agg(word, ' ') OVER (PARTITION BY row_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS span
  FROM placed
), windows AS (
  SELECT row_id, i, count(*) OVER (PARTITION BY row_id, span) AS n FROM spans WHERE full_width
), covered AS (
  SELECT row_id, least(5, lead(i, 1, i + 5) OVER (PARTITION BY row_id ORDER BY i) - i) AS words FROM windows WHERE n > 1
), repeated AS (
  SELECT row_id, sum(words)::BIGINT AS n_repeat_words FROM covered GROUP BY row_id
), measured AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(c)::BIGINT AS word_chars,
         (length(c) - length(regexp_replace(c, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         length(c) - length(regexp_replace(c, '[!?;:=_~^+/\\]+', '', 'g')) AS n_marks,
         length(c) - length(regexp_replace(c, '\p{L}+', '', 'g')) AS n_letters,
         length(c) - length(regexp_replace(c, '\p{Lu}+', '', 'g')) AS n_capitals,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM cut LEFT JOIN repeated USING (row_id)
), ruled AS (
  SELECT *, ({bits})::BIGINT AS failures FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       failures & 3 <> 0 AS base_failed, failures = 0 AS kept, failures
FROM ruled
""".replace("{bits}", " + ".join(f"CASE WHEN {rule} THEN {bit(name)} ELSE 0 END" for name, rule in RULES.items()))
