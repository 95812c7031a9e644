"""The stages of the corpus pipeline; each returns the columns of documents, but for packing.

Production parameters: quality threshold 0.3; near copies at 5-word shingles and a
similarity of 0.8; repeated windows of 35 words; a source's weight is its size to the power
0.7, the budget all words that came, at most 3 epochs; sequences of 2048 ids.

Defined cases of every stage: an empty table gives an empty one, with the same columns; null
or empty texts are documents like others (the classifier scores them, they are near copies
of each other, have no words to cut or mix, and pack as an end id); null ids and sources keep
their rows; repeated rows are one document for near-dedup and count each elsewhere; columns
beyond those of documents are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import mixing, packing, quality_classifier, simhash, substring_dedup
from ._shared import drop_shuffles

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on these documents' labels, doesn't reject."""
    docs = docs.select(*COLUMNS)
    model, _ = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.score(docs, model).where("predicted = 1").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    drop_shuffles(spark)
    return simhash.drop_near_duplicates(docs.select(*COLUMNS), width=5, similarity=0.8)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated windows; a document of which no word is left goes."""
    drop_shuffles(spark)
    found = substring_dedup.remove_repeats(docs.select(*COLUMNS), 35).where("n_removed < n_words OR n_words = 0")
    cut = F.col("n_removed") > 0
    return found.select(
        "doc_id", F.col("kept").alias("text"), "lang", "source",
        F.when(cut, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def powers(sizes: list[int]) -> list[float]:
    return [float(s) ** 0.7 or 1.0 for s in sizes]


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix; one that is taken in several epochs comes as often."""
    drop_shuffles(spark)
    docs = docs.select(*COLUMNS)
    taken, known = mixing.mix(docs, weights=powers, most_epochs=3)
    times, uneven = mixing.repeats(taken, known)
    times = times.select(*(F.col(c).alias(f"t_{c}") for c in ("doc_id", "shuffle", "source")), "times")
    keyed = docs.withColumn("shuffle", mixing.shuffle_key())
    same = F.col("shuffle") == F.col("t_shuffle")
    for c in ("doc_id", "source"):
        same = same & F.col(c).eqNullSafe(F.col(f"t_{c}"))
    again = keyed.join(times.where("times > 0"), same).withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times").cast("long"))))
    out = again.select(*COLUMNS)
    if uneven:  # at most one group of copies of each source
        few = F.broadcast(spark.createDataFrame([tuple(r) for r in uneven], "t_doc_id long, t_shuffle long, t_source string, more long"))
        which = W.partitionBy("doc_id", "shuffle", "source").orderBy("lang", "n_chars")
        out = out.union(keyed.join(few, same).withColumn("k", F.row_number().over(which)).where("k <= more").select(*COLUMNS))
    return out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    drop_shuffles(spark)
    import public_tokenizers

    return packing.pack_documents(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), cache=1_000_000)
