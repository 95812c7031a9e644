"""The corpus pipeline: five stages, each written as Parquet and read again as the next
one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lacewing.llm import pipeline_stages as stages
from lacewing.llm._shared import documents, materialize, release_since, written

STAGES = [
    ("quality_classifier", stages.keep_quality),
    ("simhash_near_dedup", stages.drop_near_copies),
    ("substring_dedup", stages.cut_repeats),
    ("mixing", stages.mix_sources),
    ("best_fit_packing", stages.pack_sequences),
]

#: No stage but mixing can be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result. What a stage wrote is deleted once the next stage's
    documents are written."""
    docs, mark = documents(spark, sf_dir), written()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        release_since(spark, mark, keep=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
