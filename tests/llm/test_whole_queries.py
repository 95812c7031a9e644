"""Every registered query and the pipeline on empty tables and on tables of awkward rows."""

import os
import shutil

import pytest

import corpus_pipeline
from lacewing.llm._shared import release_since, shared_dir, written
from lacewing.llm.queries import QUERIES

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, folder, documents, labels, vectors):
    spark.createDataFrame(documents, DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    return write(spark, str(tmp_path_factory.mktemp("empty")), [], [], [])


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    """Nulls in every column, no word anywhere, and copies."""
    rows = [(None, None, None, None, None), (1, None, None, "a", 0), (1, "", "en", "a", 0), (2, " \n\t", None, None, 3), (2, " \n\t", None, None, 3)]
    return write(spark, str(tmp_path_factory.mktemp("odd")), rows, [(None, None, None), (1, 1, 0), (2, None, None)], [(None, None, None), (1, [0.0, 0.0], 1)])


ALL = {**QUERIES, "pipeline": corpus_pipeline.run}


@pytest.mark.parametrize("name", sorted(ALL))
def test_empty_tables_give_no_rows(spark, empty_dir, sf_dir, name):
    found = ALL[name](spark, empty_dir)
    assert found.collect() == []


@pytest.mark.parametrize("name", sorted(ALL))
def test_rows_without_words_or_ids(spark, odd_dir, name):
    found = ALL[name](spark, odd_dir).collect()
    want = {"op5_embedding_dedup": 2, "op12_vector_codes": 0, "op13_centroid_clustering": 0}.get(name, 5)
    assert len(found) == want or name == "pipeline"


def test_no_intermediate_table_stays_after_release(spark, odd_dir):
    release_since(spark)
    folder = shared_dir(spark).removeprefix("file://") + "/lacewing"
    shutil.rmtree(folder, ignore_errors=True)
    mark = written()
    for name in sorted(ALL):
        ALL[name](spark, odd_dir).collect()
    release_since(spark, mark)
    left = [x for x in os.listdir(folder) if not x.startswith("token-files")]
    assert left == [] and written() == mark
