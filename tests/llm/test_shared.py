import os

import pytest

from lacewing.llm import _shared


def test_names_without_scheme_are_those_that_spark_opens(spark, tmp_path):
    assert _shared.qualified(spark, "file:///a/b") == "file:///a/b"
    assert _shared.qualified(spark, f"{tmp_path}/x") == f"file://{tmp_path}/x"
    assert _shared.qualified(spark, "file:/a/b") == "file:///a/b"
    assert _shared.qualified(spark, "some/folder") == f"file://{os.getcwd()}/some/folder"
    assert _shared.qualified(spark, "s3a://bucket/x") == "s3a://bucket/x"
    _, path = _shared.filesystem(_shared.qualified(spark, f"{tmp_path}/x"))
    assert path == f"{tmp_path}/x"


def test_a_folder_that_arrow_cannot_open_is_an_error_at_once(spark, monkeypatch):
    monkeypatch.setattr(_shared, "shared_dir", lambda spark: "dbfs:/folder")
    mark = _shared.written()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        _shared.shared_files(spark, "x")
    assert _shared.written() == mark
