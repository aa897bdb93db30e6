"""Tables that are folders of part files, as larger ones are."""

import os

import pytest

from __spark_entry__ import queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("files", [1, 3])
def test_stream_search_reads_a_folder_of_files(spark, tmp_path, files):
    spark.read.parquet(f"{SF_DIR}/embeddings.parquet").repartition(files).write.parquet(str(tmp_path / "embeddings.parquet"))
    for name in ("documents", "labels"):  # other tables beside it are not read
        os.symlink(f"{SF_DIR}/{name}.parquet", tmp_path / f"{name}.parquet")
    stream = queries()["stream_search"]
    expected = sorted(map(tuple, stream(spark, SF_DIR).collect()))
    assert len(expected) == 5000
    assert sorted(map(tuple, stream(spark, str(tmp_path)).collect())) == expected
