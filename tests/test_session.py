import os
import subprocess
import sys

import pytest
from conftest import ROOT

from nearwise import session
from nearwise.session import Resources, fresh_path, materialize, shared_dir, working_tables


class Context:
    """Stands in for a Spark context."""

    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class Session:
    """Stands in for a session."""

    def __init__(self, context, settings):
        self.sparkContext, self.conf = context, settings


def test_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session(Context("yarn"), {}))
    assert shared_dir(Session(Context("yarn"), {"spark.checkpoint.dir": "hdfs:///shared/"})) == "hdfs:///shared"
    assert shared_dir(Session(Context("yarn", "hdfs:///set"), {})) == "hdfs:///set"


def test_local_session_gets_a_folder_once():
    session = Session(Context("local[2]"), {})
    assert shared_dir(session) == shared_dir(session)
    assert fresh_path(session, "x") != fresh_path(session, "x")


def test_working_tables_end_with_their_block(spark):
    folder = shared_dir(spark)
    kept = materialize(spark.range(3), "kept")
    before = set(os.listdir(folder))
    with working_tables(spark):
        assert materialize(spark.range(5), "inner").count() == 5 and set(os.listdir(folder)) != before
    assert set(os.listdir(folder)) == before and kept.count() == 3
    with pytest.raises(RuntimeError), working_tables(spark):
        materialize(spark.range(5), "inner")
        raise RuntimeError
    assert set(os.listdir(folder)) == before


def test_resources_are_built_once_and_removed_by_the_last_holder(spark, tmp_path):
    source, folder = str(tmp_path / "in"), shared_dir(spark)
    spark.range(10).write.parquet(source)
    before = set(os.listdir(folder))

    def doubled():
        return spark.read.parquet(source).selectExpr("id * 2 AS x")

    with Resources(spark) as resources:
        first, a = resources.open(doubled())
        second, b = resources.open(doubled())
        other, c = resources.open(doubled().where("x > 4"))
        assert first == second != other and resources.built == 2
        resources.close(first)
        assert b.count() == 10 and c.count() == 7
        resources.close(second)
        assert len(set(os.listdir(folder)) - before) == 1
        spark.range(10, 20).write.mode("append").parquet(source)  # another version of the input is another resource
        third, d = resources.open(doubled())
        assert third != first and d.count() == 20 and resources.built == 3
    assert set(os.listdir(folder)) == before


def test_small_files_appear_whole_and_once(spark, tmp_path):
    path = str(tmp_path / "m" / "1.json")
    assert session.publish_text(spark, path, "é") and not session.publish_text(spark, path, "other")
    assert session.read_text(spark, path) == "é"
    assert [name for name in os.listdir(tmp_path / "m") if not name.startswith(".")] == ["1.json"]


@pytest.mark.parametrize("blocked", ["zstandard", "nearwise.llm", "corpus_pipeline"])
def test_entry_without_the_optional_part(blocked):
    code = f"import sys; sys.modules[{blocked!r}] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=100)
    from nearwise.plans.table_queries import QUERIES

    assert out.stdout.split() == [str(len(QUERIES))] * 2, out.stderr
