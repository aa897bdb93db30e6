"""Library queries on executors that are processes of their own, with a checkpoint folder that is named without a scheme."""

import os
import subprocess
import sys

import pytest
from conftest import ROOT
from oracle_check import connect, mismatch

from __spark_entry__ import oracle_sql
from nearwise.session import fresh_path, shared_dir

SF_DIR = "/root/testdata/sf0.001"
STORING = (
    "compare_aligned", "compare_metrics", "compare_names", "display_rows", "embed_tfidf", "embed_tfidf_rare_terms", "facet_detect_passages",
    "knn_cosine", "knn_l2", "knn_l2_block", "knn_materialize", "knn_single", "knn_small_vectors", "records_csv", "resource_shared",
    "search_bucketed", "search_fallback", "search_filtered", "search_order_reference", "search_prefilter", "search_prefilter_fallback",
    "search_text_compare", "search_text_l2", "search_text_stored",
)
CODE = """
import sys, traceback
from pyspark.sql import SparkSession
from __spark_entry__ import queries
folder, sf_dir, *names = sys.argv[1:]
conf = {
    "spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "700m", "spark.driver.host": "127.0.0.1", "spark.ui.enabled": "false",
    "spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": folder + "/shared", "spark.sql.warehouse.dir": folder + "/warehouse",
}
spark = SparkSession.builder.config(map=conf).getOrCreate()
for name in names:
    try:
        queries()[name](spark, sf_dir).write.parquet("file:" + folder + "/out/" + name)
    except Exception:
        traceback.print_exc()
spark.stop()
"""


@pytest.fixture(scope="module")
def out(tmp_path_factory):
    """The folder of what the queries returned on a cluster, and what it said."""
    folder, home = tmp_path_factory.mktemp("cluster"), tmp_path_factory.mktemp("home")
    import pyspark

    for name in os.listdir(os.path.dirname(pyspark.__file__)):
        if name != "work":  # the executors' folders lie in Spark's home
            os.symlink(os.path.join(os.path.dirname(pyspark.__file__), name), home / name)
    env = os.environ | {"PYTHONPATH": ROOT, "SPARK_HOME": str(home), "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13", "PYSPARK_PYTHON": sys.executable}
    for key in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET"):
        env.pop(key, None)
    done = subprocess.run([sys.executable, "-c", CODE, folder, SF_DIR, *STORING], env=env, cwd=folder, capture_output=True, text=True, timeout=600)
    return folder / "out", done.stderr[-3000:]


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", STORING)
def test_query_on_a_cluster_equals_sql(spark, con, out, name):
    folder, said = out
    assert os.path.exists(folder / name / "_SUCCESS"), said
    assert mismatch(spark.read.parquet(str(folder / name)), oracle_sql()[name], con) is None


class Cluster:
    """A session that says it is one of a cluster, with these settings."""

    def __init__(self, spark, settings, rows=None):
        self.spark, self.conf, self.rows = spark, settings, rows
        self.sparkContext = self
        self.master, self.applicationId, self.defaultParallelism = "yarn", str(id(self)), 3

    def getCheckpointDir(self):
        return None

    def range(self, start, end, step, parts):
        return self.spark.range(start, end if self.rows is None else self.rows, step, parts)

    def __getattr__(self, name):
        return getattr(self.spark, name)


def test_shared_folder_without_a_scheme_and_in_the_warehouse(spark, tmp_path):
    plain = Cluster(spark, {"spark.checkpoint.dir": f"{tmp_path}/plain/"})
    assert shared_dir(plain) == f"file:{tmp_path}/plain" and fresh_path(plain, "x").startswith(f"file:{tmp_path}/plain/x-")
    housed = Cluster(spark, {"spark.sql.warehouse.dir": f"file:{tmp_path}/warehouse"})
    assert shared_dir(housed) == f"file:{tmp_path}/warehouse/nearwise-working"
    assert [name for _, _, names in os.walk(tmp_path) for name in names] == []


def test_folder_in_which_rows_get_lost_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):  # two of three rows come back
        shared_dir(Cluster(spark, {"spark.checkpoint.dir": str(tmp_path)}, rows=2))
