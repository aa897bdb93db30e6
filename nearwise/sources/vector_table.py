"""Vector tables: plain Parquet, one row per vector, scanned exactly."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from nearwise.functions.vectors import l2_norm
from nearwise.session import folders, is_complete, matching, publish_text, read_text, remove

VECTOR_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("facet", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("norm", T.DoubleType()),
    ]
)


class UnfinishedTable(ValueError):
    """A table whose writer did not get to its end."""


def with_norm(vectors: DataFrame) -> DataFrame:
    """Vectors in the table's layout: single precision elements and their length.

    The length stands for a second, scaled copy: readers divide by it for unit vectors, and can find empty or outlying
    vectors from one column. Searches take the length of what they multiply from the elements themselves.
    """
    facet = F.col("facet") if "facet" in vectors.columns else F.lit(None).cast("string").alias("facet")
    stored = vectors.select("doc_id", facet, F.col("embedding").cast("array<float>").alias("embedding"))
    return stored.withColumn("norm", l2_norm("embedding"))


def write_vectors(
    vectors: DataFrame, path: str, mode: str = "errorifexists", partition_by_facet: bool = False
) -> None:
    """Store a vector table. Partitioned by facet, a filter on the facet reads only its files.

    Rows go to a folder of their own, which a manifest then names (see :func:`load_vectors`). ``mode`` is
    ``errorifexists`` or ``overwrite``; the folders of a table that was replaced stay until :func:`drop_unnamed`.
    """
    if mode not in ("errorifexists", "overwrite"):
        raise ValueError(f"unknown mode: {mode}")
    version, _ = _latest(vectors.sparkSession, path)
    if version and mode == "errorifexists":
        raise TableChanged(f"there is a table at {path}")
    _commit(with_norm(vectors), path, version, [], partition_by_facet)


class TableChanged(ValueError):
    """Somebody else has written the table meanwhile, or before."""


def _commit(rows: DataFrame, path: str, version: int, kept: list[str], by_facet: bool) -> None:
    """Write rows, then name their folder beside the ``kept`` ones in the manifest that follows ``version``.

    Readers see all of it or nothing: until its manifest is in place, a folder does not belong to the table.
    """
    folder = f"rows={uuid.uuid4().hex}"
    writer = rows.write.partitionBy("facet") if by_facet else rows.write
    writer.parquet(f"{path}/{folder}")
    named = json.dumps({"folders": [*kept, folder], "by_facet": by_facet})
    if not publish_text(rows.sparkSession, f"{path}/{MANIFESTS}/{version + 1:010d}.json", named):
        raise TableChanged(f"the table at {path} was written by another job meanwhile")


#: Beside the rows' folders: one small file for each version of the table, which lists the folders that make it up.
MANIFESTS = "_manifests"


def _latest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """Number and content of the newest manifest; 0 without any."""
    found = matching(spark, f"{path}/{MANIFESTS}/*.json")
    if not found:
        return 0, {"folders": [], "by_facet": False}
    return int(os.path.basename(found[-1]).removesuffix(".json")), json.loads(read_text(spark, found[-1]))


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Open a vector table: the folders that its newest manifest names, and nothing else that may lie beside them.

    A missing path is an error, and so is one without a manifest, whose writer did not get to its end.
    """
    version, named = _latest(spark, path)
    if not version:
        spark.read.schema(VECTOR_SCHEMA).parquet(path)  # raises when there is no such path
        raise UnfinishedTable(f"the table at {path} was not written to its end")
    rows = spark.read.schema(VECTOR_SCHEMA).option("basePath", path).parquet(*(f"{path}/{folder}" for folder in named["folders"]))
    return rows.select(*VECTOR_SCHEMA.names)


def ensure_vectors(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], partition_by_facet: bool = False
) -> DataFrame:
    """Open the vector table at ``path``; when it has no manifest yet, build and write it first."""
    if not _latest(spark, path)[0]:
        write_vectors(build(), path, partition_by_facet=partition_by_facet)
    return load_vectors(spark, path)


def ensure_table(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Open the table at ``path``, building and writing it first when there is none or an unfinished one.

    A folder with data whose writer left neither its mark nor a trace of work is an error, as is any other failure to
    read; neither is answered with a rebuild.
    """
    try:
        found = spark.read.parquet(path)
        if is_complete(spark, path):
            return found
        if not folders(spark, f"{path}/_temporary"):
            raise UnfinishedTable(f"the table at {path} has no mark of its writer")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND" and not folders(spark, f"{path}/_temporary"):
            raise
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def append_vectors(vectors: DataFrame, path: str) -> None:
    """Add the vectors whose key the table does not have yet, so that a repeated append adds nothing.

    Only the key column of the stored table is read for the check. Of equal keys within ``vectors`` the
    greatest row is kept; they are combined before the shuffle, which also serves the join. No key is a key like others:
    a table holds one row without. The rows are laid out as the table is, by facet or not. An append that fails on the way
    leaves the table as it was; of two at the same time one fails with :class:`TableChanged` and can be repeated.
    """
    spark = vectors.sparkSession
    version, named = _latest(spark, path)
    stored = load_vectors(spark, path).select(F.col("doc_id").alias("stored_id"))
    single = with_norm(vectors).groupBy("doc_id").agg(F.max(F.struct("embedding", "facet", "norm")).alias("row"))
    columns = [F.col(f"row.{name}") for name in ("facet", "embedding", "norm")]
    fresh = single.join(stored, F.col("doc_id").eqNullSafe(F.col("stored_id")), "left_anti")
    _commit(fresh.select("doc_id", *columns), path, version, named["folders"], named["by_facet"])


def drop_unnamed(spark: SparkSession, path: str) -> None:
    """Remove older manifests and all rows that the newest does not name; no reader or writer may be at work."""
    version, named = _latest(spark, path)
    kept = {*named["folders"], f"{version:010d}.json"}
    for found in matching(spark, f"{path}/rows=*") + matching(spark, f"{path}/{MANIFESTS}/*"):
        if os.path.basename(found) not in kept:
            remove(spark, found)
