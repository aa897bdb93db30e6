"""Session defaults and the shared working folder."""

from __future__ import annotations

import contextlib
import hashlib
import os
import tempfile
import threading
import urllib.parse
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
WAREHOUSE_CONF = "spark.sql.warehouse.dir"


def get_spark(app_name: str = "nearwise", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are designed for.

    AQE coalesces small shuffles, splits skewed joins and re-plans joins on measured sizes.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, the context's checkpoint folder, or one in the warehouse.

    A session in one process without a checkpoint folder gets a fresh temporary one. On a cluster a path without a scheme lies
    in the default file system, and without any path there is ``nearwise-working`` in the warehouse, which Spark shares anyhow.
    Either may turn out to be a machine's own folder, in which tables would lose rows without an error, so both are tried out
    first (see :func:`_tried`).
    """
    context = spark.sparkContext
    path = spark.conf.get(CHECKPOINT_CONF, None) or context.getCheckpointDir()
    alone = context.master == "local" or context.master.startswith("local[")
    if path and (alone or "://" in path or path.startswith("file:/")):
        return path.rstrip("/")
    if alone:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="nearwise-"))
        return context.getCheckpointDir()
    if not path:
        warehouse = spark.conf.get(WAREHOUSE_CONF)
        if not warehouse:
            raise ValueError(f"set {CHECKPOINT_CONF} or {WAREHOUSE_CONF} to a folder shared by all executors")
        path = f"{warehouse.rstrip('/')}/nearwise-working"
    return _tried(spark, path)


#: Folders that were tried out, by application and path: their names with scheme.
_TRIED: dict[tuple[str, str], str] = {}


def _tried(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme, once tasks on the executors have each written a row there and all were read back."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _TRIED:
        place = _hadoop_path(spark, path)
        whole = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString().rstrip("/")
        n, probe = max(2, spark.sparkContext.defaultParallelism), f"{whole}/probe-{uuid.uuid4().hex}"
        try:
            spark.range(0, n, 1, n).write.parquet(probe)
            found = spark.read.schema("id long").parquet(probe).count()
        except (Py4JJavaError, PySparkException) as error:
            raise ValueError(f"the executors can't share {whole}: set {CHECKPOINT_CONF}, with its scheme") from error
        finally:
            remove(spark, probe)
        if found != n:
            raise ValueError(f"the executors don't share {whole}: set {CHECKPOINT_CONF}, with its scheme")
        _TRIED[key] = whole
    return _TRIED[key]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other job uses; :func:`working_tables` knows it."""
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    _made().append(path)
    return path


#: The paths handed out and not removed yet: those made outside of any block, and of each thread a list for each block it is in.
_MADE: list[str] = []
_BLOCKS = threading.local()


def _made() -> list[str]:
    blocks = getattr(_BLOCKS, "open", None)
    return blocks[-1] if blocks else _MADE


@contextlib.contextmanager
def working_tables(spark: SparkSession) -> Iterator[None]:
    """Remove all working tables that this thread makes inside the block when it ends, also by an error.

    Results that are needed afterwards must be written elsewhere first: to a path of one's own, or to one from
    :func:`fresh_path` taken before the block. Blocks may be nested.
    """
    if not hasattr(_BLOCKS, "open"):
        _BLOCKS.open = []
    made: list[str] = []
    _BLOCKS.open.append(made)
    try:
        yield
    finally:
        _BLOCKS.open.pop()
        for path in made:
            remove(spark, path)


def clear_working_tables(spark: SparkSession) -> None:
    """Remove every working table made outside of blocks: at a session's end, when no result is read any more."""
    while _MADE:
        remove(spark, _MADE.pop())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table or folder, if it is there."""
    place = _hadoop_path(spark, path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Later plans start from the files: nothing upstream is computed twice, the table outlives executors,
    and Spark knows its real size when it picks a join strategy.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Resources:
    """Tables that are built once, shared by whoever opens them, and removed when the last one lets go.

    A table is known by its plan and by the version of the files that the plan reads, so opening it again after an input
    has changed builds it anew. As a context manager it lets go of everything at the end.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.held: dict[tuple, list] = {}  # plan and version: table, path, holders
        self.built = 0

    def open(self, df: DataFrame, name: str = "resource") -> tuple[tuple, DataFrame]:
        """The key of a resource, to be closed with, and its stored table."""
        key = (df.semanticHash(), input_version(df))
        if key not in self.held:
            path = fresh_path(self.spark, name)
            df.write.parquet(path)
            self.built += 1
            self.held[key] = [self.spark.read.schema(df.schema).parquet(path), path, 0]
        entry = self.held[key]
        entry[2] += 1
        return key, entry[0]

    def close(self, key: tuple) -> None:
        """Let go of a resource once; the last holder's close removes it."""
        entry = self.held[key]
        entry[2] -= 1
        if not entry[2]:
            self._remove(key)

    def __enter__(self) -> Resources:
        return self

    def __exit__(self, *_) -> None:
        for key in list(self.held):
            self._remove(key)

    def _remove(self, key: tuple) -> None:
        path = self.held.pop(key)[1]
        if path in (made := _made()):
            made.remove(path)
        remove(self.spark, path)


def input_version(df: DataFrame) -> str:
    """A digest of the names, lengths and times of the files that a plan reads."""
    digest = hashlib.sha256()
    for name in sorted(df.inputFiles()):
        place = _hadoop_path(df.sparkSession, urllib.parse.unquote(name))
        status = place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getFileStatus(place)
        digest.update(f"{name} {status.getLen()} {status.getModificationTime()}\n".encode())
    return digest.hexdigest()


def _hadoop_path(spark: SparkSession, path: str, child: str | None = None):
    kind = spark._jvm.org.apache.hadoop.fs.Path
    return kind(path) if child is None else kind(path, child)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end: its writer leaves a mark when all files are in place."""
    mark = _hadoop_path(spark, path, "_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def folders(spark: SparkSession, pattern: str) -> bool:
    """Whether any path matches a pattern."""
    return bool(matching(spark, pattern))


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that match a pattern, in order."""
    path = _hadoop_path(spark, pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(status.getPath().toString() for status in found or [])


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as text."""
    place = _hadoop_path(spark, path)
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish_text(spark: SparkSession, path: str, text: str) -> bool:
    """Make a small file appear at once and whole; false, and no change, if there is one already."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place, draft = _hadoop_path(spark, path), _hadoop_path(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    stream = draft.getFileSystem(conf).create(draft, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.getFileSystem(conf).getUri(), conf)
    keep = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    keep[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(draft, place, keep)
    except Py4JJavaError as error:
        remove(spark, draft.toString())
        if "FileAlreadyExists" not in error.java_exception.getClass().getName():
            raise
        return False
    return True
