"""Exact k-nearest-neighbour joins of a query table with a corpus table."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from nearwise.operators import scan_kernel
from nearwise.operators.topk import rank_within, top_k
from nearwise.session import fresh_path, materialize

cloudpickle.register_pickle_by_value(scan_kernel)

METRICS = ("l2", "cosine")
MAX_QUERY_BYTES = 64 << 20  # queries and result lists one task may hold, or rows of a corpus that travels
TASKS_PER_PART = 256  # scan tasks whose lists are merged together in the first merge


class Facets(NamedTuple):
    """Columns of a facet test that must hold before ranking (see :func:`knn_join`)."""

    query: Column
    corpus: Column
    always: Column


class Postfilter(NamedTuple):
    """What of a ranked list to keep (see :func:`knn_join`): ``test`` gets a carried query column and a carried corpus column."""

    query: str
    corpus: str
    test: Callable[[Column, Column], Column]
    keep: int


def knn_join(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    *,
    metrics: Sequence[str] = METRICS,
    query_vector: str = "embedding",
    corpus_vector: str = "embedding",
    query_carry: Sequence[str] = (),
    corpus_carry: Sequence[str] = (),
    prefilter: Facets | None = None,
    postfilter: Postfilter | None = None,
    digits: int | None = None,
    strategy: str = "auto",
    max_query_bytes: int = MAX_QUERY_BYTES,
) -> DataFrame:
    """The ``k`` nearest corpus rows for every query under each metric.

    ``queries`` has ``query_id`` and a vector, ``corpus`` has ``doc_id`` and a vector; both ids are BIGINT
    keys. The result has ``query_id, metric, rank, doc_id, score`` and the carried string columns. The
    score is the squared distance for ``l2`` (lower is nearer) and the similarity for ``cosine`` (higher is
    nearer), unrounded; ranks follow it, then ``doc_id``, so they do not depend on partitioning. With ``digits``
    scores are rounded to so many decimals before they are ranked, which makes ranks comparable with those of an
    engine that adds up in another order; vectors of small length then tie. Null vectors, such with an element that is not
    finite, and rows without an id match nothing; another width is an error; zero vectors match nothing under ``cosine``.
    Fewer than ``k`` rows come back only when the corpus has fewer.

    With ``prefilter`` only rows that pass the facet test are ranked, each against the queries that ask for its facet. With
    ``postfilter`` the ``k`` rows of a list are ranked first; of those that pass its test the first ``keep`` are returned, or of
    all if none passes, and ``any_match`` says whether one did.

    Queries are written to the shared folder and measured there. ``broadcast`` ships them to every task and leaves the
    corpus where it is stored. ``grid`` does so with one block of queries after the other, each as large as a task can
    hold, and writes what each block finds to the shared folder. The corpus doesn't move: what travels is queries times
    executors, and a list of ``k`` rows from every task of every block. ``corpus`` leaves the queries where they are and ships the
    corpus, in parts as large as a task can hold: a task holds its queries against one part after the other, so lists are whole
    where they are made, and only what is kept of them is written. A corpus that is more than a scan is stored first.
    ``auto`` broadcasts when queries and their lists are proven to fit in ``max_query_bytes``. Beyond, it ships the corpus when that
    is smaller than the queries with their lists, and uses the grid when it is larger or with a ``prefilter``.
    """
    unknown = set(metrics) - set(METRICS)
    if unknown:
        raise ValueError(f"unknown metrics: {sorted(unknown)}")
    if k < 1:
        raise ValueError("k must be at least 1")
    if strategy == "corpus" and prefilter:
        raise ValueError("a corpus that travels can't be filtered before ranking")
    task = scan_kernel.Task(k, tuple(metrics), digits, len(corpus_carry), prefilter is not None)
    query_facet = [F.lower(prefilter.query).alias("facet_key")] if prefilter else []
    corpus_facet = [
        F.lower(prefilter.corpus).alias("facet_key"),
        F.coalesce(prefilter.always, F.lit(False)).alias("always"),
    ] if prefilter else []
    wanted = queries.select(
        F.col("query_id").cast("long"), F.col(query_vector).alias("v"), *query_carry, *query_facet
    ).where(F.col("query_id").isNotNull())
    rows = corpus.select(
        F.col("doc_id").cast("long"), F.col(corpus_vector).alias("v"), *corpus_carry, *corpus_facet
    ).where(F.col("doc_id").isNotNull())
    wanted = materialize(wanted, "knn-queries")
    n_queries, dim = wanted.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    row_bytes = 8 * dim + len(metrics) * k * (32 + 32 * len(corpus_carry))
    n_blocks = max(1, math.ceil(n_queries * row_bytes / max_query_bytes))
    if strategy == "broadcast" and n_blocks > 1:
        raise ValueError(f"{n_queries} queries exceed the broadcast limit of {max_query_bytes} bytes")
    names = {f"q{i}": name for i, name in enumerate(query_carry)} | {f"c{i}": name for i, name in enumerate(corpus_carry)}
    if not n_queries:
        found = queries.sparkSession.createDataFrame([], _schema(task, query_carry))
    elif n_blocks == 1 and strategy in ("auto", "broadcast"):
        found = _scan(rows, wanted.toArrow(), task, query_carry)
    else:
        rows = rows if _is_scan(rows) else materialize(rows, "knn-corpus")
        stays = strategy == "grid" or prefilter or not dim
        corpus_bytes = 0 if stays else _corpus_bytes(rows, dim, corpus_carry)
        if not stays and (strategy == "corpus" or corpus_bytes <= n_queries * row_bytes):
            n_parts = max(1, math.ceil(corpus_bytes / max_query_bytes))
            distinct = wanted.agg(F.count_distinct("query_id")).first()[0] == n_queries
            shape = _Shape(names, postfilter if distinct else None)
            found = _search_in_parts(rows, wanted, task, shape, dim, n_parts, n_blocks, max_query_bytes // row_bytes)
            if distinct:
                return found.withColumnsRenamed(names)
            found = found.withColumn("part", F.lit(0))  # lists of the same id become one
        else:
            found = _scan_in_blocks(rows, wanted, task, query_carry, n_blocks)

    best = top_k(found, ["query_id", "metric"], nearest_first(), k, part="part")
    best = best.select("query_id", "metric", "rank", "doc_id", "score", *[F.col(c).alias(name) for c, name in names.items()])
    return _postfiltered(best, postfilter) if postfilter else best


def _postfiltered(ranked: DataFrame, post: Postfilter) -> DataFrame:
    """What the filter keeps of lists whose rows lie anywhere."""
    lists = ["query_id", "metric"]
    tested = ranked.withColumn("matched", post.test(F.col(post.query), F.col(post.corpus)))
    judged = tested.withColumn("any_match", F.max("matched").over(Window.partitionBy(*lists)))
    kept = judged.where(F.col("matched") | ~F.col("any_match")).drop("rank", "matched")
    return rank_within(kept, lists, nearest_first()).where(F.col("rank") <= post.keep)


class _Shape(NamedTuple):
    """The carried columns, by the names they have in lists, and what to keep of a list."""

    names: dict[str, str]
    post: Postfilter | None


def _rows_of(lists: DataFrame, shape: _Shape) -> DataFrame:
    """The rows of whole lists, or what the filter keeps of each."""
    names, post = shape
    if post:
        at = {name: c for c, name in names.items()}
        lists = lists.withColumn("matching", F.filter("hits", lambda hit: post.test(F.col(at[post.query]), hit[at[post.corpus]])))
        lists = lists.withColumn("any_match", F.size("matching") > 0)
        lists = lists.withColumn("hits", F.slice(F.when(F.col("any_match"), F.col("matching")).otherwise(F.col("hits")), 1, post.keep))
    others = [c for c in lists.columns if c not in ("hits", "matching")]
    rows = lists.select(*others, F.posexplode("hits").alias("place", "hit")).withColumn("rank", F.col("place") + 1)
    rows = rows.select(*others, "rank", "hit.*")
    return rows.select("query_id", "metric", "rank", "doc_id", "score", *names, *(["any_match"] if post else []))


def nearest_first() -> list[Column]:
    """Order of hits within one query and metric."""
    cost = F.when(F.col("metric") == "cosine", -F.col("score")).otherwise(F.col("score"))
    return [cost.asc(), F.col("doc_id").asc()]


def single_query(vector: Sequence[float], corpus: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """The ``k`` rows nearest to one vector by squared distance, nearest first: a ``knn_join`` of one query."""
    one = corpus.sparkSession.createDataFrame([(0, [float(x) for x in vector])], "query_id long, embedding array<double>")
    return knn_join(one, corpus, k, metrics=["l2"], digits=digits).select("doc_id", "score").orderBy("score", "doc_id")


def _schema(task: scan_kernel.Task, query_carry: Sequence[str]) -> str:
    carried = [f"q{i} string" for i in range(len(query_carry))]
    carried += [f"c{i} string" for i in range(task.n_corpus_carry)]
    fields = ["query_id long", "metric string", "doc_id long", "score double"]
    return ", ".join([*fields, *carried, "part int"])


def _with_part(batch: pa.RecordBatch, part: int) -> pa.RecordBatch:
    return batch.append_column("part", pa.array([part] * batch.num_rows, pa.int32()))


cloudpickle.register_pickle_by_value(__import__("sys").modules[__name__])


def _scan(rows: DataFrame, table: pa.Table, task: scan_kernel.Task, query_carry: Sequence[str]) -> DataFrame:
    """Scan corpus partitions where they lie against a broadcast block of queries."""
    block = scan_kernel.query_block(table, len(query_carry), task.prefilter)
    shared = rows.sparkSession.sparkContext.broadcast(tuple(block))  # plain arrays need no module to unpickle

    def scan_partition(batches):
        part = TaskContext.get().partitionId() // TASKS_PER_PART
        for batch in scan_kernel.scan(batches, scan_kernel.QueryBlock(*shared.value), task):
            yield _with_part(batch, part)

    return rows.mapInArrow(scan_partition, _schema(task, query_carry))


def _scan_in_blocks(
    rows: DataFrame, wanted: DataFrame, task: scan_kernel.Task, query_carry: Sequence[str], n_blocks: int
) -> DataFrame:
    """The lists of all blocks of queries, one block after the other; only one is in the driver and in tasks at a time."""
    lists = fresh_path(rows.sparkSession, "knn-lists")
    for block, table in enumerate(_dealt(wanted, n_blocks, "knn-blocks")):
        if table.num_rows:
            _scan(rows, table, task, query_carry).write.parquet(f"{lists}/block={block}")
    return rows.sparkSession.read.schema(_schema(task, query_carry)).parquet(f"{lists}/*")


def _dealt(df: DataFrame, n_blocks: int, name: str) -> Iterator[pa.Table]:
    """The rows of a stored table in blocks, one after the other.

    Rows are dealt by a hash of their place in the stored table, so blocks are even also when ids repeat.
    """
    path = fresh_path(df.sparkSession, name)
    number = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_blocks)).cast("int")
    df.withColumn("block", number).write.partitionBy("block").parquet(path)
    stored = df.sparkSession.read.schema(f"{_ddl(df)}, block int").parquet(path)
    for block in range(n_blocks):
        yield stored.where(F.col("block") == block).drop("block").toArrow()


def _corpus_bytes(rows: DataFrame, dim: int, corpus_carry: Sequence[str]) -> int:
    """Bytes of a corpus, as it travels: at least one."""
    letters = sum((F.coalesce(F.octet_length(name), F.lit(0)) for name in corpus_carry), F.lit(0))
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(letters), F.lit(0))).first()
    return max(1, n * (8 * dim + 8 + 8 * len(corpus_carry)) + size)


def _search_in_parts(
    rows: DataFrame, wanted: DataFrame, task: scan_kernel.Task, shape: _Shape, dim: int, n_parts: int, n_blocks: int, max_queries: int
) -> DataFrame:
    """The rows of whole lists: the queries of each task meet the parts of the corpus one after the other.

    A part is in the driver's memory while it is shipped, and in a task's while it is searched; executors keep them on disk.
    """
    context, n_carry = rows.sparkSession.sparkContext, len(shape.names) - task.n_corpus_carry
    parts, carried = [], []

    def load(shared):
        value = shared.value
        if getattr(shared, "_path", None):  # else a worker would keep every part in memory for its life
            vars(shared).pop("_value", None)
        return value

    def answer(batches):
        loaders = ([lambda shared=shared: load(shared) for shared in column] for column in (parts, carried))
        yield from scan_kernel.search(batches, *loaders, task, dim, n_carry, max(1, max_queries))

    try:
        for table in _dealt(rows, n_parts, "knn-parts"):
            part, columns = scan_kernel.corpus_part(table, dim, task.k)
            parts.append(context.broadcast(tuple(part)))  # plain arrays need no module to unpickle
            carried.append(context.broadcast(columns))
            del table, part, columns  # before the next part comes
        hit = ", ".join(["doc_id: bigint", "score: double", *(f"c{i}: string" for i in range(task.n_corpus_carry))])
        fields = ["query_id long", "metric string", *(f"q{i} string" for i in range(n_carry)), f"hits array<struct<{hit}>>"]
        cores = context.defaultParallelism
        lists = wanted.repartition(cores * math.ceil(n_blocks / cores)).mapInArrow(answer, ", ".join(fields))
        return materialize(_rows_of(lists, shape), "knn-lists")
    finally:
        for shared in (*parts, *carried):
            shared.destroy()


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes)


def _is_scan(df: DataFrame) -> bool:
    """Whether a table is read from files with nothing but projections and filters on the way."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return bool(re.search(r"FileScan|BatchScan", plan)) and not re.search(
        r"Exchange|Join|Aggregate|Generate|Window|Sort|InArrow|InPandas|Python|Union|ExistingRDD", plan
    )
