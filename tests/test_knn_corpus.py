"""Joins of more queries than fit in a task, to which the corpus travels in parts."""

from functools import partial

import numpy as np
import pytest
from oracle_check import connect, mismatch
from pyspark.sql import functions as F
from test_knn import brute_force, ids, sample, table

from __spark_entry__ import oracle_sql, queries
from nearwise.operators.knn import knn_join
from nearwise.plans import search

SF_DIR = "/root/testdata/sf0.001"


def files_of(df):
    """The rows in the files that a result is read from."""
    return df.sparkSession.read.parquet(*df.inputFiles()).count()


@pytest.mark.parametrize("k", [1, 7, 400])
@pytest.mark.parametrize("max_query_bytes", [400, 1500, 1 << 26])
def test_matches_brute_force(spark, k, max_query_bytes):
    queries, corpus = [*sample(23, 8, 1, False), None, np.full(8, np.nan)], [*sample(150, 8, 2), None]
    corpus[5], queries[3] = np.zeros(8), np.zeros(8)
    found = knn_join(
        table(spark, "query_id", queries), table(spark, "doc_id", corpus), k, strategy="corpus", max_query_bytes=max_query_bytes
    )
    whole = [q if q is not None and np.isfinite(q).all() else None for q in queries]
    assert ids(found) == sorted(h for m in ("l2", "cosine") for h in brute_force(whole, corpus, k, m))


def test_more_rows_than_a_tile(spark):
    """Several tiles and chunks, in several parts; scores are those of a scan to the last bit."""
    queries, corpus = sample(700, 16, 61, False), sample(5000, 16, 62)
    q, c = table(spark, "query_id", queries), table(spark, "doc_id", corpus)
    found = knn_join(q, c, 20, strategy="corpus", max_query_bytes=1 << 18)
    plain = knn_join(q, c, 20, strategy="broadcast")
    assert found.columns == plain.columns and found.dtypes == plain.dtypes
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))


@pytest.mark.parametrize("scale", [1e-25, 1e-12, 1e12, 1e25])
def test_extreme_magnitudes(spark, scale):
    queries, corpus = sample(5, 6, 5, False).astype(float) * scale, sample(60, 6, 6, False).astype(float) * scale
    found = knn_join(
        table(spark, "query_id", queries, vector_type="array<double>"),
        table(spark, "doc_id", corpus, vector_type="array<double>"), 4, strategy="corpus", max_query_bytes=2000,
    )
    assert ids(found) == sorted(h for m in ("l2", "cosine") for h in brute_force(queries, corpus, 4, m, 400))


def test_near_ties(spark):
    rng = np.random.default_rng(11)
    base = rng.normal(size=16) * 100
    corpus, queries = base + rng.normal(size=(3000, 16)) * 1e-4, base + rng.normal(size=(4, 16)) * 1e-4
    found = knn_join(
        table(spark, "query_id", queries, vector_type="array<double>"),
        table(spark, "doc_id", corpus, vector_type="array<double>"), 10, metrics=["l2"], strategy="corpus",
    )
    assert ids(found) == sorted(brute_force(queries, corpus, 10, "l2", 400))


def test_copies_are_ranked_by_id(spark):
    corpus = np.ones((3000, 4), np.float32)
    corpus[2000:] = sample(1000, 4, 41, False) + 3
    corpus[100:600] = 0
    queries = np.array([[1, 1, 1, 1], [3, 3, 3, 3], [0, 0, 0, 0.1]], np.float32)
    found = knn_join(
        table(spark, "query_id", queries), table(spark, "doc_id", corpus), 5, strategy="corpus", max_query_bytes=20_000
    )
    assert ids(found) == sorted(h for m in ("l2", "cosine") for h in brute_force(queries, corpus, 5, m))


def test_many_queries_are_answered_where_they_are(spark):
    """Each list is made whole in one task: nothing but the result is written, however many tasks read the corpus."""
    queries, corpus = sample(300, 4, 51, False), sample(400, 4, 52)
    q, c = table(spark, "query_id", queries), table(spark, "doc_id", corpus, 6)
    found = knn_join(q, c, 5, max_query_bytes=5000)
    assert ids(found) == sorted(h for m in ("l2", "cosine") for h in brute_force(queries, corpus, 5, m))
    assert files_of(found) == 300 * 2 * 5
    few = knn_join(q.where("query_id < 30"), c, 5, max_query_bytes=5000)  # here the corpus is the larger side: it stays
    assert ids(few) == sorted(h for m in ("l2", "cosine") for h in brute_force(queries[:30], corpus, 5, m))
    assert files_of(few) > 30 * 2 * 5


def test_wrong_dimension_and_filters(spark):
    queries, corpus = table(spark, "query_id", [[1, 2]]), table(spark, "doc_id", [[1, 2], [1, 2, 3]])
    with pytest.raises(Exception, match="must have 2 elements"):
        knn_join(queries, corpus, 1, strategy="corpus").collect()
    for empty in (queries.where("false"), queries.withColumn("embedding", F.lit(None).cast("array<float>"))):
        assert knn_join(empty, corpus, 1, strategy="corpus").count() == 0
    assert knn_join(queries, corpus.where("false"), 1, strategy="corpus").count() == 0


@pytest.mark.parametrize("repeated", [False, True])
def test_compare_keeps_the_same_rows(spark, monkeypatch, repeated):
    """Filter, fallback and cut of whole lists give the rows of the windows, also when ids repeat; only those are stored."""
    queries, corpus = sample(200, 4, 71, False), sample(500, 4, 72)
    n, facet = F.col("query_id"), F.when(F.col("doc_id") % 9 > 0, F.concat(F.lit("s"), (F.col("doc_id") % 40).cast("string")))
    q = table(spark, "query_id", queries).withColumn("facet_used", F.when(n % 4 > 0, F.concat(F.lit("S"), (n % 50).cast("string"))))
    if repeated:
        q = q.withColumn("query_id", F.floor(n / 2))
    c = table(spark, "doc_id", corpus, 6).withColumn("facet", facet)
    plain = search.search_compare(q, c, k=3, overfetch=4, always_contains="s17", digits=6)
    expected = sorted(map(str, plain.collect()))
    assert {r.fallback_used for r in plain.collect()} == {True, False, None}
    monkeypatch.setattr(search, "knn_join", partial(knn_join, max_query_bytes=10_000))
    found = search.search_compare(q, c, k=3, overfetch=4, always_contains="s17", digits=6)
    assert found.columns == plain.columns and sorted(map(str, found.collect())) == expected
    assert repeated or files_of(found) == len(expected)


@pytest.mark.parametrize("name", ["search_bucketed", "search_order_reference"])
def test_ordered_lists_equal_sql(spark, monkeypatch, name):
    """A whole query whose lists don't fit in a task: as its SQL, with nothing stored but the rows that it orders."""
    monkeypatch.setattr(search, "knn_join", partial(knn_join, max_query_bytes=1 << 18))
    found = queries()[name](spark, SF_DIR)
    assert mismatch(found, oracle_sql()[name], connect(SF_DIR)) is None
    assert files_of(found) == found.count()
