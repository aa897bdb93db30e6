import numpy as np
import pytest
from pyspark.sql import functions as F

from nearwise.operators import knn
from nearwise.operators.facets import facet_always
from nearwise.operators.knn import Facets, knn_join, single_query

FLOATS = "array<float>"


def table(spark, key, vectors, partitions=3, vector_type=FLOATS):
    rows = [(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"{key} long, embedding {vector_type}").repartition(partitions)


def brute_force(queries, corpus, k, metric, digits=6):
    hits = []
    for q_id, q in enumerate(queries):
        scored = []
        for d_id, d in enumerate(corpus):
            if q is None or d is None:
                continue
            a, b = np.asarray(q, np.float64), np.asarray(d, np.float64)
            if metric == "l2":
                cost = float(((a - b) ** 2).sum())
            else:
                norms = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())
                if norms == 0:
                    continue
                cost = -float((a * b).sum() / norms)
            scored.append((round(cost, digits), d_id))
        hits += [(q_id, metric, rank, d_id) for rank, (_, d_id) in enumerate(sorted(scored)[:k], start=1)]
    return hits


def ids(df):
    return sorted((r.query_id, r.metric, r["rank"], r.doc_id) for r in df.collect())


def sample(n, dim, seed, duplicates=True):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, dim)), 3).astype(np.float32)
    if duplicates:
        x[n // 3 : 2 * n // 3] = x[0]  # a third of all rows are copies
    return x


@pytest.mark.parametrize("strategy", ["broadcast", "grid"])
@pytest.mark.parametrize("k", [1, 7, 400])
def test_matches_brute_force(spark, strategy, k):
    queries, corpus = sample(23, 8, 1, False), sample(150, 8, 2)
    corpus[5] = 0
    found = knn_join(
        table(spark, "query_id", queries), table(spark, "doc_id", corpus), k, strategy=strategy,
        max_query_bytes=1 << 24 if strategy == "broadcast" else 4000,
    )
    expected = [hit for m in ("l2", "cosine") for hit in brute_force(queries, corpus, k, m)]
    assert ids(found) == sorted(expected)


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_partitioning_does_not_matter(spark, partitions):
    queries, corpus = sample(9, 4, 3), sample(80, 4, 4)
    found = knn_join(table(spark, "query_id", queries), table(spark, "doc_id", corpus, partitions), 5)
    assert ids(found) == sorted(h for m in ("l2", "cosine") for h in brute_force(queries, corpus, 5, m))


@pytest.mark.parametrize("scale", [1e-25, 1e-12, 1e12, 1e25])
def test_extreme_magnitudes(spark, scale):
    """Lengths outside the single-precision range are screened in double precision."""
    queries, corpus = sample(5, 6, 5, False) * 1.0, sample(60, 6, 6, False) * 1.0
    queries, corpus = queries.astype(float) * scale, corpus.astype(float) * scale
    found = knn_join(
        table(spark, "query_id", queries, vector_type="array<double>"),
        table(spark, "doc_id", corpus, vector_type="array<double>"), 4, digits=None,
    )
    expected = [h for m in ("l2", "cosine") for h in brute_force(queries, corpus, 4, m, 400)]
    assert ids(found) == sorted(expected)


def test_screen_keeps_near_ties(spark):
    """Rows closer together than single precision can tell are still ranked exactly."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=16) * 100
    corpus = base + rng.normal(size=(300, 16)) * 1e-4
    queries = base + rng.normal(size=(4, 16)) * 1e-4
    found = knn_join(
        table(spark, "query_id", queries, vector_type="array<double>"),
        table(spark, "doc_id", corpus, vector_type="array<double>"), 10, metrics=["l2"], digits=None,
    )
    assert ids(found) == sorted(brute_force(queries, corpus, 10, "l2", 400))


def test_null_zero_and_self(spark):
    corpus = [[1, 0], [0, 0], None, [2, 0], [0, 3]]
    found = knn_join(table(spark, "query_id", corpus), table(spark, "doc_id", corpus), 9)
    assert ids(found) == sorted(h for m in ("l2", "cosine") for h in brute_force(corpus, corpus, 9, m))
    rows = {(r.query_id, r.metric, r["rank"]): r for r in found.collect()}
    assert not [key for key in rows if key[0] == 2]  # a null query finds nothing
    assert [rows[0, "cosine", n].doc_id for n in (1, 2)] == [0, 3]  # scaled copies tie
    assert rows[0, "l2", 1].score == 0.0 and rows[3, "l2", 1].doc_id == 3
    assert (1, "cosine", 1) not in rows


def test_unit_vectors_relate_the_metrics(spark):
    x = sample(60, 8, 8, False)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = knn_join(table(spark, "query_id", x), table(spark, "doc_id", x), 5).collect()
    score = {(r.query_id, r.metric, r.doc_id): r.score for r in found}
    for (q, metric, d), value in score.items():
        if metric == "l2" and (q, "cosine", d) in score:
            assert abs(value - (2 - 2 * score[q, "cosine", d])) < 1e-5


def test_wrong_dimension_is_an_error(spark):
    queries, corpus = table(spark, "query_id", [[1, 2]]), table(spark, "doc_id", [[1, 2], [1, 2, 3]])
    with pytest.raises(Exception, match="must have 2 elements"):
        knn_join(queries, corpus, 1).collect()


def test_limits_and_arguments(spark):
    queries, corpus = table(spark, "query_id", sample(50, 4, 1)), table(spark, "doc_id", sample(50, 4, 2))
    with pytest.raises(ValueError, match="exceed the broadcast limit"):
        knn_join(queries, corpus, 3, strategy="broadcast", max_query_bytes=100)
    with pytest.raises(ValueError, match="unknown metrics"):
        knn_join(queries, corpus, 3, metrics=["dot"])
    with pytest.raises(ValueError, match="k must"):
        knn_join(queries, corpus, 0)


@pytest.mark.parametrize("empty_side", ["queries", "corpus"])
@pytest.mark.parametrize("strategy", ["auto", "grid"])
def test_empty_sides(spark, empty_side, strategy):
    queries, corpus = table(spark, "query_id", sample(3, 4, 1)), table(spark, "doc_id", sample(5, 4, 2))
    if empty_side == "queries":
        queries = queries.where("false")
    else:
        corpus = corpus.where("false")
    assert knn_join(queries, corpus, 3, strategy=strategy).count() == 0


@pytest.mark.parametrize("strategy", ["auto", "grid"])
def test_prefilter_ranks_what_passes(spark, strategy):
    queries, corpus = sample(12, 4, 21, False), sample(90, 4, 22)
    q = table(spark, "query_id", queries).withColumn(
        "wanted", F.when(F.col("query_id") % 3 > 0, F.concat(F.lit("S"), (F.col("query_id") % 5).cast("string")))
    )
    c = table(spark, "doc_id", corpus).withColumn(
        "facet", F.when(F.col("doc_id") % 7 > 0, F.concat(F.lit("s"), (F.col("doc_id") % 6).cast("string")))
    )
    test = Facets(F.col("wanted"), F.col("facet"), facet_always(F.col("facet"), "s5"))
    found = knn_join(
        q, c, 4, metrics=["l2"], query_carry=["wanted"], corpus_carry=["facet"], prefilter=test, strategy=strategy
    ).collect()
    for q_id in range(12):
        wanted = f"s{q_id % 5}" if q_id % 3 else None
        facet = {d: f"s{d % 6}" if d % 7 else None for d in range(90)}
        passes = {d: wanted is None or facet[d] == wanted or facet[d] == "s5" for d in range(90)}
        ranked = [h[3] for h in brute_force(queries[q_id : q_id + 1], corpus, 90, "l2")]
        expected = [d for d in ranked if passes[d]][:4]
        rows = sorted((r["rank"], r.doc_id, r.facet) for r in found if r.query_id == q_id)
        assert [(d, f) for _, d, f in rows] == [(d, facet[d]) for d in expected]


def test_grid_leaves_the_corpus_where_it_is(spark, tmp_path):
    """Blocks of queries, also of one hot id and without ids; the stored corpus is scanned and never shuffled."""
    queries, corpus = sample(60, 4, 51, False), sample(400, 4, 52)
    table(spark, "doc_id", corpus, 6).write.parquet(str(tmp_path / "corpus"))
    stored = spark.read.parquet(str(tmp_path / "corpus"))
    assert knn._is_scan(stored.where("doc_id >= 0").withColumn("x", F.lit(1)))
    assert not knn._is_scan(stored.distinct()) and not knn._is_scan(table(spark, "doc_id", corpus))
    found = knn_join(table(spark, "query_id", queries), stored, 5, metrics=["l2"], strategy="grid", max_query_bytes=3000)
    assert ids(found) == sorted(brute_force(queries, corpus, 5, "l2"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "embedding" not in plan and "Generate" not in plan
    hot = table(spark, "query_id", [queries[0]] * 50).withColumn("query_id", F.when(F.col("query_id") % 2 == 0, 7).cast("long"))
    unnamed = stored.withColumn("doc_id", F.when(F.col("doc_id") != 3, F.col("doc_id")))
    again = knn_join(hot, unnamed, 3, metrics=["l2"], strategy="grid", max_query_bytes=3000).collect()
    nearest = next(d for *_, d in brute_force(queries[:1], corpus, 9, "l2") if d != 3)
    assert {r.query_id for r in again} == {7} and {r.doc_id for r in again if r["rank"] == 1} == {nearest}


def test_single_query(spark):
    corpus = sample(100, 6, 31)
    found = single_query([0.5] * 6, table(spark, "doc_id", corpus), 8)
    expected = brute_force([[0.5] * 6], corpus, 8, "l2")
    assert [r.doc_id for r in found.collect()] == [h[3] for h in expected]


@pytest.mark.parametrize("prefilter", [False, True])
def test_copies_are_ranked_by_id(spark, prefilter):
    """Far more copies than k, in every facet class: only ids decide."""
    corpus = np.ones((3000, 4), np.float32)
    corpus[2000:] = sample(1000, 4, 41, False) + 3
    corpus[100:600] = 0
    c = table(spark, "doc_id", corpus, 1).withColumn("facet", F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string")))
    queries = np.array([[1, 1, 1, 1], [3, 3, 3, 3], [0, 0, 0, 0.1]], np.float32)
    q = table(spark, "query_id", queries).withColumn("wanted", F.lit("s1"))
    test = Facets(F.col("wanted"), F.col("facet"), F.lit(False)) if prefilter else None
    found = knn_join(q, c, 5, metrics=["l2"], prefilter=test).collect()
    for i in range(3):
        ranked = [h[3] for h in brute_force(queries[i : i + 1], corpus, 3000, "l2")]
        expected = [d for d in ranked if not prefilter or d % 3 == 1][:5]
        rows = sorted((r["rank"], r.doc_id) for r in found if r.query_id == i)
        assert [d for _, d in rows] == expected


def test_scale_does_not_change_ranks(spark):
    points = [[i / 100, 0.0] for i in range(101)]
    for scale in (1.0, 1e-4, 1e-9, 1e6):
        query = table(spark, "query_id", [[0.5 * scale, 0.0]], vector_type="array<double>")
        corpus = table(spark, "doc_id", [[x * scale for x in v] for v in points], vector_type="array<double>")
        hits = knn_join(query, corpus, 3, metrics=["l2"]).collect()
        assert {r.doc_id for r in hits if r["rank"] == 1} == {50} and {r.doc_id for r in hits} == {49, 50, 51}


def test_single_query_checks_like_a_join(spark):
    corpus = table(spark, "doc_id", [[1.0, 2.0], [float("nan"), 1.0], [0.0, 0.0], None])
    assert [r.doc_id for r in single_query([0.0, 0.0], corpus, 5).collect()] == [2, 0]
    with pytest.raises(Exception, match="must have"):
        single_query([0.0, 0.0, 0.0], corpus, 5).collect()
