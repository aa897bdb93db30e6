import numpy as np
import pytest
from pyspark.sql import functions as F

from nearwise.operators import compare
from nearwise.plans import search


@pytest.fixture(scope="module")
def line(spark):
    """150 documents on a line; document i is i away from the origin. Only the last 20 are in Goa."""
    rows = [(i, [float(i), 1.0], "Goa" if i >= 130 else ("Ministry of X" if i == 120 else "Bihar")) for i in range(150)]
    return spark.createDataFrame(rows, "doc_id long, embedding array<float>, facet string").repartition(5)


def queries(spark, facets):
    return spark.createDataFrame(
        [(i, [0.0, 1.0], f) for i, f in enumerate(facets)], "query_id long, embedding array<float>, facet_used string"
    )


def l2(df, query_id):
    rows = [r for r in df.collect() if r.query_id == query_id and r.metric == "l2"]
    return sorted(rows, key=lambda r: r["rank"])


def test_postfilter_misses_what_prefilter_finds(spark, line):
    asked = queries(spark, ["goa", None])
    post = search.search_compare(asked, line, k=10, always_contains=None)
    pre = search.search_compare(asked, line, k=10, always_contains=None, mode="prefilter")
    assert [r.doc_id for r in l2(post, 0)] == list(range(10)) and l2(post, 0)[0].fallback_used is True
    assert [r.doc_id for r in l2(pre, 0)] == list(range(130, 140)) and l2(pre, 0)[0].fallback_used is False
    for df in (post, pre):
        assert [r.doc_id for r in l2(df, 1)] == list(range(10)) and l2(df, 1)[0].fallback_used is None


@pytest.mark.parametrize("mode", ["postfilter", "prefilter"])
def test_three_fallback_values(spark, line, mode):
    asked = queries(spark, ["bihar", "nowhere", None])
    found = search.search_compare(asked, line, k=3, mode=mode, always_contains=None)
    assert [l2(found, q)[0].fallback_used for q in range(3)] == [False, True, None]
    assert all([r.doc_id for r in l2(found, q)] == [0, 1, 2] for q in range(3))


def test_always_included_class(spark, line):
    found = search.search_compare(queries(spark, ["goa"]), line, k=10, overfetch=15)
    assert [r.doc_id for r in l2(found, 0)] == [120, *range(130, 139)]
    ordered = search.order_for_display(found)
    shown = sorted((r.position, r.doc_id, r.bucket) for r in ordered.collect() if r.metric == "l2")
    assert [(d, b) for _, d, b in shown] == [(d, 0) for d in range(130, 139)] + [(120, 1)]
    worst_first = search.order_for_display(found, "score_descending")
    shown = sorted((r.position, r.doc_id) for r in worst_first.collect() if r.metric == "l2")
    assert [d for _, d in shown] == [*range(138, 129, -1), 120]


def test_null_facets_never_match(spark, line):
    nulled = line.withColumn("facet", F.when(F.col("doc_id") >= 50, F.col("facet")))
    found = search.search_compare(queries(spark, ["bihar"]), nulled, k=5, overfetch=20)
    assert [r.doc_id for r in l2(found, 0)] == [50, 51, 52, 53, 54]


def test_unknown_mode(spark, line):
    with pytest.raises(ValueError, match="unknown mode"):
        search.search_compare(queries(spark, [None]), line, mode="other")


def test_materialize_and_display(spark):
    hits = spark.createDataFrame([(0, "l2", 1, 7, 0.32575), (0, "l2", 2, 9, 1.0), (0, "l2", 3, 8, 2.0)],
                                 "query_id long, metric string, rank int, doc_id long, score double")
    corpus = spark.createDataFrame(
        [(7, "seven", "tamil nadu", None, [" x ", "", "y"]), (8, None, None, "d", None)],
        "doc_id long, name string, facet string, description string, tags array<string>",
    )
    for bound in (None, 3):
        rows = {r.doc_id: r for r in search.display_rows(search.materialize_hits(hits, corpus, bound)).collect()}
        assert set(rows) == {7, 8}  # a hit without a record has nothing to show
        assert tuple(rows[7])[4:] == ("seven", "tamil nadu", "Tamil Nadu", "N/A", "x, y", "0.3257")
        assert tuple(rows[8])[4:] == ("N/A", "N/A", None, "d", "", "2.0000")


def test_nonblank(spark):
    df = spark.createDataFrame([(0, "a"), (1, " \t "), (2, ""), (3, None)], "query_id long, text string")
    assert [r.query_id for r in search.nonblank(df).collect()] == [0]


def test_comparisons(spark):
    rows = [
        (0, "l2", 1, 10, 0.5, "n"), (0, "l2", 2, 11, 0.7, "m"), (0, "cosine", 1, 11, 0.9, "m"), (0, "cosine", 2, 12, 0.8, "n"),
        (1, "l2", 1, 10, 0.1, "n"),
    ]
    hits = spark.createDataFrame(rows, "query_id long, metric string, rank int, doc_id long, score double, name string")
    asked = spark.createDataFrame([(0,), (1,), (2,)], "query_id long")
    by_id = {r.query_id: r for r in compare.compare_metrics(hits, 2, asked).collect()}
    assert by_id[0].l2_ids == [10, 11] and by_id[0].cosine_ids == [11, 12] and by_id[0].common_ids == [11]
    assert by_id[0].common_share == 0.5 and (by_id[0].cosine_min, by_id[0].cosine_max) == (0.8, 0.9)
    assert by_id[1].cosine_ids == [] and by_id[1].common_count == 0 and by_id[1].cosine_min is None
    assert by_id[2].l2_ids == [] and by_id[2].common_count == 0
    by_name = {r.query_id: r for r in compare.compare_names(hits, asked).collect()}
    assert by_name[0].common_names == ["m", "n"] and by_name[0].common_share == 1.0
    assert by_name[1].common_count == 0 and by_name[2].l2_count == 0 and by_name[2].common_share is None
    aligned = {(r.query_id, r.doc_id): r for r in compare.compare_aligned(hits).collect()}
    assert aligned[0, 11].rank_change == -1 and aligned[0, 10].cosine_rank is None and len(aligned) == 4


def test_text_search_finds_the_text_itself(spark):
    words = ["loan", "school", "farm", "water", "health", "road", "tax", "pension"]
    rng = np.random.default_rng(3)
    rows = [(i, f"s{i}", "Goa", " ".join(rng.choice(words, 12)) + f" unique{i}", ["a"]) for i in range(60)]
    records = spark.createDataFrame(rows, "doc_id long, name string, facet string, description string, tags array<string>")
    tables = search.build_corpus(records)
    corpus = tables.corpus
    asked = corpus.select(F.col("doc_id").alias("query_id"), F.concat_ws(" ", "name", "description", F.lit("a")).alias("text"))
    hits = search.search_text(asked, tables, k=3, metric="cosine").collect()
    assert {(r.query_id, r.doc_id) for r in hits if r["rank"] == 1} == {(i, i) for i in range(60)}


def test_stored_tables(spark, tmp_path):
    rows = [(i, f"n{i}", "Goa", f"word{i} common", ["a"]) for i in range(12)]
    records = spark.createDataFrame(rows, "doc_id long, name string, facet string, description string, tags array<string>")
    fresh = search.build_corpus(records, dim=32)
    asked = spark.createDataFrame([(0, "n3 word3 common")], "query_id long, text string")
    expected = search.search_text(asked, fresh).collect()
    base = str(tmp_path / "tables")
    for _ in range(2):
        stored = search.ensure_search_tables(records, base, dim=32)
        assert sorted(search.search_text(asked, stored).collect()) == sorted(expected)
    assert stored.corpus.columns == ["doc_id", "facet", "name", "description", "tags", "combined_text"]
    assert {r.facet for r in stored.vectors.collect()} == {"Goa"}

    def load():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    encoded = search.ensure_search_tables(records, str(tmp_path / "encoded"), load_encoder=load)
    assert encoded.terms is None and encoded.vectors.count() == 12


def test_stored_settings_must_agree(spark, tmp_path):
    rows = [(i, f"n{i}", "Goa", f"word{i} common", ["a"]) for i in range(6)]
    records = spark.createDataFrame(rows, "doc_id long, name string, facet string, description string, tags array<string>")
    base = str(tmp_path / "tables")
    (tmp_path / "tables" / "vectors" / "_temporary").mkdir(parents=True)  # what a crashed build leaves
    stored = search.ensure_search_tables(records, base, cleaner="query", dim=32)
    assert stored.vectors.count() == 6 and stored.settings == ("query", 32)
    assert search.ensure_search_tables(records, base).settings == ("query", 32)
    for other in ({"dim": 16}, {"cleaner": "index"}):
        with pytest.raises(ValueError, match="were made with"):
            search.ensure_search_tables(records, base, **other)
    asked = spark.createDataFrame([(0, "word3 common")], "query_id long, text string")
    with pytest.raises(ValueError, match="were made with"):
        search.embed_queries(asked, stored, dim=64)
    assert [len(r.embedding) for r in search.embed_queries(asked, stored).collect()] == [32]
    with pytest.raises(ValueError, match="from terms"):
        search.ensure_search_tables(records, base, load_encoder=lambda: None)


def test_hits_beyond_the_broadcast_bound(spark, monkeypatch):
    corpus = spark.createDataFrame([(i, f"n{i}") for i in range(50)], "doc_id long, name string")
    hits = spark.createDataFrame([(q, "l2", 1, q * 2, 0.5) for q in range(20)], "query_id long, metric string, rank int, doc_id long, score double")
    expected = sorted(search.materialize_hits(hits, corpus).collect())
    for limit in (128 * 20 + 10, 0):
        monkeypatch.setattr(search, "MAX_HITS_BROADCAST_BYTES", limit)
        assert sorted(search.materialize_hits(hits, corpus).collect()) == expected and len(expected) == 20
