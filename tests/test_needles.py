import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nearwise.operators import bloom, facets, needles
from nearwise.plans import search


@pytest.mark.parametrize("stride", [1, 7, 64, 1 << 19])
def test_first_needle_of_each_text(monkeypatch, stride):
    monkeypatch.setattr(needles, "STRIDE", stride)
    rng = random.Random(stride)
    for _ in range(60):
        letters = rng.choice(["ab", "abcé", "abcdefgh €"])
        sought = ["".join(rng.choices(letters, k=rng.choice([1, 2, 3, 5, 8, 15, 16, 17, 30, 40]))) for _ in range(rng.choice([1, 3, 30]))]
        sought = list(dict.fromkeys(sought)) + [""] * (rng.random() < 0.1)
        rng.shuffle(sought)
        texts = [
            None if rng.random() < 0.1 else "".join(rng.choices(letters, k=rng.choice([0, 1, 5, 50, 200]))) + rng.choice(sought) * rng.randrange(2)
            for _ in range(20)
        ]
        found = needles.first_contained(pa.array(["xx", *texts], pa.string()).slice(1), needles.index_needles(pa.array(sought, pa.string())))
        assert found.tolist() == [len(sought) if t is None else next((i for i, n in enumerate(sought) if n in t), len(sought)) for t in texts]


def test_equal_hashes_are_told_apart(monkeypatch):
    """With a hash that is no hash every candidate must be compared by its bytes."""
    index = needles.index_needles(pa.array(["abc", "abd"], pa.string()))
    forged = index._replace(hashes=index.hashes, ranks=index.ranks[::-1].copy())
    assert needles.first_contained(pa.array(["xabcx", "abd"], pa.string()), forged).tolist() == [2, 2]


@pytest.mark.parametrize("word_boundary", [False, True])
def test_dictionary_in_blocks(spark, monkeypatch, word_boundary):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcd", k=rng.choice([2, 3, 5, 20]))) for _ in range(80)]
    texts = [(i % 30 if i % 7 else None, " ".join(rng.choices(words, k=6)) if i % 11 else None, i) for i in range(120)]
    frame = spark.createDataFrame(texts, "query_id long, text string, pos int").repartition(4)
    dictionary = spark.createDataFrame([(i, w.upper()) for i, w in enumerate(rng.sample(words, 60))], "pos int, value string")
    inline = facets.detect_facet(frame, dictionary, word_boundary=word_boundary)
    expected = sorted((r.pos, str(r.query_id), r.detected_facet) for r in inline.collect())
    for size in (facets.BLOCK_BYTES, 1000):
        monkeypatch.setattr(facets, "BLOCK_BYTES", size)
        found = facets.detect_facet(frame, dictionary, word_boundary=word_boundary, max_inline=0)
        assert found.columns == [*frame.columns, "detected_facet"]
        assert sorted((r.pos, str(r.query_id), r.detected_facet) for r in found.collect()) == expected


def test_records_without_a_hit_are_filtered_where_they_lie(spark, monkeypatch, tmp_path):
    spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("name"), "id").alias("name")).write.parquet(str(tmp_path / "c"))
    corpus = spark.read.parquet(str(tmp_path / "c"))
    hits = spark.createDataFrame([(q, "l2", 1, 7 if q % 3 == 0 else q * 2, 0.5) for q in range(200)], "query_id long, metric string, rank int, doc_id long, score double")
    expected = sorted(search.materialize_hits(hits, corpus).collect())
    monkeypatch.setattr(search, "MAX_HITS_BROADCAST_BYTES", 0)
    assert sorted(search.materialize_hits(hits, corpus).collect()) == expected and len(expected) == 200
    ids = hits.select("doc_id").distinct()
    passed = bloom.with_possible(corpus, F.col("doc_id"), ids, ids.count()).where("possible")
    assert ids.count() <= passed.count() < ids.count() + 60
    assert passed.join(ids, F.col("probe") == F.col("doc_id")).count() == ids.count()
