import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearwise.operators.embed import embed_tfidf, embed_with, fit_terms

DOCS = ["a b b c", "a a d", "b", "", None, "e f g h a", "  a "] + ["a z%d" % (i % 9) for i in range(30)] + ["junk " * 500]


def bucket(term, dim):
    return int(hashlib.md5(term.encode()).hexdigest()[:8], 16) % dim


def expected_vectors(docs, dim, fitted=None):
    split = [[w for w in (d or "").split(" ") if w] for d in docs]
    fitted = [[w for w in (d or "").split(" ") if w] for d in (fitted or docs)]
    df = Counter(w for words in fitted for w in set(words))
    out = np.zeros((len(docs), dim))
    for i, words in enumerate(split):
        for w in words:
            if w in df:
                out[i, bucket(w, dim)] += (math.log((1 + len(fitted)) / (1 + df[w])) + 1) / len(words)
    return out


def vectors(df, key="doc_id"):
    rows = sorted(df.collect(), key=lambda r: r[key])
    return np.array([r.embedding for r in rows])


@pytest.mark.parametrize("limit", [1_000_000, 3, 0])
def test_tfidf_matches_python(spark, limit):
    docs = spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, combined_text string").repartition(4)
    terms = fit_terms(docs, dim=16)
    marked = docs.withColumn("facet", F.concat(F.lit("f"), F.col("doc_id")))
    embedded = embed_tfidf(marked, terms, dim=16, carry=["facet"], max_broadcast_terms=limit)
    assert {(r.doc_id, r.facet) for r in embedded.collect()} == {(i, f"f{i}") for i in range(len(DOCS))}
    found = vectors(embedded)
    np.testing.assert_allclose(found, expected_vectors(DOCS, 16), rtol=1e-5, atol=1e-7)


def test_unseen_words_are_ignored(spark):
    docs = spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, combined_text string")
    asked = ["a new", "only unknown words", "b b"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, combined_text string")
    terms = fit_terms(docs, dim=16)
    for limit in (1_000_000, 2):
        found = vectors(embed_tfidf(queries, terms, key="query_id", dim=16, max_broadcast_terms=limit), "query_id")
        np.testing.assert_allclose(found, expected_vectors(asked, 16, DOCS), rtol=1e-5, atol=1e-7)


@pytest.mark.parametrize("limit", [1_000_000, 2, 0])
def test_null_and_repeated_keys(spark, limit):
    rows = [(1, "a b"), (1, "c c c"), (None, "a"), (None, None), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, combined_text string")
    found = embed_tfidf(docs, fit_terms(docs, dim=8), dim=8, max_broadcast_terms=limit).collect()
    got = sorted((str(r.doc_id), round(sum(r.embedding), 4)) for r in found)
    weights = {w: math.log(6 / (1 + n)) + 1 for w, n in (("a", 2), ("b", 1), ("c", 1))}
    want = [("1", (weights["a"] + weights["b"]) / 2), ("1", weights["c"]), ("2", 0), ("None", weights["a"]), ("None", 0)]
    assert got == sorted((k, round(v, 4)) for k, v in want)


def test_terms_of_another_width(spark):
    docs = spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, combined_text string")
    with pytest.raises(ValueError, match="more than 2 buckets"):
        embed_tfidf(docs, fit_terms(docs, dim=64), dim=2)


def test_encoder_hook(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(["ab", None, "abc"])], "doc_id long, combined_text string, facet string")

    def load():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    rows = sorted(embed_with(docs, load, carry=["facet"]).collect())
    assert [(r.doc_id, r.facet, r.embedding) for r in rows] == [(0, "x", [2.0, 1.0]), (1, "x", [0.0, 1.0]), (2, "x", [3.0, 1.0])]
