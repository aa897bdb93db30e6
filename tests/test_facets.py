import pytest
from pyspark.sql import functions as F

from nearwise.operators import facets
from nearwise.operators.facets import (
    STATES, detect_facet, facet_bucket, facet_match, facet_options, resolve_facet,
)


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "query_id long, text string")


def detected(df):
    return [r.detected_facet for r in sorted(df.collect(), key=lambda r: r.query_id)]


def test_detects_in_list_order(spark):
    asked = texts(spark, ["my goal in maharashtra", "no name", "MAHARASHTRA loans", "delhi or assam", None, ""])
    assert detected(detect_facet(asked)) == ["Goa", None, "Maharashtra", "Assam", None, None]
    assert detected(detect_facet(asked, word_boundary=True))[0] == "Maharashtra"


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
@pytest.mark.parametrize("word_boundary", [False, True])
def test_dictionary_in_blocks_equals_inline(spark, monkeypatch, word_boundary, block_bytes):
    monkeypatch.setattr(facets, "BLOCK_BYTES", block_bytes)
    values = ["abc", "ab", "Xyz", "a long value with many words and a tail of letters", "long value", "é", "the cat", "cat"]
    asked = texts(
        spark,
        ["xabcx", "the cat sat", "THE CATS", "say a long value with many words and a tail of letters!", "école é", "zz", None, "", "xyz ab"],
    )
    inline = detect_facet(asked, values, word_boundary=word_boundary)
    joined = detect_facet(asked, values, word_boundary=word_boundary, max_inline=0)
    expected = []
    for row in asked.collect():
        pad = (lambda t: f" {t} ") if word_boundary else (lambda t: t)
        low = None if row.text is None else row.text.lower().replace("!", "")
        expected.append(None if low is None else next((v for v in values if pad(v.lower()) in pad(low)), None))
    assert detected(inline) == expected
    assert detected(joined) == expected


def test_empty_dictionary_value(spark):
    values = ["zebra", "", "a"]
    asked = texts(spark, ["a zebra", "b", None])
    assert detected(detect_facet(asked, values)) == ["zebra", "", None]
    assert detected(detect_facet(asked, values, max_inline=0)) == ["zebra", "", None]


def test_dictionary_table(spark):
    table = spark.createDataFrame([(2, "NATION_1"), (1, "NATION_10"), (3, "OTHER"), (0, None), (9, "other")], "pos int, value string")
    asked = texts(spark, ["in nation_10 now", "in nation_1 now", "other", "none"])
    assert detected(detect_facet(asked, table)) == ["NATION_10", "NATION_1", "OTHER", None]
    assert detected(detect_facet(asked, table, max_inline=1)) == ["NATION_10", "NATION_1", "OTHER", None]


@pytest.mark.parametrize("max_inline", [512, 0])
def test_rows_of_null_and_repeated_keys(spark, max_inline):
    rows = [(1, "in goa"), (1, "x"), (None, "assam"), (None, None), (2, "in goa")]
    asked = spark.createDataFrame(rows, "query_id long, text string").withColumn("value", F.lit("clash"))
    found = detect_facet(asked, ["Goa", "Assam"], max_inline=max_inline)
    assert found.columns == ["query_id", "text", "value", "detected_facet"]
    got = sorted((str(r.query_id), str(r.text), str(r.detected_facet)) for r in found.collect())
    assert got == [("1", "in goa", "Goa"), ("1", "x", "None"), ("2", "in goa", "Goa"), ("None", "None", "None"), ("None", "assam", "Assam")]


def test_states():
    assert len(STATES) == 36


def test_match_and_bucket(spark):
    rows = [(0, "Goa"), (1, "goa"), (2, "Ministry Of X"), (3, "Bihar"), (4, None)]
    df = spark.createDataFrame(rows, "i int, facet string")
    facet = F.col("facet")
    match = [r.m for r in df.select("i", facet_match(facet, F.lit("GOA")).alias("m")).orderBy("i").collect()]
    assert match == [True, True, True, False, False]
    bucket = [r.b for r in df.select("i", facet_bucket(facet, F.lit("goa")).alias("b")).orderBy("i").collect()]
    assert bucket == [0, 0, 1, 2, 2]
    own = [r.b for r in df.select("i", facet_bucket(facet, F.lit("ministry of x")).alias("b")).orderBy("i").collect()]
    assert own == [2, 2, 0, 2, 2]


def test_resolve(spark):
    rows = [(0, "Goa", "Bihar"), (1, "All States", "Bihar"), (2, None, None), (3, None, "Bihar"), (4, "", "Bihar")]
    df = resolve_facet(spark.createDataFrame(rows, "i int, explicit_facet string, detected_facet string"))
    assert [(r.facet_used, r.facet_origin) for r in df.orderBy("i").collect()] == [
        ("Goa", "explicit"), ("Bihar", "detected"), (None, "none"), ("Bihar", "detected"), ("Bihar", "detected"),
    ]


def test_options(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "facet string")
    assert [r.option for r in facet_options(df).collect()] == ["All States", "a", "b"]
