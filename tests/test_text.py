import random
import re
import string

import pytest
from pyspark.sql import functions as F

from nearwise.functions import tags as tag_fns, text as text_fns
from nearwise.functions.romanize import romanize


def values(spark, inputs, expression):
    rows = list(enumerate(inputs))
    df = spark.createDataFrame(rows, "i int, x string").select("i", expression(F.col("x")).alias("y"))
    return [row.y for row in sorted(df.collect())]


TEXTS = [
    "A-B_c!`~", "a b c　d", "x\u0085y", "x\u001cy", "Straße “q”", "", "   ", None,
    "  Tabs\t\nand lines  ", "dots... and, commas;", string.punctuation, "nothing special",
]


def test_clean_query_text_matches_python(spark):
    def expected(text):
        if text is None:
            return ""
        text = re.sub(f"[{re.escape(string.punctuation)}]", " ", text.lower())
        return re.sub(r"\s+", " ", text).strip()

    assert values(spark, TEXTS, text_fns.clean_query_text) == [expected(t) for t in TEXTS]


def test_clean_index_text_doubles_latin_and_romanises(spark):
    inputs = ["abc", "नमस्ते x", None, "  ", "A-b C"]
    assert values(spark, inputs, text_fns.clean_index_text) == [
        "abc abc", "नमस्ते x namaste x", "", "", "a-b c a-b c",
    ]


@pytest.mark.parametrize(
    "source, latin",
    [
        ("नमस्ते", "namaste"), ("योजना", "yojanA"), ("क्षेत्र", "kShetra"), ("ज्ञान", "j~nAna"),
        ("हिंदी", "hiMdI"), ("दुःख", "duHkha"), ("चाँद", "chA.Nda"), ("ॐ", "OM"), ("२०२४", "2024"),
        ("लड़का", "la.DakA"), ("ज़मीन", "zamIna"), ("कृषि", "kRRiShi"), ("ऐ औ", "ai au"),
        ("अब।", "aba|"), ("plain text", "plain text"), ("क", "ka"), ("क्", "k"),
    ],
)
def test_romanize(spark, source, latin):
    assert values(spark, [source], romanize) == [latin]


def test_romanize_null(spark):
    assert values(spark, [None], romanize) == [None]


def test_title_case_matches_python(spark):
    inputs = ["west bengal", "o'neill-smith", "JAMMU and kashmir", "a1b2 c", "", "été à paris", "नमस्ते abc"]
    assert values(spark, inputs, text_fns.title_case) == [t.title() for t in inputs]


def test_four_decimals_matches_python(spark):
    rng = random.Random(7)
    numbers = [rng.uniform(-3, 3) for _ in range(500)]
    numbers += [round(n, 5) for n in numbers] + [round(n * 1000) / 1000 + 0.00005 for n in numbers]
    numbers += [0.0, 0.00005, 0.00015, 0.32575, 1.00005, 2.5, -0.00001, 123456.78125, 1e10 + 0.00005, 1e15]
    rows = list(enumerate(numbers))
    df = spark.createDataFrame(rows, "i int, x double").select("i", text_fns.four_decimals("x").alias("y"))
    assert [row.y for row in sorted(df.collect())] == [f"{n:.4f}" for n in numbers]


def test_tags(spark):
    inputs = [
        "['a', 'b c ', '']", "['a', \"b's\"]", "[]", "plain", r"""['x\'y"z']""", r"['a\xa0b']", None, "['a', 'b'",
    ]
    assert values(spark, inputs, tag_fns.display_tags) == [
        "a, b c", "a, b's", "", "plain", "x'y\"z", "a b", None, "['a', 'b'",
    ]


def test_tags_literal_round_trip(spark):
    df = spark.createDataFrame([(["it's", 'a "b"', "c\\d", "e, f"],), ([],)], "t array<string>")
    literal = tag_fns.tags_literal(F.col("t"))
    assert df.select((tag_fns.parse_tags(literal) == F.col("t")).alias("same")).where("not same").count() == 0


def test_random_texts_match_python(spark):
    rng = random.Random(5)
    alphabet = string.printable + "éàßñ“”—\u00a0\u2003\u3000\u0085\u001c\u2028नम" + " " * 20
    inputs = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)]

    def expected(text):
        text = re.sub(f"[{re.escape(string.punctuation)}]", " ", text.lower())
        return re.sub(r"\s+", " ", text).strip()

    assert values(spark, inputs, text_fns.clean_query_text) == [expected(t) for t in inputs]
    assert values(spark, inputs, text_fns.title_case) == [t.title() for t in inputs]


def test_tag_lists_are_read_strictly(spark):
    literals = [
        "['a'] trailing", "[1, 2]", "['a', ['b']]", "['a', 'b',]", "['a' 'b', \"c\"]", "['a\\U0001F600b']", "[,]", "['a',,'b']", "['a", None, "[ ]",
    ]
    shown = values(spark, literals, tag_fns.display_tags)
    assert shown == ["['a'] trailing", "[1, 2]", "['a', ['b']]", "a, b", "ab, c", "a\U0001F600b", "[,]", "['a',,'b']", "['a", None, ""]


def test_romanize_further_vowels(spark):
    words = ["डॉक्टर", "कॉलेज", "ऑनलाइन", "\u0929 \u0934 \u0972", "\u0928\u093c", "कॅ कॆ कॊ"]
    assert values(spark, words, romanize) == ["DA.ckTara", "kA.cleja", "A.cnalAina", "^na zha a.c", "^na", "ka.c k^e k^o"]
