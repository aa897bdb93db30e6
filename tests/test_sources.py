import os


import pytest
from pyspark.errors import AnalysisException

from nearwise.functions.tags import parse_tags
from nearwise.operators import profile
from nearwise.operators.extract import extract_cards, page_fields, page_links
from nearwise.operators.knn import knn_join
from nearwise.sources import records, vector_table
from nearwise.streaming.search_stream import search_stream


def test_csv_edges(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text(
        'name,state,description,tags\n"a ""b""",Goa,"line 1\nline 2","[\'x\', \'y\']"\nNA,null,N/A,[]\nc,,d,plain\n', encoding="utf8"
    )
    rows = records.read_records_csv(spark, str(path)).collect()
    assert [tuple(r) for r in rows] == [
        ('a "b"', "Goa", "line 1\nline 2", "['x', 'y']"), (None, None, None, "[]"), ("c", None, "d", "plain"),
    ]


def test_csv_round_trip(spark, tmp_path):
    rows = [("n, 1", "Goa", 'say "hi"\nthere', ["it's", "b"]), ("n2", None, "d\\e", [])]
    df = spark.createDataFrame(rows, "name string, state string, description string, tags array<string>")
    records.write_records_csv(df, str(tmp_path / "out"))
    back = records.read_records_csv(spark, str(tmp_path / "out")).withColumn("tags", parse_tags("tags"))
    assert sorted((tuple(r) for r in back.collect()), key=lambda r: r[0]) == [tuple(r) for r in rows]


def vectors(spark, ids, shift=0.0):
    return spark.createDataFrame([(i, "f", [3.0 + shift, 4.0]) for i in ids], "doc_id long, facet string, embedding array<float>")


@pytest.mark.parametrize("by_facet", [False, True])
def test_vector_table(spark, tmp_path, by_facet):
    path = str(tmp_path / "v")
    vector_table.write_vectors(vectors(spark, range(5)), path, partition_by_facet=by_facet)
    stored = vector_table.load_vectors(spark, path)
    assert stored.count() == 5 and stored.select("norm").distinct().first().norm == 5.0
    assert {r.facet for r in stored.collect()} == {"f"}


def test_missing_table_is_an_error(spark, tmp_path):
    with pytest.raises(AnalysisException):
        vector_table.load_vectors(spark, str(tmp_path / "none")).count()


def test_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "v")
    vector_table.write_vectors(vectors(spark, range(3)), path)
    more = vectors(spark, range(2, 6), 1.0).unionByName(vectors(spark, [5], 2.0))
    for _ in range(2):
        vector_table.append_vectors(more, path)
    stored = {r.doc_id: r.embedding[0] for r in vector_table.load_vectors(spark, path).collect()}
    assert stored == {0: 3.0, 1: 3.0, 2: 3.0, 3: 4.0, 4: 4.0, 5: 5.0}
    assert vector_table.load_vectors(spark, path).count() == 6


def test_append_keeps_the_layout(spark, tmp_path):
    path = str(tmp_path / "by-facet")
    vector_table.write_vectors(vectors(spark, range(4)), path, partition_by_facet=True)
    vector_table.append_vectors(vectors(spark, range(10)), path)
    assert vector_table.load_vectors(spark, path).count() == 10
    assert all(".parquet" not in name for name in os.listdir(path))


def test_unfinished_tables(spark, tmp_path):
    crashed = tmp_path / "crashed"
    (crashed / "_temporary").mkdir(parents=True)
    with pytest.raises(vector_table.UnfinishedTable):
        vector_table.load_vectors(spark, str(crashed))
    assert vector_table.ensure_table(spark, str(crashed), lambda: spark.range(3)).count() == 3


def test_torn_append_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "v")
    vector_table.write_vectors(vectors(spark, range(3)), path)
    vectors(spark, range(50, 60)).write.parquet(f"{path}/rows=torn")  # what a writer left that never got to its manifest
    assert vector_table.load_vectors(spark, path).count() == 3

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(vector_table, "publish_text", crash)
        with pytest.raises(RuntimeError):
            vector_table.append_vectors(vectors(spark, range(9)), path)
    assert vector_table.load_vectors(spark, path).count() == 3
    vector_table.append_vectors(vectors(spark, range(9)), path)
    assert vector_table.load_vectors(spark, path).count() == 9
    vector_table.drop_unnamed(spark, path)
    assert len([name for name in os.listdir(path) if name.startswith("rows=")]) == 2
    assert vector_table.load_vectors(spark, path).count() == 9


def test_of_two_writers_one_is_told(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "v")
    vector_table.write_vectors(vectors(spark, range(3)), path)
    with pytest.raises(vector_table.TableChanged):
        vector_table.write_vectors(vectors(spark, range(3)), path)
    seen = vector_table._latest(spark, path)
    vector_table.append_vectors(vectors(spark, range(4)), path)
    with monkeypatch.context() as late:
        late.setattr(vector_table, "_latest", lambda *_: seen)
        with pytest.raises(vector_table.TableChanged):
            vector_table.append_vectors(vectors(spark, range(5)), path)
    assert vector_table.load_vectors(spark, path).count() == 4
    vector_table.write_vectors(vectors(spark, range(2)), path, mode="overwrite")
    assert vector_table.load_vectors(spark, path).count() == 2


@pytest.mark.parametrize("by_facet", [False, True])
def test_rows_without_a_key_are_appended_once(spark, tmp_path, by_facet):
    path = str(tmp_path / "v")
    vector_table.write_vectors(vectors(spark, [1, 2]), path, partition_by_facet=by_facet)
    more = vectors(spark, [None, None, 2, 3], 1.0)
    for _ in range(2):
        vector_table.append_vectors(more, path)
    assert sorted(str(r.doc_id) for r in vector_table.load_vectors(spark, path).collect()) == ["1", "2", "3", "None"]


def test_partitioned_vectors_are_pruned(spark, tmp_path):
    from pyspark.sql import functions as F

    from nearwise.plans import search

    path = str(tmp_path / "v")
    rows = [(i, f"S{i % 8}", [1.0, float(i)]) for i in range(80)]
    vector_table.write_vectors(spark.createDataFrame(rows, "doc_id long, facet string, embedding array<float>"), path, partition_by_facet=True)
    asking = spark.createDataFrame([(1, "s3"), (2, "S5"), (3, "other")], "query_id long, facet_used string")
    for listed in (search.MAX_LISTED_FACETS, 1):
        search.MAX_LISTED_FACETS, before = listed, search.MAX_LISTED_FACETS
        try:
            pruned = search.of_facets(vector_table.load_vectors(spark, path), asking, F.contains(F.lower("facet"), F.lit("s7")))
        finally:
            search.MAX_LISTED_FACETS = before
        assert {r.facet for r in pruned.collect()} == {"S3", "S5", "S7"} and pruned.count() == 30
    few = search.of_facets(vector_table.load_vectors(spark, path), asking, F.lit(False))
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "lower(facet" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert few.count() == 20


def test_ensure_builds_once(spark, tmp_path):
    path, built = str(tmp_path / "t"), []

    def build():
        built.append(1)
        return spark.range(3)

    assert [vector_table.ensure_table(spark, path, build).count() for _ in range(2)] == [3, 3] and len(built) == 1
    broken = tmp_path / "broken"
    broken.mkdir()
    with pytest.raises(AnalysisException):  # an unreadable table is not rebuilt
        vector_table.ensure_table(spark, str(broken), build)
    os.remove(tmp_path / "t" / "_SUCCESS")
    with pytest.raises(vector_table.UnfinishedTable):  # nor opened or rebuilt when its end is in doubt
        vector_table.ensure_table(spark, path, build)
    assert len(built) == 1


CARDS = [
    (1, '<div class="group"><h2 class="a"><a href="#"><span> Na<b>me</b> &amp; more </span></a></h2><h2> Goa </h2>'
        '<span class="x line-clamp-2"><span>Desc<br>ription</span></span><div title="t"><span>a</span><p><span> b </span></p></div></div>'),
    (2, '<div class="group flex"><h2>only one</h2></div>'),
    (3, '<div class="groups"><h2><a><span>no</span></a></h2></div><p>no card</p>'),
    (4, '<div class="group"><h2><a><span>outer</span></a></h2><div class="group"><h2><a><span>inner</span></a></h2><h2>S</h2></div></div>'),
    (5, None),
    (6, '<div class="group"><h2><a><span>unclosed<script>var x = "group";</script></a></h2><h2>T</div><h2>outside</h2>'),
    (7, '<div class="group"><![bad[ x ]]></div>'),
    (8, '<div class="&#103;roup"><h2><a><span>coded</span></a></h2></div>'),
]


def test_cards(spark):
    pages = spark.createDataFrame(CARDS, "page_id long, html string").repartition(3)
    rows = sorted(tuple(r) for r in extract_cards(pages).collect() if not r.corrupt)
    assert [r for r in rows if r[0] != 7] == [
        (1, 1, "Name & more", "Goa", "Description", ["a", "b"], False),
        (2, 1, "", "", "", [], False),
        (4, 1, "outer", "inner", "", [], False),
        (4, 2, "inner", "S", "", [], False),
        (6, 1, "unclosed", "T", "", [], False),
        (8, 1, "coded", "", "", [], False),
    ]


def plain_cards(html):
    """The fields of all cards by walking the whole tree of elements for each card."""
    import re

    root = {"tag": "", "attrs": {}, "children": []}
    stack = [root]
    for text, close, tag, attrs in re.findall(r"([^<]+)|<(/?)(\w+)([^>]*)>", html):
        if text:
            stack[-1]["children"].append(text)
        elif close:
            if any(e["tag"] == tag for e in stack[1:]):
                while stack.pop()["tag"] != tag:
                    pass
        else:
            element = {"tag": tag, "attrs": dict(re.findall(r'(\w+)="([^"]*)"', attrs)), "children": []}
            stack[-1]["children"].append(element)
            if tag != "br":
                stack.append(element)

    def walk(element, above):
        yield element, above
        for child in element["children"]:
            if not isinstance(child, str):
                yield from walk(child, [*above, element])

    def text(element):
        return "".join(c if isinstance(c, str) else text(c) for c in element["children"])

    def under(above, *tests):
        tests = list(tests)
        for element in above:
            if tests and tests[0](element):
                tests.pop(0)
        return not tests

    every = list(walk(root, []))
    is_h2, is_a = (lambda e: e["tag"] == "h2"), (lambda e: e["tag"] == "a")
    clamp = lambda e: e["tag"] == "span" and "line-clamp-2" in e["attrs"].get("class", "").split()
    titled = lambda e: e["tag"] == "div" and "title" in e["attrs"]
    out = []
    for card, _ in every:
        if card["tag"] != "div" or "group" not in card["attrs"].get("class", "").split():
            continue
        inside = [(e, above) for e, above in every if any(x is card for x in above)]
        pick = lambda test: [text(e).strip() for e, above in inside if test(e, above)]
        span = lambda *tests: pick(lambda e, above: e["tag"] == "span" and under(above, *tests))
        first = lambda found, at=0: found[at] if len(found) > at else ""
        out.append((first(span(is_h2, is_a)), first(pick(lambda e, _: is_h2(e)), 1), first(span(clamp)), span(titled)))
    return out


def test_cards_equal_a_walk_of_the_tree():
    import random

    from nearwise.operators.extract import _cards_of

    rng = random.Random(4)
    starts = ['<div class="group">', '<div class="x group y">', "<h2>", "<a>", "<span>", '<span class="line-clamp-2">', '<div title="t">', "<p>", "<br>"]
    ends = ["</div>", "</h2>", "</a>", "</span>", "</p>"]
    for _ in range(400):
        html = "".join(rng.choice([rng.choice(starts), rng.choice(starts), rng.choice(ends), f"w{rng.randrange(9)} "]) for _ in range(60))
        assert [row[2:6] for row in _cards_of(1, html)] == plain_cards(html)


def test_cards_take_time_in_proportion_to_the_page():
    import time

    from nearwise.operators.extract import _cards_of

    start = time.process_time()
    rows = _cards_of(1, '<div class="group">x' * 100_000 + "<h2><a><span>name</span></a></h2><h2>F</h2>")
    assert time.process_time() - start < 4 and len(rows) == 100_000  # about 1 s; it was hours
    assert rows[0][2:] == rows[-1][2:] == ("name", "F", "", [], False)


def test_page_fields_and_links(spark):
    html = '<title>A &amp; B</title><nav><a href="/x"> x </a><A>y<b>z</b></A></nav><article><h1>H</h1><p>one</p><p>two</p></article>'
    pages = spark.createDataFrame([(1, "u", html), (2, "v", "<p>bare</p>")], "page_id long, url string, html string")
    assert [tuple(r) for r in page_fields(pages).orderBy("page_id").collect()] == [
        (1, "u", "A & B", "H", "H one two"), (2, "v", "", "", ""),
    ]
    assert [tuple(r) for r in page_links(pages).orderBy("link_no").collect()] == [(1, 1, "x"), (1, 2, "yz")]


def test_all_references_are_resolved(spark):
    html = "<title>Caf&eacute; &#8217;x&#x27; &amp;lt;</title><a href=x>l&ouml;w</a><a>&nbsp;b</a><a>&</a><a>a & b &notit; &copy</a><a>&#0;&#xD800;&#x110000;</a>"
    pages = spark.createDataFrame([(1, "u", html), (2, "v", None)], "page_id long, url string, html string")
    assert page_fields(pages).orderBy("page_id").first().title == "Café ’x' &lt;"
    assert [r.link_text for r in page_links(pages).orderBy("link_no").collect()] == ["löw", "b", "&", "a & b ¬it; ©", "\ufffd\ufffd\ufffd"]


def test_profiles(spark):
    df = spark.createDataFrame([(2, "a"), (1, None), (3, "b")], "doc_id long, s string")
    assert [tuple(r) for r in profile.column_profile(df).collect()] == [(0, "doc_id", "bigint", 3, 3), (1, "s", "string", 3, 2)]
    assert [r.doc_id for r in profile.preview(df, n=2).collect()] == [1, 2]
    v = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,), ([1.0],)], "embedding array<float>")
    assert tuple(profile.vector_stats(v).first()) == (4, 3, 1, 1, 2, 0.0, 5.0)


def test_stream_equals_batch(spark, tmp_path):
    corpus = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "doc_id long, embedding array<float>")
    arriving = spark.createDataFrame([(i, [i * 1.7, 1.0]) for i in range(20)], "query_id long, embedding array<float>")
    source = str(tmp_path / "arriving")
    arriving.repartition(4).write.parquet(source)

    def run():
        stream = spark.readStream.schema(arriving.schema).option("maxFilesPerTrigger", 1).parquet(source)
        search_stream(
            stream, lambda batch: knn_join(batch, corpus, 3), str(tmp_path / "out"), str(tmp_path / "state"), availableNow=True
        ).awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).drop("batch_id")

    expected = sorted(map(tuple, knn_join(arriving, corpus, 3).collect()))
    assert sorted(map(tuple, run().collect())) == expected
    assert sorted(map(tuple, run().collect())) == expected  # nothing new: nothing repeated
    more = spark.createDataFrame([(100, [5.0, 1.0])], arriving.schema)
    more.write.mode("append").parquet(source)
    expected = sorted(map(tuple, knn_join(arriving.union(more), corpus, 3).collect()))
    assert sorted(map(tuple, run().collect())) == expected


def test_stream_of_texts(spark, tmp_path):
    """The whole text search runs inside a stream, also when queries are cut into blocks."""
    from nearwise.plans import search

    rows = [(i, f"name{i}", "Goa", f"word{i} word{i % 7}", ["t"]) for i in range(30)]
    records_df = spark.createDataFrame(rows, "doc_id long, name string, facet string, description string, tags array<string>")
    tables = search.build_corpus(records_df, dim=32)
    arriving = spark.createDataFrame([(i, f"word{i} word3") for i in range(12)], "query_id long, text string")
    arriving.write.parquet(str(tmp_path / "in"))

    def answer(strategy):
        def run(batch):
            embedded = search.embed_queries(search.nonblank(batch), tables)
            return knn_join(embedded, tables.vectors, 4, strategy=strategy)

        return run

    expected = sorted(map(tuple, answer("auto")(arriving).collect()))
    for strategy in ("auto", "grid"):
        out = str(tmp_path / strategy)
        stream = spark.readStream.schema(arriving.schema).parquet(str(tmp_path / "in"))
        search_stream(stream, answer(strategy), out, out + "-state", availableNow=True).awaitTermination()
        assert sorted(map(tuple, spark.read.parquet(out).drop("batch_id").collect())) == expected
