"""Merkle manifest, conversation trie and URL filter, held against plain Python and SQL."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from oracle_check import connect, mismatch
from pyspark.sql import functions as F

from nearwise.llm import manifest, prefix_trie, ranks, url_filter
from nearwise.llm.queries import ORACLES, QUERIES, UNWANTED_HOSTS, URL_RULES
from nearwise.llm.radix_tree import RadixTree
from nearwise.operators import bloom
from nearwise.session import materialize

SF_DIR = "/root/testdata/sf0.001"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_manifest", "op12_prefix_trie", "op13_url_filter"])
def test_query_equals_sql(spark, name):
    assert mismatch(QUERIES[name](spark, SF_DIR), ORACLES[name], connect(SF_DIR)) is None


# Places in groups


@pytest.mark.parametrize("rows_per_range", [3, 40, 100_000])
def test_places_in_groups_of_any_size(spark, monkeypatch, rows_per_range):
    monkeypatch.setattr(ranks, "ROWS_PER_RANGE", rows_per_range)
    rng = random.Random(1)
    rows = [(rng.choice([None, "hot", "hot", "a", "b", f"g{i}"]), rng.choice([None, 1, 2, i]), i) for i in range(300)]
    stored = materialize(spark.createDataFrame(rows, "g string, x long, n long").repartition(5), "rows")
    found = {r.n: r.place for r in ranks.rank_in_groups(stored, ["g"], ["x", "n"], "place").collect()}
    groups = collections.defaultdict(list)
    for g, x, n in rows:
        groups[g].append((x is not None, x or 0, n))
    assert found == {n: i for group in groups.values() for i, (*_, n) in enumerate(sorted(group))}
    assert ranks.rank_in_groups(stored.where("false"), ["g"], ["x", "n"], "place").count() == 0


# Merkle manifest


def plain_tree(leaves):
    """The root over leaves, and for each leaf its siblings, as (left, right) from the leaf up."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for leaf, i in enumerate(at):
            run = level[i // 3 * 3 : i // 3 * 3 + 3]
            paths[leaf].append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
            at[leaf] = i // 3
        level = [digest("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
    return level[0], paths


def plain_leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_manifest(rows):
    groups = collections.defaultdict(list)
    for row in rows:
        groups[row[1]].append((row[0] is not None, row[0] or 0, plain_leaf(row), row))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([leaf for *_, leaf, _ in sorted(groups[s], key=lambda x: x[:3])]) for s in order}
    root, tops = plain_tree([trees[s][0] for s in order])
    out = []
    for s, above in zip(order, tops):
        for (_, _, leaf, row), path in zip(sorted(groups[s], key=lambda x: x[:3]), trees[s][1]):
            out.append((str(row[0]), leaf, trees[s][0], root, path + above))
    return sorted(out)


def manifest_rows():
    rng = random.Random(2)
    rows = [(i, "hot", "en", 5, f"text\n{i}") for i in range(101)]
    rows += [(i, f"s{i}", None, None, rng.choice([None, "", "é\n", "x" * 50_000])) for i in range(200, 240)]
    rows += [(7, "hot", "en", 5, "text\n7")] * 4 + [(None, "hot", None, 1, "a"), (None, None, None, None, None), (3, None, "de", 2, "b")]
    rows += [(300 + i, "nine", "en", i, "t") for i in range(9)] + [(400 + i, "ten", "en", i, "t") for i in range(10)]
    return rows


@pytest.fixture(scope="module")
def manifest_docs(spark):
    rows = [(*row, "tree", 1, "x") for row in manifest_rows()]
    schema = "doc_id long, source string, lang string, n_chars long, text string, tree string, pos int, carried string"
    return spark.createDataFrame(rows, schema).repartition(6)


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest_equals_plain_trees(spark, manifest_docs, monkeypatch, levels):
    monkeypatch.setattr(manifest, "LEVELS", levels)
    monkeypatch.setattr(manifest, "BLOCK", 3**levels)
    made = manifest.build_manifest(manifest_docs)
    found = manifest.prove(made).withColumn("folded", manifest.fold(F.col("leaf"), F.col("siblings")))
    found = found.withColumn("digest", manifest.siblings_digest(F.col("siblings")))
    expected = plain_manifest(manifest_rows())
    rows = found.collect()
    assert sorted((str(r.carried.doc_id), r.leaf, r.subroot, made.root, [tuple(s) for s in r.siblings]) for r in rows) == expected
    assert all(r.folded == made.root for r in rows)
    assert all(r.digest == digest("".join(a + b for a, b in r.siblings)) for r in rows)


def test_manifest_records_lead_from_the_root_to_every_leaf(manifest_docs):
    made = manifest.build_manifest(manifest_docs)
    below = {r.digest: r.children for band in made.bands + made.root_bands for r in band.collect()}
    assert all(key == digest("".join(children)) and 1 <= len(children) <= 3 for key, children in below.items())
    reached, todo = [], [made.root]
    while todo:
        node = todo.pop()
        todo += below.get(node, [])
        reached += [node] * (node not in below)
    assert sorted(reached) == sorted(plain_leaf(row) for row in manifest_rows())


def test_manifest_proves_what_is_asked(spark, manifest_docs):
    made = manifest.build_manifest(manifest_docs)
    asked = made.leaves.where("tree = 'hot' AND pos IN (0, 50) OR tree IS NULL").select("tree", "pos", "carried")
    rows = manifest.prove(made, asked).withColumn("folded", manifest.fold(F.col("leaf"), F.col("siblings"))).collect()
    assert len(rows) == 4 and {r.folded for r in rows} == {made.root}
    changed = F.concat("leaf", F.lit("0"))
    assert manifest.prove(made, asked).where(manifest.fold(changed, F.col("siblings")) == made.root).count() == 0
    with pytest.raises(Exception, match="does not have"):
        manifest.prove(made, asked.withColumn("pos", F.lit(5000).cast("long"))).collect()


def test_manifest_without_rows_and_of_one_row(spark, manifest_docs):
    empty = manifest.build_manifest(manifest_docs.where("false"))
    assert empty.root is None and manifest.prove(empty).collect() == []
    one = manifest.build_manifest(manifest_docs.where("doc_id = 3 AND source IS NULL"))
    (row,) = manifest.prove(one).collect()
    assert row.leaf == row.subroot == one.root and row.siblings == []


def test_manifest_finds_tampering(spark):
    found = QUERIES["op11_manifest"](spark, SF_DIR).select("doc_id", "verified")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    rows = found.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 2 == 1 or "\n" not in (r.text or ""))


# Radix tree and conversation trie


def add_to(total, other):
    total[0] += other[0]


@pytest.mark.parametrize("alphabet, width", [(2, 1), (5, 2), (17, 1), (60, 2), (256, 4)])
def test_radix_tree_equals_all_prefixes(alphabet, width):
    rng = random.Random(alphabet)
    keys = [bytes(rng.randrange(alphabet) for _ in range(width * rng.randrange(5))) for _ in range(3000)]
    keys += [keys[5]] * 20 + [bytes(width * 30)] * 2 + [bytes(width * 40)]
    tree = RadixTree(add_to, list)
    for key in keys:
        tree.insert(key, [1])
    prefixes = collections.Counter(key[:end] for key in keys for end in range(0, len(key) + 1, width))
    assert sorted((len(p) // width, n) for p, n in prefixes.items()) == sorted((d, t[0]) for d, t in tree.aligned(width))


def test_radix_tree_grows_and_compresses():
    tree, rooms = RadixTree(add_to, list), []
    tree.insert(b"", [1])
    for byte in range(256):
        tree.insert(bytes([byte]) + b"way" * 100, [1])
        rooms.append(tree.root.room)
    assert rooms == [4] * 4 + [16] * 12 + [48] * 32 + [256] * 208
    assert all(node.prefix == b"way" * 100 and not node.children for node in tree.root.in_order())
    tree.insert(b"\x07waywa", [1])
    upper = tree.root.child(7)
    assert (upper.prefix, upper.room, upper.total) == (b"waywa", 4, [2])
    assert upper.child(ord("y")).prefix == b"way" * 98
    assert list(RadixTree(add_to, list).aligned(4)) == []


def plain_trie(rows):
    told = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            told[conv].append((turn is not None, turn or 0, key, role, text))
    convs = {c: [t[3:] for t in sorted(turns)] for c, turns in told.items()}
    rebuilt, members = {}, collections.defaultdict(list)
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(convs.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + own[h:])
        for depth in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:depth]].append(c)
    children = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, convs_of in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for depth in range(len(k) + 1):
            saved[k[:depth]] += (len(convs_of) - 1) * words
            leaves[k[:depth]] += k not in children
    return sorted(
        (
            min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k],
            digest(",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(k))),
        )
        for k, m in members.items()
    )


TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie_of(turns):
    found = prefix_trie.conversation_trie(*prefix_trie.share_openings(prefix_trie.number_turns(turns)))
    assert all(kind == ("string" if name == "ends_sha256" else "bigint") for name, kind in found.dtypes)
    return sorted(tuple(r[c] for c in TRIE) for r in found.collect())


def turns_frame(spark, rows):
    schema = "conv_id long, turn long, role string, text string, depth string, pos int, words string"
    return spark.createDataFrame([(*row, "d", 1, "w") for row in rows], schema).repartition(5)


def by_parent(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("segment, piece", [(1, 1), (3, 2), (64, 4096)])
def test_trie_equals_all_prefixes(spark, monkeypatch, segment, piece):
    monkeypatch.setattr(prefix_trie, "SEGMENT", segment)
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    rng, rows = random.Random(segment), []
    for conv in range(-25, 60):
        for turn in range(rng.choice([1, 1, 2, 4, 9])):
            rows.append((conv, rng.choice([turn, turn, turn, None]), rng.choice(["u", "a", None]), rng.choice(["one two", "x", "", None])))
    rows += [(100 + i, t, "u", f"same {t}") for i in range(15) for t in range(7)]  # copies
    rows += [(500, t, "a", "long " * 20) for t in range(150)] + [(501, t, "a", "long " * 20) for t in range(140)]
    rows += [(600, 1, "u", "twice")] * 3 + [(None, 1, "u", "nobody's"), (601, None, None, "y" * 100_000)]
    assert by_parent(trie_of(turns_frame(spark, rows))) == by_parent(plain_trie(rows))


def test_trie_without_conversations_and_of_turnless_ones(spark):
    assert trie_of(turns_frame(spark, [(1, 1, "u", "x")]).where("false")) == []
    short = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)  # loses its only turn, and its base is absent
    assert trie_of(turns_frame(spark, [(short, 1, "u", "x")])) == [(short, 0, None, 1, 0, 1, 0, digest(str(short)))]


# URL filter

URLS = [
    None, "", "no scheme", "http://", "://x", "HTTP://WWW.A.Example.COM/P", "http://b.com?q=1", "http://b.com#f", "http://b.com/a?x=://",
    "http://cheap-pills.com/x/", "https://www.cheap-pills.com:443/x?utm_source=feed#top", "http://cheap-pills.com/x?b=2&ref=y&a=1",
    "http://cheap-pills.com/x?a=1&b=2", "http://cheap-pills.com/y", "http://example.org/es/1", "http://m.example.org/es/1",
    "http://notexample.org/es/1", "http://example.org/es", "http://example.org/en/12", "http://x.example.org/en/2", "http://org/", "http://orgs/",
    "http://a.com/fr/1", "http://a.com/de/1", "http://É.com/de/", "http://u@a.com:80/de/x/y//",
]


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def plain_rule(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.host + r.path), default=None)


def pages_frame(spark, urls):
    rows = [(i, url, "<p>", "h", "r", True) for i, url in enumerate(urls)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, rule string, listed boolean").repartition(4)


@pytest.mark.parametrize("broadcast_bytes", [bloom.BROADCAST_BYTES, 0])
def test_urls_are_judged_as_by_hand(spark, broadcast_bytes):
    urls = URLS + ["http://cheap-pills.com/x"] * 200
    listed = spark.createDataFrame([("cheap-pills.com/x",), ("cheap-pills.com/x?a=1&b=2",), (None,), ("cheap-pills.com/x",)], "u string")
    rows = url_filter.judge_urls(pages_frame(spark, urls), listed, URL_RULES, broadcast_bytes).collect()
    assert sorted(r.page_id for r in rows) == list(range(len(urls)))
    blocked = {"http://cheap-pills.com/x", *URLS[9:13]}
    for r in rows:
        rule = plain_rule(*plain_parts(urls[r.page_id]))
        verdict = rule.action if rule else "block" if urls[r.page_id] in blocked else "allow"
        assert (r.host, r.path, r.rule, r.verdict) == (*plain_parts(urls[r.page_id]), rule and rule.host + rule.path, verdict)


def test_filter_passes_all_listed_keys_and_few_others(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("host/"), "id").alias("key"))
    listed = keys.where("key < 'host/15'")
    found = url_filter.is_listed(keys, "key", listed).groupBy("listed").count().collect()
    assert {r.listed: r["count"] for r in found} == {True: listed.count(), False: keys.count() - listed.count()}
    others = bloom.with_possible(keys.where("key >= 'host/15'"), F.col("key"), listed, listed.count())
    assert others.where("possible").count() < others.count() / 200


def test_nothing_is_listed_in_an_empty_list_and_no_page_judged_in_an_empty_table(spark):
    none = spark.createDataFrame([], "u string")
    rows = url_filter.judge_urls(pages_frame(spark, URLS), none, []).collect()
    assert len(rows) == len(URLS) and {(r.rule, r.verdict) for r in rows} == {(None, "allow")}
    assert url_filter.judge_urls(pages_frame(spark, URLS).where("false"), none, URL_RULES).count() == 0


def test_rules_of_one_length_block_first_and_long_lists_are_refused(spark):
    rules = [url_filter.Rule("allow", "b.com", "/xx"), url_filter.Rule("block", "a.b.com", "/"), url_filter.Rule("block", "c.b.com", "/")]
    page = pages_frame(spark, ["http://a.b.com/xx"])
    assert url_filter.judge_urls(page, spark.createDataFrame([], "u string"), rules).first().verdict == "block"
    with pytest.raises(ValueError, match="rules"):
        url_filter.longest_rule(F.col("host"), F.col("path"), rules * 100)


def test_url_filter_is_native_and_reads_urls_only(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    listed = pages.where(F.regexp_like("url", F.lit(UNWANTED_HOSTS))).select(url_filter.canonical_url(F.col("url")))
    plan = url_filter.judge_urls(pages, listed, URL_RULES)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|MapPartitions|Cartesian|NestedLoop", plan)
    assert "html" not in plan.split("== Physical Plan ==")[1]
