"""Operators over a whole corpus, held against plain Python, SQL and held-out labels; and the pipeline."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from oracle_check import connect, mismatch
from pyspark.sql import functions as F

import corpus_pipeline
from nearwise.llm import languages, near_dups, passages, quality, toxicity
from nearwise.llm.components import components
from nearwise.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(400)]


def text_of(rng, n, words=WORDS):
    return " ".join(rng.choices(words, k=n))


def corpus():
    """Copies, near copies at and about the limit, chains, shared passages, short, empty and repeated rows."""
    rng, rows = random.Random(5), []
    base = [text_of(rng, 120) for _ in range(12)]
    rows += list(enumerate(base, 1))
    rows += [(100 + i, base[i % 3]) for i in range(20)]  # copies
    chain = base[3].split()
    for i in range(30):  # each differs a little from the one before
        chain = list(chain)
        chain[rng.randrange(120)] = f"c{i}"
        rows.append((200 - i, " ".join(chain)))
    rows += [(300 + i, text_of(rng, 60) + " " + base[5][:300] + " " + text_of(rng, 40)) for i in range(6)]
    rows += [(400, None), (401, ""), (402, " \n"), (403, "One"), (404, "one"), (405, "one two"), (406, "ONE Two"), (407, "one two one two")]
    rows += [(408, " ".join(["la"] * 500)), (409, " ".join(["la"] * 300)), (409, base[6]), (409, base[6]), (None, base[7]), (None, None)]
    rows += [(500 + i, " ".join(f"s{j}" for j in range(n))) for i, n in enumerate((8, 9, 10, 11))]  # 7/8, 8/9 ... shared
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, k) for k, (i, t) in enumerate(corpus())]
    return spark.createDataFrame(rows, "doc_id long, text string, n_shingles long").repartition(4)


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def near_plain(rows, size):
    sets = [shingles(t, size) for _, t in rows]
    label = list(range(len(rows)))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and None not in (rows[a][0], rows[b][0]) and 100 * shared >= 80 * len(sets[a] | sets[b]):
                label[max(top(a), top(b))] = min(top(a), top(b))
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[top(x)] = min(i, least.get(top(x), i))
    return sorted((str(i), len(sets[x]), str(least.get(top(x), i)), i is None or least[top(x)] == i) for x, (i, _) in enumerate(rows))


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_plain(docs, size):
    got = near_dups.near_duplicates(docs, size).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == near_plain(corpus(), size)


@pytest.mark.parametrize("group", [2, 1000])
def test_buckets_with_many_groups(docs, monkeypatch, group):
    """Most texts lie in few buckets, and links lead from one to the next; nothing is lost, also when sets are sent often."""
    monkeypatch.setattr(near_dups, "GROUP", group)
    monkeypatch.setattr(near_dups, "BROADCAST_IDS", 0)
    rows = [(i, f"a b c d e {i % 7} x{i % 7} y{i % 7} z{i % 7} q{i % 7} tail {i}" * 3) for i in range(40)]
    rng, base = random.Random(3), [f"b{i}" for i in range(60)]
    for i in range(120):  # copies with so many changes that some are linked and some not, by words that many share
        changed = list(base)
        for at in rng.sample(range(60), rng.randrange(14)):
            changed[at] = f"v{rng.randrange(20)}"
        rows.append((100 + i, " ".join(changed[: rng.choice([60, 60, 55])])))
    frame = docs.sparkSession.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for size in (1, 2):
        got = near_dups.near_duplicates(frame, size).collect()
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == near_plain(rows, size)


@pytest.mark.parametrize("percent", [80, 90, 100])
def test_rarest_shingles_find_all_similar_sets(spark, percent):
    rng, sets = random.Random(percent), []
    for crowd in range(6):
        base = rng.sample(range(300), rng.choice([1, 2, 3, 8, 30, 70]))
        for _ in range(25):
            one = set(base) - set(rng.sample(base, rng.randrange(len(base) // 4 + 1)))
            sets.append(one | {rng.randrange(300) for _ in range(rng.randrange(len(base) // 4 + 1))} or {crowd})
    members = spark.createDataFrame([(i, sorted(x)) for i, x in enumerate(sets)], "node long, members array<long>")
    active = members.select("node", (F.col("node") % 140).alias("label"), F.size("members").cast("long").alias("n_shingles"))
    found = {(r.u, r.v) for r in near_dups._by_rarest(members, active, percent).collect()}
    alike = {
        (a, b) for a in range(len(sets)) for b in range(a)
        if a % 140 != b % 140 and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    }
    assert alike and alike <= found and all(u > v and u % 140 != v % 140 for u, v in found)
    assert len(found) < len(sets) ** 2 / 8


@pytest.mark.parametrize("find", [near_dups.near_duplicates, near_dups.deduplicate])
def test_similarities_that_lose_links_are_an_error(docs, find):
    with pytest.raises(ValueError, match="50"):
        find(docs, percent=50)


def test_deduplicate_keeps_one_of_each_group(docs):
    kept = near_dups.deduplicate(docs).collect()
    want = {int(i) for i, _, c, k in near_plain(corpus(), 5) if k and i != "None"}
    assert {r.doc_id for r in kept if r.doc_id is not None} == want
    assert collections.Counter((r.doc_id, r.text) for r in kept)[409, " ".join(["la"] * 300)] <= 1
    assert near_dups.deduplicate(docs.limit(0)).count() == 0
    assert kept[0].__fields__ == docs.columns


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (300, 200), (300, 250), (250, 41)]
    rng = random.Random(1)
    rng.shuffle(links)
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "u long, v long").where("u <> v")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, **{i: 41 for i in (41, 200, 250, 300)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def passages_plain(rows, window):
    counts, listed = collections.Counter(), []
    for _, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        listed.append(words)
        counts.update(tuple(words[i : i + window]) for i in range(len(words) - window + 1))
    out = []
    for (i, _), words in zip(rows, listed):
        gone = {p for k in range(len(words) - window + 1) if counts[tuple(words[k : k + window])] > 1 for p in range(k, k + window)}
        kept = " ".join(x for p, x in enumerate(words) if p not in gone)
        out.append((str(i), len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("window", [12, 13, 35])
@pytest.mark.parametrize("crowded", [False, True])
def test_passages_equal_plain(docs, window, crowded, monkeypatch):
    if crowded:  # a sketch that is far too small lets every window through; the result is the same
        monkeypatch.setattr(passages, "MOST_BITS", 11)
        monkeypatch.setattr(passages, "LEAST_BITS", 11)
    got = passages.repeated_passages(docs, window).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == passages_plain(corpus(), window)


def test_passages_of_an_empty_table(docs):
    assert passages.repeated_passages(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        passages.repeated_passages(docs, 5)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert mismatch(QUERIES[name](spark, SF_DIR), ORACLES[name], connect(SF_DIR)) is None


def quality_plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = collections.Counter(windows)
    repeated = {p for i, x in enumerate(windows) if counts[x] > 1 for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(repeated), failed


def test_quality_counts_equal_plain(spark, docs):
    more = spark.createDataFrame(
        [(1, "a b\n\nc # $ é日\na b\n a b"), (2, " ".join(f"x{i % 9}" for i in range(40))), (3, "p q r s t u v w " * 2 + "o"), (4, "\x0b\x0c|")],
        "doc_id long, text string",
    )
    rows = docs.select("doc_id", "text").union(more)
    labels = spark.createDataFrame([(1, 1), (2, 1), (5, 1), (408, 0), (None, 1), (9, None)], "doc_id long, quality int")
    got = quality.judge_quality(rows, labels).collect()
    own = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    assert own == sorted((str(r.doc_id), *quality_plain(r.text)) for r in rows.collect())
    assert not any(r.kept and r.base_failed for r in got)
    none = quality.judge_quality(rows, labels.limit(0)).collect()  # without labels only the base rules decide
    assert all(r.kept != r.base_failed for r in none)
    assert quality.judge_quality(rows.limit(0), labels).count() == 0


def test_quality_weights_equal_plain(spark):
    texts = {1: "good words here", 2: "bad noise here", 3: "good good"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    weights = quality.fit_weights(docs, spark.createDataFrame([(1,), (3,)], "doc_id long"))
    bucket = lambda *x: spark.range(1).select(F.pmod(F.xxhash64(*map(F.lit, x)), F.lit(quality.BUCKETS))).first()[0]
    hashed = lambda word: spark.range(1).select(F.xxhash64(F.lit(word))).first()[0]
    good = bucket("good")
    raw, trusted = 3 / 13, 8  # single words and pairs
    want = np.log((3 + quality.BUCKETS * raw) / (trusted + quality.BUCKETS)) - np.log(raw)
    assert abs(weights[good] - want) < 1e-9
    pair = bucket(hashed("bad"), hashed("noise"))
    assert weights[pair] < 0 < weights[good]


def test_quality_verdicts_equal_plain(spark):
    """Score, threshold and verdict of every given document, from buckets that Spark gives for each word and pair."""
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{n}.parquet") for n in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.judge_quality(docs, labels).collect()}
    texts = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", r.text or "") for r in docs.collect()}
    words = sorted({x for t in texts.values() for x in t})
    hashed = spark.createDataFrame([(x,) for x in words], "w string").select("w", F.xxhash64("w").alias("h"))
    hashes = {r.w: r.h for r in hashed.collect()}
    pairs = sorted({pair for t in texts.values() for pair in zip(t, t[1:])})
    frame = spark.createDataFrame([(*p, hashes[p[0]], hashes[p[1]]) for p in pairs], "a string, b string, x long, y long")
    buckets = {w: h % quality.BUCKETS for w, h in hashes.items()}
    buckets.update({(r.a, r.b): r.h % quality.BUCKETS for r in frame.select("a", "b", F.xxhash64("x", "y").alias("h")).collect()})
    grams = {i: [buckets[x] for x in [*t, *zip(t, t[1:])]] for i, t in texts.items()}
    known = {r.doc_id: r.quality for r in labels.collect()}
    raw, good = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for i, found in grams.items():
        np.add.at(raw, found, 1)
        np.add.at(good, found, known.get(i) == 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        share, prior = raw / raw.sum(), quality.TARGET_PRIOR * quality.BUCKETS
        weights = np.where(raw > 0, np.log((good + prior * share) / (good.sum() + prior)) - np.log(share), 0)
    scores = {i: float(np.sum(weights[found]) / max(1, len(found))) for i, found in grams.items()}
    assert all(abs(got[i].score - scores[i]) < 2e-6 for i in texts)
    sides = [sorted(got[i].score for i, q in known.items() if i in got and q == side and not got[i].base_failed) for side in (1, 0)]
    lowest = sides[0][int((1 - quality.KEEP_TRUSTED) * len(sides[0]))]
    cut = sides[1][min(len(sides[1]) - 1, int(np.ceil(quality.REJECT_OTHERS * len(sides[1]))))]
    threshold = min((cut + lowest) / 2, lowest)
    assert all(abs(r.threshold - threshold) < 1e-9 and r.kept == (not r.base_failed and r.score >= r.threshold) for r in got.values())


@pytest.mark.parametrize("broadcast_ids", [10, 0])
def test_quality_counts_all_trusted_texts(spark, broadcast_ids, monkeypatch):
    rows = [(i, f"word{i} good text", 1) for i in range(9)] + [(20 + i, f"noise{i} bad", 0) for i in range(9)] + [(None, "null id", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = docs.select("doc_id", "quality")
    fit, seen = quality.fit_weights, []
    monkeypatch.setattr(quality, "fit_weights", lambda d, trusted: seen.append(fit(d, trusted, broadcast_ids)) or seen[-1])
    quality.judge_quality(docs, labels, sample=2)
    assert seen == [fit(docs, labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id"))]


@pytest.mark.parametrize("sample", [20_000, 1])
def test_quality_threshold_counts_all_labelled_texts(spark, sample):
    """Also when scores are not collected; of a repeated id one text counts."""
    plain = " ".join(f"w{i}" for i in range(17))
    rows = [(i, f"{plain} {' '.join(f'{x}{i % 97}' for x in 'abcde')} {'good' if i % 2 else 'bad'}") for i in range(1, 2400)]
    docs = spark.createDataFrame([*rows, *rows[:300], (9001, "good"), (None, plain)], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows] + [(9001, 1), (None, 1), (5, None)], "doc_id long, quality int")
    weights = quality.fit_weights(docs, quality.trusted_ids(labels))
    score = {r.doc_id: r.score for r in docs.select("doc_id", quality.word_counts(F.col("text"), weights).score.alias("score")).collect()}
    good, bad = (sorted(score[i] for i, _ in rows if i % 2 == side) for side in (1, 0))
    limit, cut = good[int((1 - quality.KEEP_TRUSTED) * len(good))], bad[int(np.ceil(quality.REJECT_OTHERS * len(bad)))]
    assert len(set(good)) > 20 < len(set(bad))
    assert quality.fit_threshold(docs, labels, weights, sample) == min((cut + limit) / 2, limit)


def test_samples_bound_rows(spark, monkeypatch):
    """What reaches the driver is one row of each sampled id, however often it is repeated."""
    rows = [(i, f"text {i} of the house", "en", i % 2) for i in range(1, 40)] + [(3, f"copy {i} with other words", "en", 1) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int").repartition(4)
    sizes = []
    frame = type(docs)
    for name in ("toArrow", "collect"):
        monkeypatch.setattr(frame, name, lambda df, real=getattr(frame, name): [sizes.append((df.columns[0], len(x := real(df)))), x][1])
    labels = docs.select("doc_id", "toxic", F.col("toxic").alias("quality")).distinct()
    toxicity.fit_toxicity(docs, labels)
    languages.fit_languages(docs, sample=5)
    quality.fit_threshold(docs, labels, [0.0] * quality.BUCKETS)
    assert [n for name, n in sizes if name == "toxic"] == [39]
    assert [n for name, n in sizes if name == "lang"] == [5]
    assert [n for name, n in sizes if name == "good"] == [39]


def test_quality_tells_labelled_texts(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    judged = quality.judge_quality(docs, labels).join(labels, "doc_id").where(~F.col("base_failed"))
    rates = {r.quality: (r.kept, r.n) for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.count("*").alias("n")).collect()}
    assert rates[1][0] >= 0.99 and rates[0][0] <= 0.1


def test_ordinal_regression_orders_grades():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (1500, 1)), rng.normal(0, 1, (1500, 1))], 1)
    latent = 2 * x[:, 0] + rng.logistic(size=1500)
    grades = (latent > -1).astype(int) + (latent > 2)
    weights, cuts = toxicity.fit_ordinal(x, grades)
    assert abs(weights[0] - 2) < 0.3 and abs(weights[1]) < 0.2 and abs(cuts[0] + 1) < 0.3 and abs(cuts[1] - 2) < 0.35


def test_toxicity_on_texts_it_was_not_fitted_on(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2
    model = toxicity.fit_toxicity(docs, labels.where(fold == 0))
    graded = toxicity.grade_toxicity(docs.join(labels.where(fold == 1).select("doc_id", F.col("toxic").alias("label")), "doc_id"), model)
    rates = {r.label: r.found for r in graded.groupBy("label").agg(F.avg(F.col("toxic").cast("int")).alias("found")).collect()}
    assert rates[1] >= 0.75 and rates[0] <= 0.01  # about a fifth of the toxic labels are given to texts like any other


def test_toxicity_edge_cases(spark, docs):
    labels = spark.createDataFrame([(i, int(i > 6)) for i in range(1, 13)] + [(1, 1), (None, 1), (2, None), (999, 1)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    graded = toxicity.grade_toxicity(docs.withColumn("toxic", F.lit("clash")), model)
    assert graded.count() == docs.count() and dict(graded.dtypes)["toxic"] == "boolean"
    assert not graded.where(F.col("text").isNull() & F.col("toxic")).count()
    one = toxicity.fit_toxicity(docs, labels.where("toxic = 0"))
    assert toxicity.drop_toxic(docs, one).count() == docs.count()
    assert toxicity.fit_toxicity(docs.limit(0), labels.limit(0)).features.size == 0
    assert toxicity.drop_toxic(docs.limit(0), model).columns == docs.columns


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = QUERIES["op10_languages"](spark, "/root/testdata/sf0.01").join(docs, "doc_id")
    assert found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.97
    assert found.where("score < 0 or score > 1").count() == 0
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found.select("doc_id", "held_out").collect())


def test_languages_edge_cases(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = languages.fit_languages(docs)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 $%"), (4, "日本語"), (None, "the of and"), (5, "²³")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in languages.identify_languages(odd, model).collect()}
    assert got[1] == got[2] == got[3] == got[5] == ("und", 0.0) and got[4][0] != "und" and got[None][0] == "en"
    untaught = languages.identify_languages(odd, languages.fit_languages(docs.withColumn("lang", F.lit(None).cast("string"))))
    assert {(r.lang_pred, r.score) for r in untaught.collect()} == {("und", 0.0)}
    single = languages.identify_languages(odd, languages.fit_languages(docs.where("lang = 'de'")))
    assert {r.lang_pred for r in single.collect()} == {"de", "und"}


def test_pipeline_stages(spark):
    """Each stage's decision, on its own input, against the operator's plain version."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").withColumn("ids", F.lit("clash"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "pieces"]
    stages = dict(corpus_pipeline.STAGES)
    first = stages["toxicity"](spark, docs, SF_DIR)
    assert first.columns == docs.columns and first.count() <= docs.count()
    second = stages["near_duplicates"](spark, first, SF_DIR)
    rows = [(r.doc_id, r.text) for r in first.collect()]
    assert {r.doc_id for r in second.collect()} == {int(i) for i, _, _, kept in near_plain(rows, 5) if kept}
    third = stages["decontamination"](spark, second, SF_DIR)
    assert third.columns == docs.columns and third.count() < second.count()
    fourth = stages["secrets"](spark, third, SF_DIR)
    assert fourth.count() == third.count() and fourth.columns == docs.columns
    assert fourth.where(F.col("text").contains("[SECRET]")).count() > 0
    assert corpus_pipeline.run(spark, SF_DIR).count() == fourth.count()


def test_registered():
    import __spark_entry__

    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert len(QUERIES) == 13 and all(re.match(r"op\d+_", name) for name in QUERIES)
