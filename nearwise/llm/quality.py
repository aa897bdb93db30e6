"""Quality rules in column expressions: base counts, and how much likelier a text is in a trusted corpus than in all."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from nearwise.session import materialize

SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
#: Buckets of hashed word unigrams and bigrams.
BUCKETS = 1 << 14
#: Labelled documents of each class whose scores may be collected; of more, scores are counted to find the threshold.
COLLECTED = 20_000
#: Parts of a unit that scores are counted in first; a part holds no more than a thousand scores of six decimals.
PARTS = 1000
#: Trusted ids that may be broadcast (8 bytes each).
BROADCAST_IDS = 1_000_000
#: The share of trusted documents that the threshold must keep, and of the others that it need not go beyond.
KEEP_TRUSTED = 0.999
REJECT_OTHERS = 0.98
TARGET_PRIOR = 1.0


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body or a lambda in it uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+``."""
    return F.array_remove(F.split(F.translate(text, SPACE_CHARS[1:], " " * 5), " "), "")


def word_hashes(text: Column) -> Column:
    return F.transform(words_of(text), lambda word: F.xxhash64(word))


def combined(hashes: Column, step: int) -> Column:
    """The hash of each two numbers that are ``step`` places apart."""
    n = F.greatest(F.size(hashes) - step, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))


def bucket_of(gram: Column) -> Column:
    return F.pmod(gram, F.lit(BUCKETS)).cast("int")


def repeated_words(hashes: Column, pairs: Column) -> Column:
    """How many words lie in windows of ``WINDOW`` words that the text holds twice or more.

    Windows are compared by 64-bit hashes, of pairs of hashes of pairs of hashes of pairs of words. Most texts repeat none,
    which the number of distinct hashes tells; only for the others are the windows sorted to find the repeated ones and what
    they cover.
    """
    windows = bind(combined(pairs, 2), lambda fours: combined(fours, 4))
    return F.when(F.size(hashes) < WINDOW, F.lit(0).cast("long")).otherwise(bind(windows, _covered_by_repeats))


def _covered_by_repeats(windows: Column) -> Column:
    def from_sorted(found: Column) -> Column:
        repeats = F.filter(
            found,
            lambda s, k: (s.h == F.get(found, k + 1).h) | F.coalesce((k > 0) & (s.h == F.get(found, F.greatest(k - 1, F.lit(0))).h), F.lit(False)),
        )
        return F.array_sort(F.transform(repeats, lambda s: s.at))

    def count(starts: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("end"))
        step = lambda acc, at: F.struct(
            (acc.n + F.least(F.lit(WINDOW), at + WINDOW - acc.end)).alias("n"), (at + WINDOW).alias("end")
        )
        return F.aggregate(starts, zero, step, lambda acc: acc.n)

    ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(
        count(bind(ordered, from_sorted))
    )


def base_columns(text: Column) -> dict[str, Column]:
    """The counts of a text that need no hashes of its words."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, SPACE_CHARS, "")) > 0)
    return {
        "word_chars": F.length(F.translate(text, SPACE_CHARS, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": bind(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
    }


def word_counts(text: Column, weights: list[float]) -> Column:
    """``n_words``, ``n_repeat_words`` and the ``score``, the mean weight of the text's grams (0 without words)."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in weights)), ",").cast("array<double>")
    plus = lambda total, gram: total + F.get(table, bucket_of(gram))
    total = lambda h, p: F.aggregate(p, F.aggregate(h, F.lit(0.0), plus), plus)
    return bind(
        word_hashes(text),
        lambda h: bind(
            combined(h, 1),
            lambda p: F.struct(
                F.size(h).cast("long").alias("n_words"), repeated_words(h, p).alias("n_repeat_words"),
                F.round(total(h, p) / F.greatest(F.size(h) + F.size(p), F.lit(1)), 6).alias("score"),
            ),
        ),
    )


def base_failed(counts: Column) -> Column:
    """Whether a text has too few words or repeats too many of them."""
    return (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEATED_PERCENT * counts["n_words"])


def trusted_ids(labels: DataFrame) -> DataFrame:
    """``doc_id`` of all documents labelled good."""
    return labels.where("quality = 1").where(F.col("doc_id").isNotNull()).select("doc_id").distinct()


def fit_weights(docs: DataFrame, trusted: DataFrame, broadcast_ids: int = BROADCAST_IDS) -> list[float]:
    """The log-likelihood ratio of each bucket: trusted corpus against all documents, both multinomials.

    The raw corpus is every document; the trusted one is all documents whose ids are in ``trusted``, which holds each id
    once. Up to ``broadcast_ids`` of them are broadcast; more are joined by shuffle. Grams are counted in each task before anything is shuffled, so the shuffle is at most one row for each
    task and bucket. Trusted counts are smoothed towards the raw ones, so a bucket that was never seen weighs nothing.
    """
    few = trusted.limit(broadcast_ids + 1).count() <= broadcast_ids
    ids = trusted.select(F.col("doc_id").alias("trusted_id"))
    ids = F.broadcast(ids) if few else ids.hint("merge")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.join(ids, F.col("doc_id") == F.col("trusted_id"), "left")
    grams = rows.select(
        F.col("trusted_id").isNotNull().cast("long").alias("good"),
        F.explode(bind(word_hashes(F.col("text")), lambda h: F.concat(h, combined(h, 1)))).alias("gram"),
    )
    counts = grams.groupBy(bucket_of(F.col("gram")).alias("bucket")).agg(F.sum("good").alias("good"), F.count("*").alias("n")).collect()  # <= BUCKETS rows
    total, good = sum(r.n for r in counts), sum(r.good for r in counts)
    weights = [0.0] * BUCKETS
    for r in counts:
        raw = r.n / total
        weights[r.bucket] = math.log((r.good + TARGET_PRIOR * BUCKETS * raw) / (good + TARGET_PRIOR * BUCKETS)) - math.log(raw)
    return weights


def judged_rows(docs: DataFrame, weights: list[float]) -> DataFrame:
    """Stored, one row for each of ``docs``: the base counts, ``base_failed``, the ``score`` and a hash of the text."""
    text = F.col("text")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = rows.select(
        "doc_id", *(c.alias(n) for n, c in base_columns(text).items()), word_counts(text, weights).alias("counts"), F.xxhash64(text).alias("text_hash")
    )
    return materialize(
        base.select(
            "doc_id", "counts.n_words", "word_chars", "n_symbols", "n_dup_lines", "counts.n_repeat_words",
            base_failed(F.col("counts")).alias("base_failed"), "counts.score", "text_hash",
        ),
        "judged",
    )


def labelled_scores(judged: DataFrame, labels: DataFrame) -> DataFrame:
    """``good``, ``score`` and ``failed`` of every labelled document, stored; of a repeated id the text of lowest hash counts."""
    known = labels.where("quality IN (0, 1)").where(F.col("doc_id").isNotNull())
    known = known.select("doc_id", (F.col("quality") == 1).alias("good")).distinct()
    one = F.min(F.struct("text_hash", "score", "base_failed")).alias("one")
    found = judged.select("doc_id", "text_hash", "score", "base_failed").join(known, "doc_id").groupBy("doc_id", "good").agg(one)
    return materialize(found.select("good", "one.score", F.col("one.base_failed").alias("failed")), "labelled-scores")


def threshold_of(scored: DataFrame, sample: int = COLLECTED) -> float:
    """The lowest score to keep (see :func:`fit_threshold`), from ``good``, ``score`` and ``failed`` of all labelled documents.

    More than ``2 * sample`` rows are counted by parts of scores, then by scores in the part of each class that has the
    wanted rank, so the driver gets as many rows as there are such parts and scores, never one for each document.
    """
    if scored.limit(2 * sample + 1).count() <= 2 * sample:
        found = scored.collect()
        good, bad = (Counter(r.score for r in found if r.good == side and not r.failed) for side in (True, False))
        if not good or not bad:
            return -math.inf
        limit, cut = _at(good, _rank_kept(good.total()))[0], _at(bad, _rank_rejected(bad.total()))[0]
        return min((cut + limit) / 2, limit)
    parts = scored.where("NOT failed").withColumn("part", F.floor(F.col("score") * PARTS))
    counts = parts.groupBy("part", "good").agg(F.count("*").alias("n")).collect()
    good, bad = (Counter({r.part: r.n for r in counts if r.good == side}) for side in (True, False))
    if not good or not bad:
        return -math.inf
    (good_part, good_rest), (bad_part, bad_rest) = _at(good, _rank_kept(good.total())), _at(bad, _rank_rejected(bad.total()))
    inside = parts.where((F.col("part") == good_part) & F.col("good") | (F.col("part") == bad_part) & ~F.col("good"))
    counts = inside.groupBy("score", "good").agg(F.count("*").alias("n")).collect()
    good, bad = (Counter({r.score: r.n for r in counts if r.good == side}) for side in (True, False))
    limit, cut = _at(good, good_rest)[0], _at(bad, bad_rest)[0]
    return min((cut + limit) / 2, limit)


def _rank_kept(n: int) -> int:
    return int((1 - KEEP_TRUSTED) * n)


def _rank_rejected(n: int) -> int:
    return min(n - 1, math.ceil(REJECT_OTHERS * n))


def _at(counts: Counter, rank: int) -> tuple[float, int]:
    """The value of a rank (from 0) among counted values, and its rank among the equal ones."""
    for value in sorted(counts):
        if rank < counts[value]:
            return value, rank
        rank -= counts[value]
    raise IndexError(rank)


def fit_threshold(docs: DataFrame, labels: DataFrame, weights: list[float], sample: int = COLLECTED) -> float:
    """The lowest score to keep: one that rejects ``REJECT_OTHERS`` of the labelled bad texts, halfway to the lowest
    scores of good ones if there is a gap, and never one that rejects more than ``1 - KEEP_TRUSTED`` of the good ones.

    All labelled documents that pass the base rules count, of a repeated id one row. ``sample`` says only how many scores of
    each class may be collected; with more of them the result is the same.
    """
    return threshold_of(labelled_scores(judged_rows(docs, weights), labels), sample)


def judge_quality(docs: DataFrame, labels: DataFrame, sample: int = COLLECTED) -> DataFrame:
    """One row for each row of ``docs``: the base counts, ``base_failed``, the ``score`` and whether it is ``kept``.

    Columns: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, threshold,
    kept``. Every document is decided by the same fixed threshold. Grams are counted over all documents labelled good, and
    the threshold is fitted on all labelled documents (``sample``: see :func:`fit_threshold`). All is column expressions: texts
    are scanned where they lie, once to count grams and once to score, and the scores are stored; texts are shuffled only to be
    counted with more trusted ids than can be broadcast.

    A null text counts as empty and fails the base rules. Ids may be null or repeat; a repeated trusted id makes each of
    its rows trusted. Without labelled documents of both classes the score decides nothing. Of other columns only
    ``doc_id``, ``text`` and the labels' ``doc_id`` and ``quality`` are read.
    """
    judged = judged_rows(docs, fit_weights(docs, trusted_ids(labels)))
    threshold = threshold_of(labelled_scores(judged, labels), sample)
    return judged.drop("text_hash").withColumn("threshold", F.lit(threshold)).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
