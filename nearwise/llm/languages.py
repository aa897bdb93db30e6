"""Language identification: the family first, then one-versus-one linear support vector machines within it."""

from __future__ import annotations

import itertools
import sys
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from nearwise.llm import words as w
from nearwise.llm.grams import LETTERS, one_text_each

#: Families of closely related languages, by code; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "pl", "cs", "uk", "bg", "sr", "hr", "sk", "sl", "mk", "be", "bs"),
    "celtic": ("ga", "cy", "br", "gd"),
    "uralic": ("fi", "et", "hu"),
}
UNKNOWN = "und"
#: Labelled documents of each language that the machines are fitted on, those of lowest hash.
SAMPLE = 1000
#: Buckets for hashed letter trigrams, and as many for hashed words.
BUCKETS = 1 << 12
STEPS, RIDGE = 300, 1e-4
#: Margins are scaled by this before they become a probability.
SLOPE = 2.0

_MIX = w.odd_numbers(2, 50)


class Machine(NamedTuple):
    """A linear machine: positive margins speak for the classes ``yes``, negative ones for ``no``."""

    yes: str
    no: str
    weights: np.ndarray
    bias: float


class LanguageModel(NamedTuple):
    """``families`` maps a family to its languages; one machine for each pair of families, and of languages in one."""

    families: dict
    between: list
    within: dict


def held_out(doc_id: Column) -> Column:
    """Whether a document is never learned from: crc32 of its id as text leaves 2 when divided by 4. False for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_languages(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """Fit on at most ``sample`` documents of each language among those not held out, whose ``lang`` is not null.

    Only ``text`` and ``lang`` are learned from, and of rows of the same id and ``lang`` one. What leaves the tasks is the hashed features of the sample.
    """
    named = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = named.select("doc_id", "lang").distinct().select("doc_id", "lang", place.alias("place")).where(F.col("place") <= sample)
    ids = ids.select(F.col("doc_id").alias("sampled"), "lang")
    rows = docs.select("doc_id", "text", "lang").withColumnRenamed("lang", "own")
    rows = rows.join(F.broadcast(ids), (F.col("doc_id") == F.col("sampled")) & (F.col("own") == F.col("lang")))
    found = one_text_each(rows, "sampled", "lang").select("lang", "text").mapInArrow(_sampler, "lang string, buckets binary, counts binary").toArrow()
    langs = np.array(found["lang"].to_pylist(), object)
    x = np.zeros((len(langs), 2 * BUCKETS), np.float32)
    for row, (buckets, counts) in enumerate(zip(found["buckets"], found["counts"])):
        x[row, np.frombuffer(buckets.as_py(), np.int32)] = np.frombuffer(counts.as_py(), np.int32)
        for half in (x[row, :BUCKETS], x[row, BUCKETS:]):  # shares among the trigrams, and among the words
            half *= SCALE / max(1.0, half.sum())
    keep = x.any(1)
    langs, x = langs[keep], x[keep]
    home = {lang: family for family, members in FAMILIES.items() for lang in members}
    families: dict[str, list[str]] = {}
    for lang in sorted(set(langs.tolist())):
        families.setdefault(home.get(lang, lang), []).append(lang)
    owner = np.array([home.get(lang, lang) for lang in langs], object)
    between = [_fit(x, owner, a, b) for a, b in itertools.combinations(sorted(families), 2)]
    within = {f: [_fit(x, langs, a, b) for a, b in itertools.combinations(members, 2)] for f, members in families.items()}
    return LanguageModel(families, between, within)


def _fit(x: np.ndarray, classes: np.ndarray, yes: str, no: str) -> Machine:
    """A linear machine with squared hinge loss, by accelerated gradient steps; both classes weigh the same."""
    rows = np.flatnonzero((classes == yes) | (classes == no))
    x, y = x[rows], np.where(classes[rows] == yes, 1.0, -1.0).astype(np.float32)
    weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum()).astype(np.float32)
    step = 1 / (2 * float((weight * ((x * x).sum(1) + 1)).sum()) + RIDGE)
    w_, b, v, vb, t = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1], np.float32), 0.0, 1.0
    for _ in range(STEPS):
        slack = np.maximum(0, 1 - y * (x @ v + vb)) * weight * y
        new, new_b = v + step * (2 * (slack @ x) - RIDGE * v), vb + step * 2 * float(slack.sum())
        following = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, vb = new + (t - 1) / following * (new - w_), new_b + (t - 1) / following * (new_b - b)
        w_, b, t = new, new_b, following
    return Machine(yes, no, w_, b)


def identify_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` of every row, from the whole text alone.

    The family is the one that wins most of its machines against other families (of equal ones that of larger summed
    margins), then the language likewise among the family's. The score is the product of the two winners' mean
    probabilities. A text that is null or has no letter is ``und`` with score 0, and so is every text if nothing could be
    learned. Rows are answered where they lie; ids may be null or repeat; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(_plain(model)))
    out = docs.select("doc_id").schema.add("lang_pred", "string").add("score", "double")
    return docs.select("doc_id", "text").mapInArrow(_identifier(shared), out)


def _plain(model: LanguageModel):
    return model.families, [tuple(m) for m in model.between], {f: [tuple(m) for m in ms] for f, ms in model.within.items()}


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the letter trigrams and of the words of all texts, each with the bounds of the texts.

    Trigrams are three bytes of lower-cased text in which every run of other characters than letters is one space.
    """
    found = w.Words(pc.utf8_lower(texts), LETTERS)
    words = (found.hashes(51) >> np.uint64(52)).astype(np.int32) + BUCKETS
    # each word between spaces: the bytes before and after it count as a space
    lengths = found.ends - found.starts
    n = lengths + 2
    at = w.ranges(found.starts - 1, n)
    firsts = np.cumsum(n) - n
    data = found.data[np.clip(at, 0, max(len(found.data) - 1, 0))] if len(at) else np.zeros(0, np.uint8)
    data = data.astype(np.uint64)
    data[firsts] = data[firsts + n - 1] = 32
    codes = data[:-2] | data[1:-1] << np.uint64(8) | data[2:] << np.uint64(16) if len(data) > 2 else np.zeros(0, np.uint64)
    inner = np.ones(len(codes), bool)  # no trigram runs from one word into the next
    ends = firsts[1:]
    inner[ends - 1] = False
    inner[ends - 2] = False
    trigrams = ((w.mix(codes * _MIX[0]) >> np.uint64(52)).astype(np.int32))[inner]
    word_trigrams = np.concatenate([[0], np.cumsum(lengths)])  # a word of n bytes has n trigrams
    return trigrams, word_trigrams[found.bounds], words, found.bounds


#: Shares are small numbers; scaled like this the machines' weights stay moderate.
SCALE = 10.0


def _sampler(batches):
    for batch in w.slices(batches):
        trigrams, cuts, words, bounds = features(batch.column("text"))
        rows = [
            np.unique(np.concatenate([trigrams[cuts[i] : cuts[i + 1]], words[bounds[i] : bounds[i + 1]]]), return_counts=True)
            for i in range(batch.num_rows)
        ]
        columns = [pa.array([side.astype(np.int32).tobytes() for side in sides], pa.binary()) for sides in zip(*rows)]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), *columns], ["lang", "buckets", "counts"])


def _means(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(1, np.diff(bounds))


def _contest(names: list[str], machines: list[tuple], margins: list[np.ndarray], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the place in ``names`` of the winner, and its mean probability over its machines."""
    wins, total, chance = (np.zeros((rows, len(names))) for _ in range(3))
    for (yes, no, _, _), margin in zip(machines, margins):
        a, b = names.index(yes), names.index(no)
        p = 1 / (1 + np.exp(-np.clip(SLOPE * margin, -40, 40)))
        wins[:, a] += margin > 0
        wins[:, b] += margin <= 0
        total[:, a] += margin
        total[:, b] -= margin
        chance[:, a] += p
        chance[:, b] += 1 - p
    best = (wins + 1e-3 * np.tanh(total / 100)).argmax(1)
    share = chance[np.arange(rows), best] / (len(names) - 1) if len(names) > 1 else np.ones(rows)
    return best, share


def has_letter(texts: pa.Array) -> np.ndarray:
    """Whether a text has any letter."""
    ascii_letter = pc.fill_null(pc.match_substring_regex(texts, "[A-Za-z]"), False).to_numpy(zero_copy_only=False)
    rest = np.flatnonzero(~ascii_letter)
    out = ascii_letter.copy()
    for row in rest.tolist():
        text = texts[row].as_py()
        out[row] = bool(text) and any(c.isalpha() for c in text)
    return out


def _identifier(shared):
    def identify(batches):
        families, between, within = shared.value
        names = sorted(families)
        for batch in w.slices(batches):
            texts, rows = batch.column("text"), batch.num_rows
            trigrams, cuts, words, bounds = features(texts)

            def margins(machines):
                return [
                    SCALE * (_means(weights[trigrams], cuts) + _means(weights[words], bounds)) + bias
                    for _, _, weights, bias in machines
                ]

            lang, score = np.full(rows, UNKNOWN, object), np.zeros(rows)
            if names:
                family, share = _contest(names, between, margins(between), rows)
                for place, name in enumerate(names):
                    own = family == place
                    if own.any():
                        best, inner = _contest(families[name], within[name], margins(within[name]), rows)
                        lang[own] = np.array(families[name], object)[best[own]]
                        score[own] = (share * inner)[own]
            silent = ~has_letter(texts)
            lang[silent], score[silent] = UNKNOWN, 0.0
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lang.tolist(), pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"]
            )

    return identify


cloudpickle.register_pickle_by_value(sys.modules[__name__])
