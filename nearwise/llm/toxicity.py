"""Toxicity as an ordered grade: cumulative-link regression on few hashed words that stand out in toxic texts."""

from __future__ import annotations

import sys
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from nearwise.llm import words as w
from nearwise.llm.grams import Grams, one_text_each

#: Labelled documents of each class that the model is fitted on, those of lowest hash.
SAMPLE = 3000
#: The most features; each must be this pure and explain so many toxic documents that no feature before it does.
MOST_FEATURES, PURITY, LEAST_NEW = 400, 0.97, 3
#: Grades: 0 not toxic; toxic documents are 1 or 2, by whether their share of marker words is below their median.
GRADES = 3
#: Probability of grade 1 or more from which a document is toxic.
LIMIT = 0.5
STEPS, RATE, RIDGE = 400, 0.1, 1e-4


class ToxicityModel(NamedTuple):
    """P(grade >= k) = logistic(weights . x - cuts[k - 1]): one weight for each feature, shared by all cuts.

    x is, for each of the hashed ``features``, whether the text has it, and last ``log(1 + 100 * share)`` of the words
    that are one.
    """

    features: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """Fit on at most ``sample`` toxic and ``sample`` other labelled documents; only their hashed words leave the tasks.

    Labels that are null or name no document are left out, and so is an id labelled both ways. Without toxic or without
    other documents the model finds nothing toxic. Of a repeated id one row is learned from.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(
        F.min("toxic").alias("low"), F.max("toxic").alias("high")
    ).where("low = high")
    ids = [
        known.where(F.col("low") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        .select(F.col("doc_id").alias("labelled"), F.lit(toxic).alias("toxic"))
        for toxic in (0, 1)
    ]
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids[0].union(ids[1])), F.col("doc_id") == F.col("labelled"))
    found = one_text_each(chosen, "labelled", "toxic").select("toxic", "text").mapInArrow(_sampler(), "toxic int, grams binary, codes binary").toArrow()
    toxic = found["toxic"].to_numpy() == 1
    if toxic.all() or not toxic.any():
        return ToxicityModel(np.zeros(0, np.uint32), np.zeros(1), np.full(GRADES - 1, np.inf))
    features = select_features([np.frombuffer(x.as_py(), np.uint32) for x in found["grams"]], toxic)
    codes = [np.frombuffer(x.as_py(), np.uint32).reshape(1 + 3, -1) for x in found["codes"]]
    x = np.stack([_row(c, features) for c in codes]) if len(codes) else np.zeros((0, len(features) + 1))
    share = x[:, -1]
    grades = np.where(toxic, np.where(share < np.median(share[toxic]), 1, 2), 0)
    return ToxicityModel(features, *fit_ordinal(x, grades))


def select_features(grams: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Greedily, the pure feature of the most toxic texts that have none yet; of equal ones the lowest hash."""
    sizes = np.array([len(g) for g in grams])
    names, codes = np.unique(np.concatenate(grams), return_inverse=True)
    owner = np.repeat(np.arange(len(grams)), sizes)
    all_toxic = np.bincount(codes[toxic[owner]], minlength=len(names))
    others = np.bincount(codes[~toxic[owner]], minlength=len(names)) * (toxic.sum() / (~toxic).sum())
    pure = all_toxic >= PURITY * (all_toxic + others)
    keep = pure[codes] & toxic[owner]
    codes, owner = codes[keep], owner[keep]
    chosen: list[int] = []
    while len(codes) and len(chosen) < MOST_FEATURES:
        count = np.bincount(codes, minlength=len(names))
        best = int(count.argmax())
        if count[best] < LEAST_NEW:
            break
        chosen.append(best)
        done = np.zeros(len(grams), bool)
        done[owner[codes == best]] = True
        rest = ~done[owner]
        codes, owner = codes[rest], owner[rest]
    return np.sort(names[chosen])


def fit_ordinal(x: np.ndarray, grades: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and cuts of the proportional-odds model, by gradient steps with running moments (Adam)."""
    n_cuts = GRADES - 1
    # cuts[0], then the logarithms of the gaps, so that the cuts stay in order
    state = np.concatenate([np.zeros(x.shape[1]), [0.0], np.zeros(n_cuts - 1)])
    first, second = np.zeros_like(state), np.zeros_like(state)
    for step in range(1, STEPS + 1):
        weights, gaps = state[: x.shape[1]], np.exp(state[x.shape[1] + 1 :])
        cuts = np.cumsum(np.concatenate([[state[x.shape[1]]], gaps]))
        z = (x @ weights)[:, None] - cuts
        above = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        gradient = np.zeros_like(state)
        upto = np.concatenate([np.ones((len(x), 1)), above, np.zeros((len(x), 1))], 1)
        rows = np.arange(len(x))
        p = np.maximum(upto[rows, grades] - upto[rows, grades + 1], 1e-12)
        slope = above * (1 - above)
        slopes = np.concatenate([np.zeros((len(x), 1)), slope, np.zeros((len(x), 1))], 1)
        d_z = -(slopes[rows, grades] - slopes[rows, grades + 1]) / p
        gradient[: x.shape[1]] = x.T @ d_z / len(x) + RIDGE * weights
        d_cut = np.zeros((len(x), n_cuts))
        for k in range(n_cuts):
            d_cut[:, k] = slope[:, k] / p * np.where(grades == k + 1, 1, np.where(grades == k, -1, 0))
        d_cut = d_cut.mean(0)
        gradient[x.shape[1]] = d_cut.sum()
        for k in range(1, n_cuts):
            gradient[x.shape[1] + k] = gaps[k - 1] * d_cut[k:].sum()
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        state = state - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    gaps = np.exp(state[x.shape[1] + 1 :])
    return state[: x.shape[1]], np.cumsum(np.concatenate([[state[x.shape[1]]], gaps]))


def grade_toxicity(docs: DataFrame, model: ToxicityModel, limit: float = LIMIT) -> DataFrame:
    """``docs`` with ``severity`` (the expected grade, 0 to 2), ``p_toxic`` (of grade 1 or more) and ``toxic``.

    Every row is graded for itself, where it lies, on its whole text; a null or empty text has no words and is not toxic.
    Ids may be null or repeat. Columns of these three names are replaced.
    """
    names = [n for n in docs.columns if n not in ("severity", "p_toxic", "toxic")]
    plain = docs.select(*(F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)))
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))
    out = StructType([*plain.schema, *(StructField(n, t) for n, t in (("severity", DoubleType()), ("p_toxic", DoubleType()), ("toxic", BooleanType())))])
    return plain.mapInArrow(_grader(shared, f"c{names.index('text')}", limit), out).toDF(*names, "severity", "p_toxic", "toxic")


def drop_toxic(docs: DataFrame, model: ToxicityModel, limit: float = LIMIT) -> DataFrame:
    """``docs`` without the rows that ``grade_toxicity`` calls toxic. Other rows and all columns stay as they are."""
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))
    return plain.mapInArrow(_grader(shared, f"c{names.index('text')}", limit, drop=True), plain.schema).toDF(*names)


def _row(codes: np.ndarray, features: np.ndarray) -> np.ndarray:
    """The features of one text, from the codes of its words."""
    row = np.zeros(len(features) + 1)
    if codes.size and len(features):
        at = np.minimum(np.searchsorted(features, codes), len(features) - 1)
        hit = features[at] == codes
        row[np.unique(at[hit])] = 1
        row[-1] = np.log1p(100 * hit.any(0).sum() / codes.shape[1])
    return row


def _sampler():
    def sample(batches):
        for batch in w.slices(batches):
            grams = Grams(batch.column("text"))
            cuts = grams.words.bounds.tolist()
            codes = [np.ascontiguousarray(grams.codes[:, a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            sets = [x.tobytes() for x in grams.distinct()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array(sets, pa.binary()), pa.array(codes, pa.binary())], ["toxic", "grams", "codes"]
            )

    return sample


def _grader(shared, column: str, limit: float, drop: bool = False):
    def grade(batches):
        features, weights, cuts = shared.value
        screen = np.zeros(1 << 16, bool)
        screen[features >> 16] = True
        for batch in w.slices(batches, column):
            grams = Grams(batch.column(column))
            x = np.zeros((batch.num_rows, len(weights)))
            some = np.flatnonzero(screen[grams.codes >> 16].any(0))
            bounds = grams.words.bounds
            for row in np.unique(np.searchsorted(bounds, some, "right") - 1).tolist():
                x[row] = _row(grams.codes[:, bounds[row] : bounds[row + 1]], features)
            above = 1 / (1 + np.exp(-np.clip((x @ weights)[:, None] - cuts, -40, 40)))
            marked = x[:, -1] > 0  # without any marker a text is not toxic, whatever the cuts are
            above *= marked[:, None]
            if drop:
                yield batch.filter(pa.array(above[:, 0] < limit))
                continue
            for name, values in (("severity", above.sum(1)), ("p_toxic", above[:, 0]), ("toxic", above[:, 0] >= limit)):
                batch = batch.append_column(name, pa.array(values))
            yield batch

    return grade


cloudpickle.register_pickle_by_value(sys.modules[__name__])
