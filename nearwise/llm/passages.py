"""Substring dedup: words are removed that lie in a window whose word sequence also starts somewhere else.

A count-min sketch over the whole corpus first tells which windows can be repeated at all; a second pass then groups only
those exactly. To keep both light, a window is counted by its anchor, the piece of twelve of its words that has the
least hash: equal windows have equal anchors, and neighbouring windows mostly share one, so there is about one anchor for
twelve words. A sketch never counts too little, so no repeated window is lost.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from nearwise.llm import words as w
from nearwise.session import materialize

WINDOW = 35
ANCHOR = 12
#: Cells of each of the two rows of the sketch: eight for each anchor that the input may hold, and at most 2**27 (a bit
#: each when it is broadcast, 32 MiB for both rows). A larger corpus fills the sketch more: more windows are then grouped
#: exactly, and the result is the same.
CELLS_PER_ANCHOR, LEAST_BITS, MOST_BITS = 8, 16, 27
SLICE_BITS = 8
#: Bytes of text for each anchor, about; only the size of the sketch follows from it.
BYTES_PER_ANCHOR = 64
#: Anchors a task gathers before it sends them to the sketch.
FLUSH = 1 << 20

_SECOND = w.odd_numbers(1, 30)[0]
_CONTEXT = w.odd_numbers(4, 31)

RUNS = "id long, tie long, anchor long, c1 long, c2 long, first int, n int, windows array<long>"


def repeated_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_words, n_removed, kept_sha256, kept``.

    Words are maximal runs without ASCII white space, unchanged. A word is removed if it lies in a window of ``window``
    words of one document whose word sequence starts at another place too, in the same or another document; windows are
    judged on the input. ``kept`` is the words that stay, joined by one space. A null or empty text has no words. Ids may
    be null or repeat: each row is an own document, and equal rows repeat each other. Other columns are not read.

    Windows are compared by a 64-bit hash within the group of their anchor's 64-bit hash. Copies are cheap: runs of
    windows about an anchor are counted as a whole by a 128-bit hash of all their words, and only anchors that stand in
    different surroundings are taken apart, one row for each surrounding. Every grouping is combined before it is shuffled.
    """
    if not ANCHOR <= window < ANCHOR + 63:
        raise ValueError(f"a window has {ANCHOR} to {ANCHOR + 62} words")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({
        "id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")),
        "tie": F.xxhash64("text", F.col("doc_id").isNull()),
    })
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, (CELLS_PER_ANCHOR * size // BYTES_PER_ANCHOR).bit_length()))
    sketch = docs.sparkSession.sparkContext.broadcast(_merged_sketch(rows, window, bits))
    found = rows.select("id", "tie", "text").mapInArrow(_suspects(window, bits, sketch), RUNS)
    spans = _repeats(materialize(found, "runs"))
    out = docs.select("doc_id").schema.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
    return rows.join(spans, ["id", "tie"], "left").select("doc_id", "text", "spans").mapInArrow(_remover(window), out)


def _merged_sketch(rows: DataFrame, window: int, bits: int) -> np.ndarray:
    """Which cells of the sketch have a count of two or more: two bitmaps of ``2**bits`` bits in a row.

    Each task sends the cells of its anchors, dealt into slices of the sketch; the slices are counted apart, one at a
    time, and only their bitmaps go to the driver. Their total size is bounded by ``MOST_BITS``.
    """
    sent = rows.select("text").mapInArrow(_cells(window, bits), "slice int, cells binary")
    slices = sent.repartition("slice").sortWithinPartitions("slice").mapInArrow(_count_slices(bits), "slice int, twice binary")
    width = 1 << (bits - SLICE_BITS)
    merged = np.zeros((2 << SLICE_BITS, width // 8), np.uint8)
    for row in slices.toLocalIterator():
        merged[row.slice] = np.frombuffer(row.twice, np.uint8)
    return merged.ravel()


def _repeats(runs: DataFrame) -> DataFrame:
    """For each ``(id, tie)`` with repeated windows, ``spans``: first window, number of windows, mask of the repeated."""
    keys = ["anchor", "c1", "c2"]
    around = runs.groupBy(*keys).agg(F.count("*").alias("times"), F.first("windows", ignorenulls=True).alias("windows"))
    around = materialize(around, "surroundings")
    mixed = around.groupBy("anchor").agg(F.count("*").alias("k")).where(F.col("k") > 1).select("anchor")
    apart = around.join(mixed, "anchor").select(*keys, "times", F.posexplode("windows").alias("i", "window"))
    apart = materialize(apart, "windows")
    twice = apart.groupBy("anchor", "window").agg(F.count("*").alias("k")).where(F.col("k") > 1).select("anchor", "window")
    partly = apart.where(F.col("times") == 1).join(twice, ["anchor", "window"])
    partly = partly.groupBy("c1", "c2").agg(F.sum(F.expr("shiftleft(1L, i)")).alias("mask"))
    wholly = around.where(F.col("times") > 1).select("c1", "c2", F.lit(-1).cast("long").alias("mask"))
    marked = runs.select("id", "tie", "c1", "c2", "first", "n").join(wholly.union(partly), ["c1", "c2"])
    return marked.groupBy("id", "tie").agg(F.collect_set(F.struct("first", "n", "mask")).alias("spans"))


class Runs:
    """The windows of a batch of texts, in runs of neighbours that have the same anchor."""

    def __init__(self, texts: pa.Array, window: int):
        self.words = found = w.Words(texts, w.SPACED)
        starts = w.window_starts(found.bounds, window)
        if not len(starts):
            self.first = self.n = self.at = np.zeros(0, np.int64)
            self.anchors = np.zeros(0, np.uint64)
            return
        self.hashes = found.hashes(5)
        anchors = w.Windows(self.hashes, 6).of(ANCHOR)
        place = _leftmost_least(anchors, window - ANCHOR + 1)[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
        begin = np.flatnonzero(new)
        self.first, self.at = starts[begin], place[begin]
        self.n = np.diff(np.append(begin, len(starts)))
        self.anchors = anchors[self.at]

    def contexts(self, chosen: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """A 128-bit hash of all words of each chosen run and of where its anchor stands."""
        first, end = self.first[chosen], self.first[chosen] + self.n[chosen] + window - 1
        shape = (self.at[chosen] - first).astype(np.uint64) * _CONTEXT[0] + self.n[chosen].astype(np.uint64) * _CONTEXT[1]
        out = []
        for i, (hashes, seed) in enumerate(((self.hashes, 8), (self.words.hashes(9), 10))):
            sums = w.Windows(hashes, seed)
            out.append(w.mix((sums.sums[end] - sums.sums[first]) * sums.back[first] + shape * _CONTEXT[2 + i]))
        return out[0], out[1]


def _leftmost_least(values: np.ndarray, size: int) -> np.ndarray:
    """For each place, where the least of the ``size`` values from there stands; the first of equal ones."""
    n, span = len(values), 1
    best = np.arange(n)
    if n < size:
        return best
    while 2 * span <= size:
        left, right = best[: n - 2 * span + 1], best[span : n - span + 1]
        best = np.where(values[left] <= values[right], left, right)
        span *= 2
    if span < size:
        left, right = best[: n - size + 1], best[size - span :][: n - size + 1]
        best = np.where(values[left] <= values[right], left, right)
    return best


def _places(anchors: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each anchor in both rows of the sketch; the second row follows the first."""
    down = np.uint64(64 - bits)
    return (anchors >> down).astype(np.int64), (w.mix(anchors * _SECOND) >> down).astype(np.int64) + (1 << bits)


def _cells(window: int, bits: int):
    inner = bits - SLICE_BITS

    def send(batches):
        held: list[np.ndarray] = []
        for batch in w.slices(batches):
            held.append(Runs(batch.column("text"), window).anchors)
            if sum(map(len, held)) >= FLUSH:
                yield flush(held)
                held = []
        if held:
            yield flush(held)

    def flush(held):
        cells = np.sort(np.concatenate(_places(np.concatenate(held), bits)))
        if len(cells) > 2:  # a third one of a task tells no more than two
            cells = cells[np.append([True, True], cells[2:] != cells[:-2])]
        slices = cells >> inner
        cuts = np.flatnonzero(np.diff(slices, prepend=-1))
        inside = (cells & ((1 << inner) - 1)).astype("<u4")
        blobs = [x.tobytes() for x in np.split(inside, cuts[1:])] if len(cuts) else []
        return pa.RecordBatch.from_arrays([pa.array(slices[cuts], pa.int32()), pa.array(blobs, pa.binary())], ["slice", "cells"])

    return send


def _count_slices(bits: int):
    width = 1 << (bits - SLICE_BITS)

    def count(batches):
        at, counts = None, None

        def done():
            return pa.RecordBatch.from_arrays(
                [pa.array([at], pa.int32()), pa.array([np.packbits(counts > 1).tobytes()], pa.binary())], ["slice", "twice"]
            )

        for batch in batches:
            for slice_, cells in zip(batch.column("slice").to_pylist(), batch.column("cells")):
                if slice_ != at:
                    if at is not None:
                        yield done()
                    at, counts = slice_, np.zeros(width, np.uint8)
                new = np.frombuffer(cells.as_buffer(), "<u4")
                one, n = np.unique(new, return_counts=True)
                counts[one] = np.minimum(counts[one] + n, 2)
        if at is not None:
            yield done()

    return count


def _suspects(window: int, bits: int, sketch):
    """The runs of windows whose anchor may occur twice. The windows of a run are sent once by each task."""

    def send(batches):
        twice, sent = sketch.value, set()
        for batch in w.slices(batches):
            runs = Runs(batch.column("text"), window)
            likely = np.ones(len(runs.anchors), bool)
            for cells in _places(runs.anchors, bits):
                likely &= (twice[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1).astype(bool)
            chosen = np.flatnonzero(likely)
            if not len(chosen):
                continue
            c1, c2 = runs.contexts(chosen, window)
            hashes = w.Windows(runs.hashes, 6).of(window)
            first, n = runs.first[chosen], runs.n[chosen]
            row = np.searchsorted(runs.words.bounds, first, "right") - 1
            if len(sent) > FLUSH:
                sent.clear()
            new = np.zeros(len(chosen), bool)
            for i, key in enumerate(zip(c1.tolist(), c2.tolist())):
                if key not in sent:
                    sent.add(key)
                    new[i] = True
            values = hashes[w.ranges(first[new], n[new])].view(np.int64)
            bounds = np.concatenate([[0], np.cumsum(np.where(new, n, 0))])
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values), mask=pa.array(~new))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(row)), batch.column("tie").take(pa.array(row)),
                    pa.array(runs.anchors[chosen].view(np.int64)), pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)),
                    pa.array(first - runs.words.bounds[row], pa.int32()), pa.array(n, pa.int32()), lists,
                ],
                ["id", "tie", "anchor", "c1", "c2", "first", "n", "windows"],
            )

    return send


def _remover(window: int):
    def remove(batches):
        for batch in w.slices(batches):
            found = w.Words(batch.column("text"), w.SPACED)
            removed, digests = [], []
            spelled = found.data.tobytes()
            for row, spans in enumerate(batch.column("spans")):
                a, b = int(found.bounds[row]), int(found.bounds[row + 1])
                text = spelled[found.text_bounds[row] : found.text_bounds[row + 1]]
                listed, gone = text.split(), 0
                if spans.is_valid:
                    starts = [s["first"] + i for s in spans.as_py() for i in range(s["n"]) if s["mask"] >> i & 1]
                    hit = w.covered(b - a, np.array(starts, np.int64), window)
                    gone = int(hit.sum())
                    listed = [listed[i] for i in np.flatnonzero(~hit).tolist()]
                removed.append(gone)
                digests.append(hashlib.sha256(b" ".join(listed)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return remove


cloudpickle.register_pickle_by_value(sys.modules[__name__])
