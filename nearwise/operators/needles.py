"""Which of many needles occur in texts, by hashes of all their places at once.

A text's bytes are summed up with growing powers of an odd number, so the hash of any piece of it is a difference of two
sums. Pieces as long as the beginnings of needles are looked up at every place, those found are looked up again in whole
length, and what is reported is compared byte by byte. The index takes the needles' bytes and some 50 bytes for each.
"""

from __future__ import annotations

import sys
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

#: Lengths in bytes of beginnings that are looked up; a needle goes by the longest that fits.
BEGINNINGS = (16, 8, 4, 2, 1)
#: Bytes of text that are summed up at a time.
STRIDE = 1 << 19
#: Bits of a hash that a table of beginnings is asked with first.
TABLE_BITS = 22


class Needles(NamedTuple):
    """Needles by ascending rank: their bytes, and the hashes of their beginnings and of their whole length."""

    data: np.ndarray
    bounds: np.ndarray
    power: int
    hashes: np.ndarray  # of whole needles, ascending
    ranks: np.ndarray  # the needles that ``hashes`` belong to
    beginnings: list[tuple]  # length, table, hashes, and of each hash the lengths of its needles (bounds and values)
    empty: int  # the rank of the empty needle, or the number of needles


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins and ends; null counts as empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw else np.empty(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


class Sums:
    """Sums over one stretch of bytes, from which the hash of any piece follows."""

    def __init__(self, data: np.ndarray, powers: np.ndarray, inverses: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=self.sums[1:])
        self.inverses = inverses

    def every(self, length: int, n: int) -> np.ndarray:
        """Hashes of the pieces of one length at the first ``n`` places."""
        return (self.sums[length : length + n] - self.sums[:n]) * self.inverses[:n]

    def at(self, places: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return (self.sums[places + lengths] - self.sums[places]) * self.inverses[places]


def powers_of(power: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number modulo 2^64, and what undoes them."""
    both = []
    for base in (power, pow(power, -1, 1 << 64)):
        steps = np.full(n + 1, base, np.uint64)
        steps[0] = 1
        both.append(np.cumprod(steps, dtype=np.uint64))
    return both[0], both[1]


def index_needles(texts: pa.Array) -> Needles:
    """The index of distinct needles, in order of rank."""
    data, bounds = bytes_of(texts)
    lengths, power = np.diff(bounds), 0x9E3779B97F4A7C15
    filled = np.flatnonzero(lengths)
    while True:
        hashes, starts = np.empty(len(lengths), np.uint64), np.empty((len(BEGINNINGS), len(lengths)), np.uint64)
        powers, inverses = powers_of(power, STRIDE + int(lengths.max(initial=0)))
        at = 0
        while at < len(lengths):  # whole needles, about a stride of them at a time
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + STRIDE, side="right")) - 1)
            sums = Sums(data[bounds[at] : bounds[end]], powers, inverses)
            places = bounds[at:end] - bounds[at]
            hashes[at:end] = sums.at(places, lengths[at:end])
            for row, size in enumerate(BEGINNINGS):
                starts[row, at:end] = sums.at(places, np.minimum(size, lengths[at:end]))
            at = end
        order = filled[np.argsort(hashes[filled], kind="stable")]
        if len(np.unique(hashes[filled])) == len(filled):
            break
        power = (power * 6364136223846793005 + 1442695040888963407) % (1 << 64) | 1  # two needles had one hash
    beginnings, longer = [], np.full(len(lengths), False)
    for row, size in enumerate(BEGINNINGS):
        chosen = np.flatnonzero((lengths >= size) & ~longer)
        longer |= lengths >= size
        if not len(chosen):
            continue
        pairs = np.unique(np.stack([starts[row, chosen], lengths[chosen].astype(np.uint64)]), axis=1)
        found, first = np.unique(pairs[0], return_index=True)
        table = np.zeros(1 << TABLE_BITS, bool)
        table[found >> np.uint64(64 - TABLE_BITS)] = True
        beginnings.append((size, table, found, np.append(first, pairs.shape[1]), pairs[1].astype(np.int64)))
    empty = np.flatnonzero(lengths == 0)
    return Needles(data, bounds, power, hashes[order], order, beginnings, int(empty[0]) if len(empty) else len(lengths))


def first_contained(texts: pa.Array, needles: Needles) -> np.ndarray:
    """For each text the lowest rank of a needle that it contains, or the number of needles; null contains none."""
    data, bounds = bytes_of(texts)
    none = len(needles.bounds) - 1
    best = np.full(len(texts), needles.empty)
    longest = int(np.diff(needles.bounds).max(initial=0))
    if needles.beginnings:
        powers, inverses = powers_of(needles.power, min(STRIDE, len(data)) + longest)
        for base in range(0, len(data), STRIDE):
            found = _found(data, base, bounds, needles, longest, powers, inverses)
            while len(found[0]):  # of each text the lowest rank, compared byte by byte
                rows, ranks, places = found
                order = np.lexsort((ranks, rows))
                rows, ranks, places = rows[order], ranks[order], places[order]
                first = np.flatnonzero(np.diff(rows, prepend=-1))
                wrong = np.zeros(len(rows), bool)
                for i in first:
                    start, stop = needles.bounds[ranks[i]], needles.bounds[ranks[i] + 1]
                    if ranks[i] >= best[rows[i]]:
                        continue
                    if np.array_equal(data[places[i] : places[i] + stop - start], needles.data[start:stop]):
                        best[rows[i]] = ranks[i]
                    else:
                        wrong[i] = True
                again = np.isin(rows, rows[wrong]) & ~wrong
                found = rows[again], ranks[again], places[again]
    best[~texts.is_valid().to_numpy(zero_copy_only=False)] = none
    return best


def _found(data, base, bounds, needles, longest, powers, inverses) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts, ranks and places of the needles whose hashes occur at the places of a stride."""
    piece = data[base : base + STRIDE + longest]
    sums, out = Sums(piece, powers, inverses), []
    for size, table, hashes, firsts, lengths in needles.beginnings:
        n = min(STRIDE, len(piece) - size + 1)
        if n <= 0:
            continue
        every = sums.every(size, n)
        places = np.flatnonzero(table[every >> np.uint64(64 - TABLE_BITS)])
        at = np.minimum(np.searchsorted(hashes, every[places]), len(hashes) - 1)
        same = hashes[at] == every[places]
        places, at = places[same], at[same]
        times = firsts[at + 1] - firsts[at]
        if not times.sum():
            continue
        turn = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        size_of = lengths[np.repeat(firsts[at], times) + turn]
        places = np.repeat(places, times)
        rows = np.searchsorted(bounds, base + places, side="right") - 1
        inside = base + places + size_of <= bounds[rows + 1]
        places, size_of, rows = places[inside], size_of[inside], rows[inside]
        whole = sums.at(places, size_of)
        at = np.minimum(np.searchsorted(needles.hashes, whole), len(needles.hashes) - 1)
        rank = needles.ranks[at]
        same = (needles.hashes[at] == whole) & (np.diff(needles.bounds)[rank] == size_of)
        out.append((rows[same], rank[same], base + places[same]))
    return tuple(np.concatenate(parts) for parts in zip(*out)) if out else (np.empty(0, np.int64),) * 3


cloudpickle.register_pickle_by_value(sys.modules[__name__])
