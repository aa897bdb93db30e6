"""Words and word windows of whole Arrow batches, as numpy arrays of byte positions and 64-bit hashes.

Texts are handled as UTF-8 bytes: both word rules used here treat every byte of a non-ASCII character as a word
byte, so splitting bytes and splitting characters give the same words.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

#: Texts are worked on in slices of about this size, so that temporary arrays stay small whatever a batch holds.
SLICE_BYTES = 2 << 20


def per_process(key: tuple, make: Callable[[], object]) -> object:
    """An object that a Python worker makes once and keeps for all its tasks.

    Functions are shipped to workers by value, without the state of their modules, so the object hangs on ``sys``.
    """
    held = vars(sys).setdefault("_nearwise_held", {})
    if key not in held:
        held[key] = make()
    return held[key]


def release() -> None:
    """Give memory that is not in use back to the system: a worker outlives its tasks, and others need the room."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 booleans that is false exactly inside ``ranges``."""
    table = np.ones(256, bool)
    for first, last in ranges:
        table[first : last + 1] = False
    return table


#: Bytes of the words ``[^\x20\x09-\x0D]+``.
SPACED = byte_class((0x20, 0x20), (0x09, 0x0D))
#: Bytes of the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text: letters, digits and all beyond ASCII.
ALPHANUMERIC = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: Maps A-Z to a-z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of text; a longer text is a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        filled = np.cumsum(lengths)
        start = 0
        while start < batch.num_rows:
            before = filled[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(filled, before + size, "right")))
            yield batch.slice(start, end - start)
            start = end


def flat(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings in a row, and the ``len + 1`` bounds of the strings; a null counts as empty."""
    if strings.null_count:
        strings = strings.fill_null("")
    wide = pa.types.is_large_string(strings.type) or pa.types.is_large_binary(strings.type)
    _, offsets, data = strings.buffers()
    kind, width = (np.int64, 8) if wide else (np.int32, 4)
    bounds = np.frombuffer(offsets, kind, len(strings) + 1, strings.offset * width).astype(np.int64)
    if data is None or not len(strings):
        return np.zeros(0, np.uint8), np.zeros(len(strings) + 1, np.int64)
    return np.frombuffer(data, np.uint8, int(bounds[-1] - bounds[0]), int(bounds[0])), bounds - bounds[0]


class Words:
    """The words of consecutive texts: ``starts`` and ``ends`` in ``data``; text i has words bounds[i]:bounds[i+1]."""

    def __init__(self, strings: pa.Array, kept: np.ndarray, lower: bool = False):
        self.data, self.text_bounds = flat(strings)
        if lower:
            self.data = LOWER[self.data]
        inside = kept[self.data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = self.text_bounds[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(inside))]  # a word ends where its text ends
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, self.text_bounds)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def hashes(self, seed: int) -> np.ndarray:
        """A 64-bit hash of each word's bytes; another seed gives an independent one."""
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each position
        lengths = self.ends - self.starts
        out = mix(lengths.astype(np.uint64) * _ODD[0] + np.uint64(seed))
        todo, done = np.arange(len(lengths)), 0
        while len(todo):
            left = lengths[todo] - done
            block = eight[self.starts[todo] + done] & _MASKS[np.minimum(left, 8)]
            out[todo] = mix((out[todo] ^ block) * _ODD[1] + np.uint64(seed))
            done += 8
            todo = todo[left > 8]
        return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(32))
    x = x * _ODD[2]
    x ^= x >> np.uint64(29)
    x *= _ODD[3]
    x ^= x >> np.uint64(32)
    return x


def odd_numbers(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random odd 64-bit numbers."""
    return np.random.default_rng(seed).integers(0, 2**64, n, np.uint64) | np.uint64(1)


_ODD = odd_numbers(4, 20)
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


class Windows:
    """Hashes of all windows of consecutive words, for any length, from prefix sums of a polynomial in ``base``.

    The window of ``size`` words that starts at word i has the hash at i. Windows that would run past the end of their
    text are not told apart here: callers take ``first_words`` of a size.
    """

    def __init__(self, hashes: np.ndarray, seed: int):
        self.n = len(hashes)
        base = int(odd_numbers(1, seed)[0])
        inverse = pow(base, -1, 2**64)
        powers = np.full(self.n + 1, base, np.uint64)
        powers[0] = 1
        self.back = np.full(self.n + 1, inverse, np.uint64)
        self.back[0] = 1
        np.cumprod(self.back, out=self.back)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(hashes * np.cumprod(powers)[: self.n], out=self.sums[1:])

    def of(self, size: int) -> np.ndarray:
        if self.n < size:
            return np.zeros(0, np.uint64)
        count = self.n - size + 1
        return mix((self.sums[size:] - self.sums[:count]) * self.back[:count])


def window_starts(bounds: np.ndarray, size: int) -> np.ndarray:
    """The words at which a window of ``size`` words lies inside one text."""
    counts = np.maximum(np.diff(bounds) - size + 1, 0)
    return ranges(bounds[:-1], counts)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All numbers of the ranges of ``counts`` numbers from ``starts``, one range after the other."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def covered(n: int, starts: np.ndarray, sizes: np.ndarray | int) -> np.ndarray:
    """Which of ``n`` places lie in any range of ``sizes`` places from ``starts``."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + sizes, -1)
    return np.cumsum(steps[:n]) > 0


def as_lists(values: pa.Array, bounds: np.ndarray) -> pa.Array:
    """``values`` cut at ``bounds`` into one list for each row."""
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
