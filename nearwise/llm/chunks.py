"""Tokenising by distinct chunks: each chunk of text is given to the tokenizer once per task and then looked up."""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence

import numpy as np
from pyspark import cloudpickle

from nearwise.llm import words as w

#: Distinct chunks a task remembers before it starts afresh; a chunk is met again sooner than that or is rare.
MEMO_CHUNKS = 800_000


class ChunkMemo:
    """Token ids of chunks (``bytes`` or ``str``).

    ``encode(chunks)`` gives the ids of a list of chunks in a row and the number of ids of each. The chunks ``silent``
    have no ids and are never encoded.
    """

    def __init__(self, encode: Callable[[list], tuple[np.ndarray, np.ndarray]], silent: Sequence = (), limit: int = MEMO_CHUNKS):
        self.encode, self.silent, self.limit = encode, silent, limit
        self.clear()

    def clear(self) -> None:
        self.places = {chunk: i for i, chunk in enumerate(self.silent)}
        self.ids = np.zeros(1 << 16, np.int32)
        self.bounds = np.zeros(1 << 16, np.int64)

    def look_up(self, chunks: list) -> np.ndarray:
        """The place of each chunk in the memo, after unknown ones have been encoded."""
        if len(self.places) > self.limit:
            self.clear()
        if new := list(set(chunks).difference(self.places)):
            known = len(self.places)
            ids, counts = self.encode(new)
            end = int(self.bounds[known])
            self.ids = _grown(self.ids, end + len(ids))
            self.bounds = _grown(self.bounds, known + len(new) + 1)
            self.ids[end : end + len(ids)] = ids
            self.bounds[known + 1 : known + len(new) + 1] = end + np.cumsum(counts)
            self.places.update(zip(new, range(known, known + len(new))))
        return np.fromiter(map(self.places.__getitem__, chunks), np.int64, len(chunks))

    def tokens(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks in a row, and the number of ids of each chunk."""
        counts = self.bounds[places + 1] - self.bounds[places]
        return self.ids[w.ranges(self.bounds[places], counts)], counts


def _grown(array: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array):
        return array
    out = np.zeros(max(size, 2 * len(array)), array.dtype)
    out[: len(array)] = array
    return out


cloudpickle.register_pickle_by_value(sys.modules[__name__])
