"""Hashed word features of whole Arrow batches: lower-cased words of letters, and their first letters."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from nearwise.llm import words as w

#: Bytes of the words of lower-cased text that consist of letters; every byte beyond ASCII counts as one.
LETTERS = np.array([97 <= i <= 122 or i >= 128 for i in range(256)])
#: Lengths in bytes of the beginnings of words that are features of their own.
PREFIXES = (4, 5, 6)


def one_text_each(rows: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and one ``text`` of each: of a key's rows the text of lowest hash. Tasks send on one row of a key at most."""
    return rows.groupBy(*keys).agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


class Grams:
    """32-bit hashes of each word and of its beginnings, one row for each kind, one column for each word."""

    def __init__(self, texts: pa.Array):
        self.words = found = w.Words(pc.utf8_lower(texts), LETTERS)
        hashes = [found.hashes(40)]
        lengths = found.ends - found.starts
        padded = np.concatenate([found.data, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(found.data) + 1, "<u8", padded, strides=(1,))[found.starts]
        for n in PREFIXES:
            start = w.mix((eight & np.uint64((1 << 8 * n) - 1)) + np.uint64(n << 56))
            hashes.append(np.where(lengths > n, start, hashes[0]))  # a short word is its own beginning
        self.codes = (np.stack(hashes) >> np.uint64(32)).astype(np.uint32)

    def distinct(self) -> list[np.ndarray]:
        """The distinct hashes of each text."""
        return [np.unique(self.codes[:, a:b]) for a, b in zip(self.words.bounds[:-1], self.words.bounds[1:])]


cloudpickle.register_pickle_by_value(sys.modules[__name__])
