"""Benchmark decontamination: a broadcast set of hashed test windows, scanned against all windows of all texts."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from nearwise.llm import words as w
from nearwise.session import materialize

WINDOW = 10
#: Bytes of benchmark text in one broadcast set. A larger benchmark is scanned in several blocks of this size.
BLOCK_BYTES = 16 << 20

FOUND = [
    StructField("n_words", LongType(), False),
    StructField("hit_spans", ArrayType(ArrayType(LongType(), False), False), False),
    StructField("hit_items", ArrayType(StringType(), False), False),
]


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, keep: Sequence[str], window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """For each row of ``docs``: the columns ``keep``, ``n_words``, ``hit_spans`` and ``hit_items``.

    Words are maximal runs of letters, digits and characters beyond ASCII after lower-casing A-Z. A test window is
    ``window`` consecutive words of a benchmark text; a shorter text that has words is one window. ``hit_spans`` are
    the disjoint, ascending ``[first, end)`` ranges of words that lie in an occurrence of any window, ``hit_items`` the
    distinct ids of the items whose windows occur, sorted as strings.

    Every row is answered for itself, so repeated rows and ids are no problem. A null or empty text has no words. A
    benchmark row without words adds nothing; one with a null id hits words, but is no item. An empty benchmark hits
    nothing. Other columns than ``text`` and ``keep`` are not read, whatever their names.

    The benchmark is measured first and split into blocks by hash, so that what is broadcast is bounded; each block is
    one scan of the texts, and there is no shuffle. Nothing is lost however large the benchmark is.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    schema = StructType([docs.schema[name] for name in keep])
    inner = StructType([*(StructField(f"k{i}", f.dataType) for i, f in enumerate(schema)), StructField("text", StringType())])
    rows = docs.select(*(F.col(name).alias(f"k{i}") for i, name in enumerate(keep)), "text")
    for block in range(n_blocks):
        part = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == block)
        found = part.toArrow()
        shared = docs.sparkSession.sparkContext.broadcast(test_windows(found["item"].to_pylist(), found["text"].combine_chunks(), window))
        last = block == n_blocks - 1
        out = StructType([f for f in inner if f.name != "text" or not last] + FOUND)
        rows = rows.mapInArrow(_scanner(shared, last, block > 0), out)
        if not last:
            rows = materialize(rows, "decontaminate")
    return rows.select(*(F.col(f"k{i}").alias(name) for i, name in enumerate(keep)), *(f.name for f in FOUND))


def decontaminate(docs: DataFrame, benchmark: DataFrame, action: str = "drop", window: int = WINDOW) -> DataFrame:
    """``docs`` without what a benchmark contaminates: whole documents (``drop``) or only the hit words (``cut``).

    A cut removes the bytes from the first to the last word of each hit span. Rows and columns are otherwise unchanged.
    """
    if action not in ("drop", "cut"):
        raise ValueError(f"unknown action: {action}")
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names)))).withColumn("text", F.col(f"c{names.index('text')}"))
    found = find_contamination(plain, benchmark, [f"c{i}" for i in range(len(names))], window)
    if action == "drop":
        return found.where(F.size("hit_spans") == 0).select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)))
    cut = f"c{names.index('text')}"
    schema = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)])
    kept = found.drop("n_words", "hit_items").mapInArrow(_cutter(cut), schema)
    return kept.toDF(*names)


def test_windows(ids: list, texts: pa.Array, window: int) -> dict:
    """The windows of one block of items: by length, the sorted hashes and the items of each window's words."""
    found, by_size = w.Words(texts, w.ALPHANUMERIC, lower=True), {}
    flat = found.data.tobytes()
    spelled = [flat[a:b] for a, b in zip(found.starts.tolist(), found.ends.tolist())]
    for item, first, end in zip(ids, found.bounds[:-1].tolist(), found.bounds[1:].tolist()):
        size = min(window, end - first)
        for at in range(first, end - size + 1) if size else ():
            by_size.setdefault(size, {}).setdefault(b" ".join(spelled[at : at + size]), set()).add(item)
    out = {}
    for size, owners in by_size.items():
        known = w.Words(pa.array(list(owners), pa.large_binary()), w.SPACED)
        hashes = w.Windows(known.hashes(1), 2).of(size)[known.bounds[:-1]]
        screen = np.zeros(1 << 20, bool)
        screen[(hashes >> np.uint64(44)).astype(np.int64)] = True
        out[size] = (np.sort(hashes), screen, {k: sorted(x for x in v if x is not None) for k, v in owners.items()})
    return out


def hits(found: w.Words, tests: dict) -> list[tuple[int, int, list]]:
    """The verified occurrences: first word, number of words, items. Hash equality is confirmed on the words."""
    if not tests or not len(found.starts):
        return []
    windows, out = w.Windows(found.hashes(1), 2), []
    for size, (known, screen, owners) in tests.items():
        at = w.window_starts(found.bounds, size)
        hashes = windows.of(size)[at] if len(at) else np.zeros(0, np.uint64)
        likely = screen[(hashes >> np.uint64(44)).astype(np.int64)]
        at, hashes = at[likely], hashes[likely]
        place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        for first in at[known[place] == hashes].tolist():
            spans = zip(found.starts[first : first + size].tolist(), found.ends[first : first + size].tolist())
            items = owners.get(b" ".join(found.data[a:b].tobytes() for a, b in spans))
            if items is not None:
                out.append((first, size, items))
    return out


def _scanner(shared, last: bool, again: bool):
    def scan(batches):
        for batch in w.slices(batches):
            found = w.Words(batch.column("text"), w.ALPHANUMERIC, lower=True)
            occurrences = hits(found, shared.value)
            n, rows = len(found.starts), batch.num_rows
            hit = w.covered(n, np.array([a for a, _, _ in occurrences], int), np.array([s for _, s, _ in occurrences], int))
            items = [set() for _ in range(rows)]
            owner = np.searchsorted(found.bounds, [a for a, _, _ in occurrences], "right") - 1
            for row, (_, _, ids) in zip(owner.tolist(), occurrences):
                items[row].update(ids)
            if again:
                for row, (spans, ids) in enumerate(zip(batch.column("hit_spans").to_pylist(), batch.column("hit_items").to_pylist())):
                    items[row].update(ids)
                    for first, end in spans:
                        hit[found.bounds[row] + first : found.bounds[row] + end] = True
            edges = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
            inner = found.bounds[1:-1]
            inner = inner[(inner > 0) & (inner < n)]
            opens, closes = edges[:-1] == 1, edges[1:] == -1
            opens[inner] |= hit[inner]
            closes[inner - 1] |= hit[inner - 1]
            first, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
            row_of = np.searchsorted(found.bounds, first, "right") - 1
            offset = found.bounds[row_of]
            pairs = w.as_lists(pa.array(np.stack([first - offset, end - offset], 1).ravel(), pa.int64()), 2 * np.arange(len(first) + 1))
            spans = w.as_lists(pairs, np.searchsorted(row_of, np.arange(rows + 1)))
            columns = [c for c, f in zip(batch.columns, batch.schema) if f.name[0] == "k" or f.name == "text" and not last]
            names = [f.name for f in batch.schema if f.name[0] == "k" or f.name == "text" and not last]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(found.counts, pa.int64()), spans, pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                [*names, "n_words", "hit_spans", "hit_items"],
            )

    return scan


def _cutter(column: str):
    def cut(batches):
        for batch in w.slices(batches, column):
            found, texts = w.Words(batch.column(column), w.ALPHANUMERIC, lower=True), []
            for row, (text, spans) in enumerate(zip(batch.column(column).to_pylist(), batch.column("hit_spans").to_pylist())):
                if spans:
                    raw, base, first_word = text.encode(), int(found.text_bounds[row]), int(found.bounds[row])
                    kept, at = [], 0
                    for first, end in spans:
                        kept.append(raw[at : int(found.starts[first_word + first]) - base])
                        at = int(found.ends[first_word + end - 1]) - base
                    text = b"".join([*kept, raw[at:]]).decode()
                texts.append(text)
            names = [n for n in batch.schema.names if n != "hit_spans"]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == column else batch.column(n) for n in names], names)

    return cut


cloudpickle.register_pickle_by_value(sys.modules[__name__])
