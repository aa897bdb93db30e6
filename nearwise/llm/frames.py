"""Patched frame-of-reference coding of token ids: the bytes of one segment of a token file.

A segment is a header, the index of block starts, and blocks of ``BLOCK`` ids (the last one may hold fewer). A block keeps
its smallest id, and every id as its difference from that in ``width`` bits. The width is the smallest one that holds
nine in ten of the differences; the higher bits of the others stand in the block's list of exceptions.

    segment  b"PFR1" | ids u64 | blocks u64 | start of each block, and the end of the last, u64
    block    minimum u32 | ids u16 | exceptions u16 | width u8 | packed low bits | places u16 | high bits u32
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

MAGIC = b"PFR1"
BLOCK = 1024
#: The share of differences that the packed width must hold.
PERCENTILE = 0.9
HEAD = np.dtype([("low", "<u4"), ("n", "<u2"), ("exceptions", "<u2"), ("width", "u1")])


def pack(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    """One segment that holds ``ids``, unsigned 32-bit numbers in any order; none give a segment without blocks."""
    ids = np.ascontiguousarray(ids, np.uint32)
    n_blocks = -(-len(ids) // block)
    parts: list[bytes] = [b""] * n_blocks
    whole = len(ids) // block
    if whole:
        _pack_blocks(ids[: whole * block].reshape(whole, block), percentile, parts, 0)
    if n_blocks > whole:
        _pack_blocks(ids[whole * block :].reshape(1, -1), percentile, parts, whole)
    starts = np.zeros(n_blocks + 1, "<u8")
    np.cumsum([len(p) for p in parts], out=starts[1:]) if parts else None
    starts += len(MAGIC) + 16 + 8 * (n_blocks + 1)
    return b"".join([MAGIC, np.array([len(ids), n_blocks], "<u8").tobytes(), starts.tobytes(), *parts])


def _pack_blocks(rows: np.ndarray, percentile: float, parts: list[bytes], first: int) -> None:
    low = rows.min(1)
    rest = rows - low[:, None]
    n = rows.shape[1]
    held = np.sort(rest, 1)[:, max(0, int(np.ceil(percentile * n)) - 1)]
    widths = bit_length(held)
    for width in np.unique(widths).tolist():
        chosen = np.flatnonzero(widths == width)
        some = rest[chosen]
        bits = ((some[:, :, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)).astype(np.uint8)
        packed = np.packbits(bits.reshape(len(chosen), -1), axis=1, bitorder="little")
        high = some >> np.uint32(width) if width < 32 else np.zeros_like(some)
        for row, place in enumerate(chosen.tolist()):
            at = np.flatnonzero(high[row])
            head = np.array([(low[place], n, len(at), width)], HEAD)
            parts[first + place] = b"".join(
                [head.tobytes(), packed[row].tobytes(), at.astype("<u2").tobytes(), high[row][at].astype("<u4").tobytes()]
            )


def bit_length(x: np.ndarray) -> np.ndarray:
    """The number of bits each number needs; 0 needs none."""
    return np.frexp(x.astype(np.float64))[1] * (x > 0)


def n_ids(segment: bytes) -> int:
    """How many ids a segment holds."""
    if segment[:4] != MAGIC:
        raise ValueError("not a segment of a token file")
    return int(np.frombuffer(segment, "<u8", 1, 4)[0])


def unpack(segment: bytes, start: int = 0, end: int | None = None, block: int = BLOCK) -> np.ndarray:
    """The ids ``start:end`` of a segment. Only the blocks that hold them are decoded, found by the index of starts."""
    total = n_ids(segment)
    end = total if end is None else min(end, total)
    if start >= end:
        return np.zeros(0, np.uint32)
    n_blocks = int(np.frombuffer(segment, "<u8", 1, 12)[0])
    starts = np.frombuffer(segment, "<u8", n_blocks + 1, 20).astype(np.int64)
    first, last = start // block, (end - 1) // block
    heads = np.frombuffer(b"".join(segment[s : s + HEAD.itemsize] for s in starts[first : last + 1].tolist()), HEAD)
    out = np.zeros((last - first + 1) * block, np.uint32)
    for width, n in {(int(h["width"]), int(h["n"])) for h in heads}:
        chosen = np.flatnonzero((heads["width"] == width) & (heads["n"] == n))
        size = (width * n + 7) // 8
        at = (starts[first + chosen] + HEAD.itemsize).tolist()
        packed = np.frombuffer(b"".join(segment[a : a + size] for a in at), np.uint8).reshape(len(chosen), size)
        bits = np.unpackbits(packed, axis=1, bitorder="little", count=width * n).reshape(len(chosen), n, width)
        values = np.zeros((len(chosen), n), np.uint32)
        for bit in range(width):
            values |= bits[:, :, bit].astype(np.uint32) << np.uint32(bit)
        for row, (place, begin) in enumerate(zip(chosen.tolist(), at)):
            if k := int(heads["exceptions"][place]):
                values[row, np.frombuffer(segment, "<u2", k, begin + size)] |= (
                    np.frombuffer(segment, "<u4", k, begin + size + 2 * k) << np.uint32(width)
                )
            out[place * block : place * block + n] = values[row] + heads["low"][place]
    return out[start - first * block : end - first * block]


cloudpickle.register_pickle_by_value(sys.modules[__name__])
