"""A blocked Bloom filter as a table: one row for each block, joined with the keys that are asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Bits of a filter's block, in words of 64; each key sets two bits in each word of one block.
WORDS = 4
BLOCK_BITS = 64 * WORDS
BITS_PER_KEY = 16
#: The largest filter that is broadcast; a row of it takes about ``ROW_BYTES``. A larger one is joined by shuffle.
BROADCAST_BYTES = 64 << 20
ROW_BYTES = 64


def n_blocks_for(n_keys: int) -> int:
    """The blocks of a filter of ``BITS_PER_KEY`` bits a key."""
    return max(1, -(-n_keys * BITS_PER_KEY // BLOCK_BITS))


def place(key: Column, n_blocks: int) -> dict[str, Column]:
    """The block of a key, and the two bits that it sets in each word of the block."""
    bits = F.xxhash64(key, F.lit("bits"))
    one = F.lit(1).cast("long")

    def chosen(slot: int) -> Column:
        return F.call_function("shiftleft", one, F.shiftright(bits, 6 * slot).bitwiseAND(F.lit(63)).cast("int"))

    words = {f"m{i}": chosen(2 * i).bitwiseOR(chosen(2 * i + 1)) for i in range(WORDS)}
    return {"block": F.pmod(F.xxhash64(key), F.lit(n_blocks)), **words}


def bloom_filter(keys: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """For each block that has keys its words ``w0, w1, ...``: the bits of all its keys together."""
    placed = keys.select(*(column.alias(name) for name, column in place(F.col(key), n_blocks).items()))
    return placed.groupBy("block").agg(*(F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS)))


def with_possible(
    rows: DataFrame, key: Column, keys: DataFrame, n_keys: int, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``row`` (all columns of ``rows``), ``probe`` (its key) and ``possible``: false only if ``keys`` lacks the key.

    ``keys`` is a table of one column with ``n_keys`` rows. About one key in 500 passes without being there. The filter
    grows with the keys; up to ``broadcast_bytes`` it is broadcast and rows stay where they lie. A null key is not possible.
    """
    n_blocks = n_blocks_for(n_keys)
    bloom = bloom_filter(keys.toDF("key"), "key", n_blocks)
    if n_blocks * ROW_BYTES <= broadcast_bytes:
        bloom = F.broadcast(bloom)
    probed = rows.select(F.struct(*(quoted(name) for name in rows.columns)).alias("row"), key.alias("probe"))
    probed = probed.withColumns(place(F.col("probe"), n_blocks)).join(bloom, "block", "left")
    passed = F.col("probe").isNotNull()
    for i in range(WORDS):
        passed &= F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) == F.col(f"m{i}")
    return probed.select("row", "probe", F.coalesce(passed, F.lit(False)).alias("possible"))


def quoted(name: str) -> Column:
    """A column by its very name, whatever characters it has."""
    return F.col(f"`{name.replace('`', '``')}`").alias(name)
