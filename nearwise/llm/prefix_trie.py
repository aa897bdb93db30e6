"""The trie of all conversations' beginnings: which turns are shared, and what sharing them saves.

A turn's id is a digest of role and text in ``WIDTH`` bytes, big-endian, so a conversation is a key of fixed-width ids. Keys
are cut into segments of ``SEGMENT`` turns. Tasks put the segments they hold into adaptive radix trees, one for each
beginning that segments go on from, and send on the nodes at whole turns; nodes of the same turns are then added up. So no
node's conversations meet in one task, and no conversation is held whole.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from nearwise.llm.radix_tree import RadixTree
from nearwise.llm.ranks import rank_in_groups
from nearwise.session import materialize

#: Bytes of a turn's id.
WIDTH = 16
#: Turns in a segment of a key.
SEGMENT = 64
#: Conversation ids in one piece of the text whose digest a node has.
PIECE = 4096
#: What names a node: its depth, and two hashes of the turns from the root to it.
NODE = ("depth", "high", "low")
EMPTY_SHA256 = sha256(b"").hexdigest()


def turn_id(role: Column, text: Column) -> Column:
    """The first ``WIDTH`` bytes of the SHA-256 digest of role and text; null counts as empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    told = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.substring(F.sha2(told.cast("binary"), 256), 1, 2 * WIDTH))


def number_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, pos`` (from 1), ``turn_id, words`` of every turn: by ``turn``, null first, then by its id.

    Texts are read once and not sent anywhere. Rows without ``conv_id`` belong to no conversation and are left out.
    """
    text = F.coalesce("text", F.lit(""))
    told = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn_order"), turn_id(F.col("role"), F.col("text")).alias("turn_id"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
        F.monotonically_increasing_id().alias("row_no"),
    )
    ranked = rank_in_groups(materialize(told, "turns"), ["conv_id"], ["turn_order", "turn_id", "row_no"], "place")
    return ranked.select("conv_id", (F.col("place") + 1).alias("pos"), "turn_id", "words")


def share_openings(turns: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on the opening turns of another: their ids, and ``conv_id, pos, turn_id, words``.

    Conversation ``c`` begins with the first ``h`` turns of ``c - c % group`` (all if it has fewer, none if it is absent)
    and goes on with its own turns after its first ``h``; ``h`` is the unsigned crc32 of the decimal id, modulo ``most``. An
    opening is at most ``most - 1`` turns long and serves at most ``group`` conversations.
    """
    turns = materialize(turns, "turns-numbered")
    conv = F.col("conv_id")
    opening = turns.where(F.col("pos") < most).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "turn_id", "words"))).alias("opening")
    )
    ids = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("h", F.crc32(conv.cast("string")) % most)
    ids = ids.join(opening.select(F.col("conv_id").alias("base"), "opening"), conv - conv % group == F.col("base"), "left")
    taken = F.coalesce(F.slice("opening", 1, F.col("h").cast("int")), F.array().cast(opening.schema["opening"].dataType))
    ids = materialize(ids.select("conv_id", "h", taken.alias("opening")), "openings")
    shift = ids.select("conv_id", "h", (F.size("opening") - F.col("h")).alias("shift"))
    own = turns.join(shift, "conv_id").where("pos > h").select("conv_id", (F.col("pos") + F.col("shift")).alias("pos"), "turn_id", "words")
    return ids.select("conv_id"), ids.select("conv_id", F.inline("opening")).union(own)


def conversation_trie(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """One row for each node of the trie of the conversations ``ids(conv_id)`` with ``turns(conv_id, pos, turn_id, words)``.

    Columns: ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``. Conversations without turns end at the root. Without
    conversations there is no node.

    Sums over subtrees need no walk up the trie. Call the smallest member of a node its owner. Along a conversation it owns
    the nodes from some depth on, so what a subtree saves is, over all members, the words from its top to where each member
    begins to own; and its leaves are the leaves that members own. The first pass finds the owners, the second adds up.
    Nodes are told apart by 128 bits of hashes; keys that meet in a tree are compared by their bytes.
    """
    segments, totals = _segments(ids, turns)
    found = _nodes(segments.withColumns({"shared": F.lit(0).cast("long"), "leaf": F.lit(0).cast("long")}))
    found = materialize(found, "trie-nodes")
    parent = [F.col(f"parent_{c}").alias(c) for c in NODE[1:]]
    kids = found.where("depth > 0").select((F.col("depth") - 1).alias("depth"), *parent).groupBy(*NODE).agg(F.count("*").alias("n_children"))
    kids = materialize(kids, "trie-children")

    owned = found.join(kids, list(NODE), "left").groupBy("conv_id").agg(
        F.min_by("words_before", "depth").alias("shared"), F.max(F.col("n_children").isNull().cast("long")).alias("leaf")
    )
    owned = materialize(owned, "trie-owners")
    joined = segments.join(totals.select("conv_id", "total_words"), "conv_id").join(owned, "conv_id", "left").withColumns(
        {"shared": F.coalesce("shared", "total_words"), "leaf": F.coalesce("leaf", F.lit(0).cast("long"))}
    )
    saved = F.col("shared") - F.col("owner_shared") - (F.col("n_convs") - 1) * F.col("words_before")
    nodes = _nodes(joined).select(*NODE, "parent_high", "parent_low", "conv_id", "n_convs", F.col("leaf").alias("n_leaves"), saved.alias("saved_tokens"))
    ends = _ends(totals.select(*NODE, "conv_id"))
    none = F.lit(None)
    whole = nodes.select("*", F.lit(0).cast("long").alias("n_children"), none.cast("string").alias("ends_sha256"))
    whole = whole.unionByName(kids, allowMissingColumns=True).unionByName(ends, allowMissingColumns=True)
    sums = ("n_convs", "n_leaves", "saved_tokens", "n_children")
    whole = whole.groupBy(*NODE).agg(
        *(F.max(c).alias(c) for c in ("parent_high", "parent_low", "conv_id")),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums), F.coalesce(F.max("ends_sha256"), F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )
    above = found.select(
        F.col("depth").alias("above"), F.col("high").alias("above_high"), F.col("low").alias("above_low"), F.col("conv_id").alias("parent_conv_id")
    )
    under = (F.col("above") == F.col("depth") - 1) & (F.col("above_high") == F.col("parent_high")) & (F.col("above_low") == F.col("parent_low"))
    return whole.join(above, under, "left").select("conv_id", "depth", "parent_conv_id", *sums, "ends_sha256")


def _segments(ids: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The keys in segments, with the hashes and words before each; and the node at which each conversation ends."""
    place = F.col("pos") - 1
    hashes = {"high": F.xxhash64(F.lit("high"), "pos", "turn_id"), "low": F.xxhash64(F.lit("low"), "turn_id", "pos")}
    cut = turns.withColumns({"segment": F.expr(f"(pos - 1) div {SEGMENT}"), "at": (place % SEGMENT).cast("int"), **hashes})
    cut = cut.groupBy("conv_id", "segment").agg(
        F.array_sort(F.collect_list(F.struct("at", "turn_id", "high", "low", "words"))).alias("turns"),
        F.count("*").alias("n"), F.bit_xor("high").alias("high"), F.bit_xor("low").alias("low"), F.sum("words").alias("words"),
    )
    cut = materialize(cut, "segments")
    slim = cut.drop("turns")
    totals = slim.groupBy("conv_id").agg(
        F.sum("n").alias("depth"), F.bit_xor("high").alias("high"), F.bit_xor("low").alias("low"), F.sum("words").alias("total_words")
    )
    zero = F.lit(0).cast("long")
    totals = ids.join(totals, "conv_id", "left").select("conv_id", *(F.coalesce(c, zero).alias(c) for c in (*NODE, "total_words")))
    totals = materialize(totals, "conversations")
    earlier = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    before = slim.where("segment > 0 OR n > 0").select(
        "conv_id", "segment", F.bit_xor("high").over(earlier).alias("before_high"), F.bit_xor("low").over(earlier).alias("before_low"),
        F.sum("words").over(earlier).alias("words_before"),
    )
    long = before.where("segment > 0")  # most conversations have one segment, which has nothing before it
    cut = cut.select("conv_id", "segment", "turns").join(long, ["conv_id", "segment"], "left")
    cut = cut.withColumns({c: F.coalesce(c, zero) for c in ("before_high", "before_low", "words_before")})
    empty = totals.where("depth = 0").select(
        "conv_id", zero.alias("segment"), F.array().cast(cut.schema["turns"].dataType).alias("turns"),
        *(zero.alias(c) for c in ("before_high", "before_low", "words_before")),
    )
    return materialize(cut.union(empty), "segments-placed"), totals


def _nodes(segments: DataFrame) -> DataFrame:
    """The nodes of all segments, those of equal turns added up.

    ``shared`` and ``leaf`` of a conversation are summed over members; ``owner_shared`` is that of the smallest one.
    """
    columns = ["conv_id", "segment", "before_high", "before_low", "words_before", "shared", "leaf", "turns"]
    schema = (
        "depth long, high long, low long, parent_high long, parent_low long, words_before long, "
        "n_convs long, conv_id long, owner_shared long, shared long, leaf long"
    )
    partial = segments.select(*columns).mapInArrow(_trees, schema)
    return partial.groupBy(*NODE).agg(
        *(F.first(c).alias(c) for c in ("parent_high", "parent_low", "words_before")), F.sum("n_convs").alias("n_convs"),
        F.min_by("owner_shared", "conv_id").alias("owner_shared"), F.min("conv_id").alias("conv_id"),
        F.sum("shared").alias("shared"), F.sum("leaf").alias("leaf"),
    )


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's nodes, from one radix tree for each beginning that its segments go on from.

    A total is ``[row, members, smallest conversation, its shared words, shared words, leaves]``; ``row`` is any segment
    that passes through, whose turns up to there are the node's.
    """

    def add(total, other):
        total[1] += other[1]
        if other[2] < total[2]:
            total[2], total[3] = other[2], other[3]
        total[4] += other[4]
        total[5] += other[5]

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        conv, segment, high, low, words, shared, leaf = (batch.column(i).to_numpy() for i in range(7))
        lists = batch.column(7)
        bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
        flat = lists.flatten()
        keys = b"".join(flat.field("turn_id").to_pylist())
        # The hashes and words up to each place of each segment, its beginning included.
        rows = np.repeat(np.arange(n), np.diff(bounds) + 1)
        starts = bounds[:-1] + np.arange(n)
        inner = np.ones(len(rows), bool)
        inner[starts] = False
        sums = []
        for name, first, step in (("high", high, np.bitwise_xor), ("low", low, np.bitwise_xor), ("words", words, np.add)):
            values = np.empty(len(rows), np.int64)
            values[inner] = flat.field(name).to_numpy()
            values[starts] = 0
            run = step.accumulate(values)
            base = run[starts]  # what all rows before add up to, which is taken away again
            sums.append((run ^ base[rows] ^ first[rows]) if step is np.bitwise_xor else run - base[rows] + first[rows])
        trees: dict[tuple, RadixTree] = {}
        for row in range(n):
            key = keys[WIDTH * bounds[row] : WIDTH * bounds[row + 1]]
            tree = trees.setdefault((segment[row], high[row], low[row]), RadixTree(add, list))
            tree.insert(key, [row, 1, int(conv[row]), int(shared[row]), int(shared[row]), int(leaf[row])])
        depths, totals = [], []
        for (number, _, _), tree in trees.items():
            for depth, total in tree.aligned(WIDTH):
                if depth or not number:  # the root of a later segment is the last node of the one before
                    depths.append(depth)
                    totals.append(total)
        depth, total = np.array(depths, np.int64), np.array(totals, np.int64).reshape(-1, 6)
        here = starts[total[:, 0]] + depth
        over = np.maximum(here - 1, starts[total[:, 0]])
        columns = [SEGMENT * segment[total[:, 0]] + depth, sums[0][here], sums[1][here]]
        columns += [sums[0][over], sums[1][over], sums[2][over], *total[:, 1:].T]
        names = ["depth", "high", "low", "parent_high", "parent_low", "words_before", "n_convs", "conv_id", "owner_shared", "shared", "leaf"]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), pa.int64()) for c in columns], names)


def _ends(ends: DataFrame) -> DataFrame:
    """For each node at which conversations end the digest of their ids, ascending, comma-joined.

    Ids are put into order by ranges, joined in pieces of ``PIECE`` where they lie, and only the pieces of a node meet. A
    digest of one text can't be divided, so one task reads the pieces of a node; it holds one at a time.
    """
    ranked = rank_in_groups(ends, list(NODE), ["conv_id"], "place").withColumn("piece", F.expr(f"place div {PIECE}"))
    ids = F.array_sort(F.collect_list("conv_id"))
    pieces = ranked.groupBy(*NODE, "piece").agg(F.array_join(F.transform(ids, lambda i: i.cast("string")), ",").alias("text"))
    dealt = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "piece").select(*NODE, "text")
    return dealt.mapInArrow(_digest_pieces, "depth long, high long, low long, ends_sha256 string")


def _digest_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, digest = None, None

    def closed(found):
        return pa.RecordBatch.from_pydict(dict(zip((*NODE, "ends_sha256"), map(list, zip(*found)))), _ENDS)

    for batch in batches:
        found = []
        for *node, text in zip(*(column.to_pylist() for column in batch.columns)):
            if node == last:
                digest.update(b"," + text.encode())
                continue
            if last is not None:
                found.append((*last, digest.hexdigest()))
            last, digest = node, sha256(text.encode())
        if found:
            yield closed(found)
    if last is not None:
        yield closed([(*last, digest.hexdigest())])


_ENDS = pa.schema([("depth", pa.int64()), ("high", pa.int64()), ("low", pa.int64()), ("ends_sha256", pa.string())])

cloudpickle.register_pickle_by_value(sys.modules[__name__])
