"""Near-duplicates: MinHash banding proposes pairs, signatures screen them, whole sets confirm them, stars join them."""

from __future__ import annotations

import math
import sys
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from nearwise.llm import words as w
from nearwise.llm.components import components
from nearwise.session import materialize

#: Words in a shingle, and the least similarity of a link in percent.
SHINGLE = 5
PERCENT = 80
#: Two sets of similarity 0.8 share no band with a probability of (1 - 0.8**5)**40, about 1.3e-7.
BANDS, ROWS = 40, 5
HASHES = BANDS * ROWS
#: Of two sets of similarity 0.8 a tenth of the 200 signature bits differ; more than 52 with a probability below 1e-8.
MOST_BITS = 52
SIGNATURE = ["s0", "s1", "s2", "s3"]
#: Sizes of sets are compared by classes, each so many times as large as the one below.
CLASS = 1.06
#: Pairs of one node whose sets meet in one group of rows; the node's own set is sent once to each group.
GROUP = 1000
#: Ids that may be broadcast to fetch their texts (8 bytes each); more are joined by shuffle.
BROADCAST_IDS = 1_000_000

_SEEDS = w.odd_numbers(2 * HASHES, 7)
_BAND = w.odd_numbers(HASHES, 8)
_SET = w.odd_numbers(3, 9)
_CHUNK = 512


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The distinct shingles of each text, as sorted 64-bit hashes.

    A text with fewer words than ``size`` has one shingle, all its words; one without words has none.
    """
    found = w.Words(texts, w.SPACED, lower=True)
    windows = w.Windows(found.hashes(3), 4)
    full, out = windows.of(size), []
    for first, end in zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist()):
        n = end - first
        out.append(np.unique(full[first : end - size + 1]) if n >= size else windows.of(n)[first : first + 1] if n else full[:0])
    return out


def sketch(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id``, the number of shingles, a 128-bit hash of the set, one hash for each band, 200 signature bits."""
    kinds = "n_shingles long, set1 long, set2 long, bands array<long>, " + ", ".join(f"{s} long" for s in SIGNATURE)
    return docs.select("doc_id", "text").mapInArrow(_sketcher(size), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {kinds}")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    Two rows are linked when the Jaccard similarity of their sets of ``size``-word shingles is at least ``percent``
    (A-Z lower-cased; words end at ASCII white space). ``component_id`` is the smallest ``doc_id`` of a row that can be
    reached over links, and ``kept`` says whether that is the row's own. A row without words, or with a null id, is linked
    with nothing; with a null id it has a null component and is kept. Rows that repeat an id are vertices of their own.
    Other columns are not read. An empty table gives an empty one. A ``percent`` below ``PERCENT`` is an error.

    Rows of equal sets are one node from the start, so a group of copies costs one row of each. Nodes that share a band
    are first compared with one node of that bucket, the one that most others share their buckets with; never all with all.
    What is left is only compared further where a bucket still holds nodes of different components: nodes of such buckets
    meet where they share one of their rarest shingles, as any two that are similar enough do. So every pair that shares a
    bucket is compared, ruled out exactly, or already known to be connected, whatever the size of the bucket.
    """
    if percent < PERCENT:
        raise ValueError(f"bands and signatures are made for {PERCENT} percent or more: at {percent} links would be lost")
    rows = materialize(sketch(docs, size), "sketch")
    sets = rows.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    nodes = sets.groupBy("set1", "set2").agg(
        F.min("doc_id").alias("first_id"), *(F.first(c).alias(c) for c in ("n_shingles", "bands", *SIGNATURE))
    )
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    links = _links(docs, nodes, size, percent)
    named = nodes.select("node", "set1", "set2", "first_id")
    named = _with_label(named, links, "node", "label").select("set1", "set2", "first_id", "label")
    least = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = named.join(least, "label").select("set1", "set2", "component_id")
    keyed = rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("set1")).alias("set1"), "set2")
    out = keyed.join(named, ["set1", "set2"], "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def deduplicate(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: the one of smallest id.

    Rows of a null id stay. If a kept id has several rows, each of its different texts stays once.
    """
    kept = near_duplicates(docs, size, percent).where("kept").select(F.col("doc_id").alias("kept_id")).where(F.col("kept_id").isNotNull()).distinct()
    known = docs.where(F.col("doc_id").isNotNull())
    kept = known.select(F.struct("*").alias("row")).join(kept, F.col("row.doc_id") == F.col("kept_id"), "left_semi")
    place = F.row_number().over(Window.partitionBy("row.doc_id", F.xxhash64("row.text")).orderBy("row.text"))
    kept = kept.withColumn("place", place).where(F.col("place") == 1).select("row.*")
    return kept.union(docs.where(F.col("doc_id").isNull()))


def _links(docs: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame | None:
    """Links ``(u, v)`` that join everything that is linked; None if there are none."""
    buckets = nodes.select("node", F.posexplode("bands").alias("band", "hash")).select("node", F.xxhash64("band", "hash").alias("key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("members")).where(F.col("members") > 1)
    buckets = materialize(buckets.join(shared, "key"), "buckets")
    weights = materialize(buckets.groupBy("node").agg(F.sum("members").alias("weight")), "weights")
    sets = _sets(docs, nodes.join(weights, "node"), weights.count(), size)
    hub = F.max_by("node", F.struct("weight", -F.col("node"))).alias("hub")
    weighed = buckets.select("key", "node").join(weights, "node")
    hubs = weighed.groupBy("key").agg(hub, F.max("weight").alias("hub_weight"))
    pairs = buckets.select("key", "node").join(hubs, "key").where(F.col("node") != F.col("hub"))
    pairs = pairs.groupBy(F.col("node").alias("u"), F.col("hub").alias("v")).agg(F.max("hub_weight").alias("weight"))
    pairs = materialize(_screened(pairs, nodes, percent), "pairs")
    stars, tested = None, []

    def compare(chosen: DataFrame) -> None:
        """Add what is linked of the chosen pairs to the stars, which join all that is known to be linked."""
        nonlocal stars
        chosen = materialize(chosen, "chosen")
        if chosen.head(1):
            tested.append(chosen)
            confirmed = materialize(_confirmed(chosen, sets, percent), "links")
            if confirmed.head(1):
                found = components(confirmed if stars is None else stars.union(confirmed))
                stars = materialize(found.where("node != label").select(F.col("node").alias("u"), F.col("label").alias("v")), "links")

    compare(pairs.groupBy("u").agg(F.max_by("v", F.struct("weight", "v")).alias("v")))  # each node with its best hub
    rest = pairs.select("u", "v").join(tested[0], ["u", "v"], "left_anti") if tested else pairs.select("u", "v")
    rest = _with_label(_with_label(rest, stars, "u", "lu"), stars, "v", "lv")
    compare(rest.where("lu != lv").select("u", "v"))
    active = _unsettled(_with_label(buckets.select("key", "node"), stars, "node", "label"))
    active = materialize(active.select("node", "label").distinct().join(nodes.select("node", "n_shingles"), "node"), "active")
    if active.head(1):
        facing = materialize(_screened(_by_rarest(sets, active, percent), nodes, percent), "pairs")
        compare(facing.join(_both_ways(tested), ["u", "v"], "left_anti") if tested else facing)
    return stars


def _both_ways(pairs: list[DataFrame]) -> DataFrame:
    """All pairs, the larger node first."""
    return reduce(DataFrame.union, pairs).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _unsettled(labelled: DataFrame) -> DataFrame:
    """The members of buckets that hold several components."""
    several = labelled.groupBy("key").agg(F.min("label").alias("first"), F.max("label").alias("last")).where("first != last")
    return labelled.join(several.select("key"), "key")


def _by_rarest(sets: DataFrame, active: DataFrame, percent: int) -> DataFrame:
    """All pairs ``(u, v)``, ``u > v``, of active nodes of different components that could be similar enough.

    Put the shingles of each set into one order, those that fewest active nodes have first. Two sets that share as much as
    the limit asks share one of their first shingles already; how many those are follows from both sizes. So nodes are
    joined on their first shingles, by classes of size. A shingle that a large group of copies shares is among the first
    only of members with next to no changes, which the hubs have joined before, and pairs of one component are left out.
    """
    members = sets.join(active, "node")
    shingles = members.select("node", F.explode("members").alias("shingle"))
    common = shingles.groupBy("shingle").agg(F.count("*").alias("nodes")).where(F.col("nodes") > 1)
    ranked = shingles.join(common, "shingle").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("nodes", "shingle"))).alias("ranked"))
    ranked = ranked.join(active, "node")  # shingles of one node alone come before all others and match nothing

    size, level = F.col("n_shingles"), F.floor(F.log("n_shingles") / math.log(CLASS)).cast("int")
    own = size - F.size("ranked")  # how many those are

    def first(smaller: Column, larger: Column, other: Column, side: int) -> Column:
        """The first shingles as the smaller or larger of a pair of classes, with their places in the whole order."""
        least = F.floor(F.pow(F.lit(CLASS), other)) - 1  # the least size in the other class, rounding included
        shared = F.ceil(percent * (size + least) / (100 + percent))
        reach = F.greatest(F.lit(0), F.least(size - shared + 1, size) - own).cast("int")
        return F.transform(
            F.slice("ranked", F.lit(1), reach),
            lambda x, i: F.struct(
                smaller.alias("smaller"), larger.alias("larger"), x["shingle"].alias("shingle"), F.lit(side).alias("side"), (own + i).cast("int").alias("place")
            ),
        )

    steps = range(math.ceil(math.log(100 / percent) / math.log(CLASS)) + 1)
    firsts = [first(level, level + d, level + d, 0) for d in steps] + [first(level - d, level, level - d, 1) for d in steps]
    entries = ranked.select("node", "label", "n_shingles", F.inline(F.flatten(F.array(*firsts))))
    entries = materialize(entries, "first-shingles")
    side = lambda number, name: entries.where(F.col("side") == number).drop("side").withColumnsRenamed(
        {c: f"{name}_{c}" for c in ("node", "label", "n_shingles", "place")}
    )
    both = side(0, "a").join(side(1, "b"), ["smaller", "larger", "shingle"])
    once = (F.col("smaller") < F.col("larger")) | (F.col("a_node") < F.col("b_node"))
    total = F.col("a_n_shingles") + F.col("b_n_shingles")
    # what follows their first common shingle must be enough
    rest = F.least(F.col("a_n_shingles") - F.col("a_place"), F.col("b_n_shingles") - F.col("b_place"))
    both = both.where((F.col("a_label") != F.col("b_label")) & once & ((100 + percent) * rest >= percent * total))
    return both.select(F.greatest("a_node", "b_node").alias("u"), F.least("a_node", "b_node").alias("v")).distinct()


def _with_label(df: DataFrame, stars: DataFrame | None, node: str, name: str) -> DataFrame:
    """``df`` with the centre of each node's star, which is the node itself without a link."""
    if stars is None:
        return df.withColumn(name, F.col(node))
    named = stars.select(F.col("u").alias(node), F.col("v").alias(name))
    return df.join(named, node, "left").withColumn(name, F.coalesce(name, node))


def _screened(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and signatures allow the similarity."""
    light = nodes.select("node", "n_shingles", *SIGNATURE)
    side = lambda name: light.toDF(name, *(f"{name}_{c}" for c in light.columns[1:]))
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    return both.where(_may_be_similar(percent)).select(*pairs.columns)


def _may_be_similar(percent: int) -> Column:
    """Whether sizes and signatures of the two sides ``u_`` and ``v_`` allow the similarity."""
    differing = reduce(add, (F.bit_count(F.col(f"u_{s}").bitwiseXOR(F.col(f"v_{s}"))) for s in SIGNATURE))
    small, large = F.least("u_n_shingles", "v_n_shingles"), F.greatest("u_n_shingles", "v_n_shingles")
    return (100 * small >= percent * large) & (differing <= MOST_BITS)


def _sets(docs: DataFrame, nodes: DataFrame, n_nodes: int, size: int) -> DataFrame:
    """``node`` and its whole set, ``members``, from the text of a row that has it; made once for all rounds."""
    wanted = nodes.select("node", F.col("first_id").alias("id"), "set1", "set2")
    few = n_nodes <= BROADCAST_IDS
    texts = docs.select("doc_id", "text").join(F.broadcast(wanted) if few else wanted, F.col("doc_id") == F.col("id"))
    found = texts.select("node", "set1", "set2", "text").mapInArrow(_matching(size), "node long, members array<long>")
    return materialize(found.dropDuplicates(["node"]), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets are similar enough.

    The pairs of a node ``v`` are dealt to groups of about ``GROUP``. A group gets the set of ``v`` once, and after it the
    sets it is compared with, one by one; so no set is sent with every pair, and a task holds a batch and one set.
    """
    groups = pairs.groupBy("v").agg(F.ceil(F.count("*") / GROUP).alias("groups"))
    dealt = pairs.join(groups, "v").select("u", "v", F.pmod(F.xxhash64("u"), F.col("groups")).alias("part"))
    dealt = materialize(dealt, "dealt")
    heads = dealt.select("v", "part").distinct().join(sets.withColumnRenamed("node", "v"), "v")
    heads = heads.select("v", "part", F.lit(None).cast("long").alias("u"), "members")
    rows = dealt.join(sets.withColumnRenamed("node", "u"), "u").select("v", "part", "u", "members")
    rows = heads.union(rows).repartition("v", "part").sortWithinPartitions("v", "part", "u")  # a null u comes first
    return rows.mapInArrow(_confirmer(percent), "u long, v long")


def _set_hash(members: np.ndarray) -> tuple[int, int]:
    return int(w.mix(members * _SET[0]).sum()), int(w.mix((members ^ _SET[2]) * _SET[1]).sum())


def _signed(values) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64))


def _sketcher(size: int):
    a, b = _SEEDS[:HASHES, None], _SEEDS[HASHES:, None]

    def run(batches):
        for batch in w.slices(batches):
            sets = shingle_sets(batch.column("text"), size)
            rows = len(sets)
            least = np.full((rows, HASHES), 2**64 - 1, np.uint64)
            hashes = np.zeros((rows, 2), np.uint64)
            for row, members in enumerate(sets):
                if not len(members):
                    continue
                hashes[row] = _set_hash(members)
                for at in range(0, len(members), _CHUNK):
                    np.minimum(least[row], (a * members[at : at + _CHUNK] + b).min(1), out=least[row])
            mixed = w.mix(least)
            bands = w.mix((mixed * _BAND).reshape(rows, BANDS, ROWS).sum(2))
            bits = np.zeros((rows, 256), np.uint8)
            bits[:, :HASHES] = mixed & np.uint64(1)
            signature = np.packbits(bits, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), _signed(hashes[:, 0].copy()),
                    _signed(hashes[:, 1].copy()), w.as_lists(_signed(bands.ravel()), BANDS * np.arange(rows + 1)),
                    *(pa.array(signature[:, i].copy()) for i in range(4)),
                ],
                ["doc_id", "n_shingles", "set1", "set2", "bands", *SIGNATURE],
            )
        w.release()

    return run


def _matching(size: int):
    """Of the rows that share a node's id, the sets of those that have the node's set."""

    def run(batches):
        for batch in w.slices(batches):
            sets = shingle_sets(batch.column("text"), size)
            wanted = zip(batch.column("set1").to_pylist(), batch.column("set2").to_pylist())
            same = [(x - a) % 2**64 == 0 and (y - b) % 2**64 == 0 for (x, y), (a, b) in zip(map(_set_hash, sets), wanted)]
            kept = [members for members, good in zip(sets, same) if good]
            bounds = np.concatenate([[0], np.cumsum([len(members) for members in kept])]).astype(np.int64)
            flat = np.concatenate(kept) if kept else np.empty(0, np.uint64)
            nodes = batch.column("node").filter(pa.array(same, pa.bool_()))
            yield pa.RecordBatch.from_arrays([nodes, w.as_lists(_signed(flat), bounds)], ["node", "members"])
        w.release()

    return run


def _confirmer(percent: int):
    def run(batches):
        against = np.empty(0, np.uint64)
        for batch in batches:
            lists, us = batch.column("members"), batch.column("u").to_pylist()
            bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            flat, keep = lists.flatten().to_numpy().view(np.uint64), np.zeros(len(us), bool)
            for row, u in enumerate(us):
                members = flat[bounds[row] : bounds[row + 1]]
                if u is None:
                    against = members.copy()
                    continue
                at = np.searchsorted(against, members)
                at[at == len(against)] = 0
                shared = np.count_nonzero(against[at] == members)
                keep[row] = 100 * shared >= percent * (len(members) + len(against) - shared)
            yield batch.select(["u", "v"]).filter(pa.array(keep))
        w.release()

    return run


cloudpickle.register_pickle_by_value(sys.modules[__name__])
