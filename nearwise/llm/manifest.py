"""A Merkle manifest of a table: digests of its rows in trees of digests, and a proof for every row.

Rows of a group are the leaves of one tree, in order; the roots of the groups are the leaves of a last tree. A node is the
SHA-256 digest (lowercase hex) of its children's digests, in runs of ``FANOUT`` nodes; also a last run of one node becomes a
new digest. The manifest is content-addressed: its tables hold records from a digest to the digests below it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from nearwise.llm.ranks import rank_in_groups, whole_runs
from nearwise.session import materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 3
#: Levels of a tree that one task builds or descends at a time, so few that a block of nodes stays small.
LEVELS = 6
BLOCK = FANOUT**LEVELS

PATH = "array<struct<`left`:string,`right`:string>>"


class Manifest(NamedTuple):
    """``leaves``: ``tree, pos, digest, carried`` of every row. ``bands``: from the leaves up, the records of each
    ``LEVELS`` levels of the groups' trees. ``roots``: ``tree, pos, subroot``. ``root_bands``: the records above them."""

    leaves: DataFrame
    bands: list[DataFrame]
    roots: DataFrame
    root_bands: list[DataFrame]
    root: str | None


def row_digest(*values: Column) -> Column:
    """The SHA-256 digest of a row's values: each ``-`` if null, else its length in UTF-8 bytes, ``:`` and itself."""

    def written(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(written, values)).cast("binary"), 256)


def build_manifest(
    rows: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", order: str = "doc_id",
    carry: Column | None = None,
) -> Manifest:
    """Digest every row once, order the digests within their groups, and store the records of all trees.

    Texts never leave the task that reads them: only digests, groups, order and the struct ``carry`` go on. Leaves
    ascend by ``order`` (nulls first), then by digest; equal rows are leaves of their own. Groups ascend bytewise, the null
    group first. A table without rows has no root. Other columns of ``rows`` are not read.
    """
    carried = F.struct(F.col(order).alias(order)) if carry is None else carry
    leaves = rows.select(
        F.col(group).cast("string").alias("tree"), F.col(order).alias("leaf_order"),
        row_digest(*(F.col(name) for name in fields)).alias("digest"), carried.alias("carried"),
        F.monotonically_increasing_id().alias("row_no"),
    )
    leaves = materialize(leaves, "manifest-leaves")
    ranked = rank_in_groups(leaves, ["tree"], ["leaf_order", "digest", "row_no"], "pos")
    bands, tops = _build(ranked)
    subroots = tops.select("tree", F.col("digest").alias("subroot"), F.lit(0).alias("all"))
    roots = rank_in_groups(materialize(subroots, "manifest-subroots"), ["all"], ["tree"], "pos").drop("all")
    root_bands, top = _build(roots.select(F.lit(None).cast("string").alias("tree"), "pos", F.col("subroot").alias("digest")))
    found = top.select("digest").first()
    return Manifest(ranked.drop("leaf_order", "row_no"), bands, roots, root_bands, found and found.digest)


def _build(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Records of all bands of the trees over ``nodes(tree, pos, digest)``, and the last nodes, one for each tree.

    A band leaves one node of ``BLOCK`` of a tree, so there are log(rows) / log(BLOCK) bands.
    """
    bands, block = [], F.expr(f"pos div {BLOCK}")
    while True:
        dealt = nodes.select("tree", block.alias("block"), "pos", "digest").repartition("tree", "block")
        dealt = dealt.sortWithinPartitions("tree", "block", "pos").drop("pos")
        schema = "tree string, block long, digest string, children array<string>, height int"
        built = materialize(dealt.mapInArrow(_build_blocks, schema), "manifest-nodes")
        bands.append(built.where("children IS NOT NULL"))
        nodes = built.where("children IS NULL").select("tree", F.col("block").alias("pos"), "digest")
        if not nodes.agg(F.max("pos")).first()[0]:
            return bands, nodes


def _build_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of each block of nodes, and a row without children for the node at its top.

    A block that is full or not the first has all levels; any other is a whole tree, which ends with one node.
    """
    for batch, bounds in whole_runs(batches, 2):
        numbers, digests = batch.column(1).to_numpy(), batch.column(2).to_pylist()
        at, digest, children, heights = [], [], [], []
        for start, stop in zip(bounds, bounds[1:]):
            level, height = digests[start:stop], LEVELS
            if not numbers[start] and len(level) < BLOCK:
                height = next(h for h in range(LEVELS + 1) if FANOUT**h >= len(level))
            for _ in range(height):
                runs = [level[i : i + FANOUT] for i in range(0, len(level), FANOUT)]
                level = [sha256("".join(run).encode()).hexdigest() for run in runs]
                digest += level
                children += runs
            digest += level
            children.append(None)
            heights += [height] * (len(digest) - len(at))
            at += [start] * (len(digest) - len(at))
        yield pa.RecordBatch.from_arrays(
            [
                *(column.take(pa.array(at)) for column in batch.columns[:2]), pa.array(digest, pa.string()),
                pa.array(children, pa.list_(pa.string())), pa.array(heights, pa.int32()),
            ],
            ["tree", "block", "digest", "children", "height"],
        )


def prove(manifest: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """``tree, pos, leaf, subroot, siblings, carried`` of every requested leaf (``tree, pos, carried``; by default all).

    ``siblings`` holds for each level, from the leaf up to the root, the digests beside the node on the way, those to its
    left and those to its right. Requests descend from the root: each digit of a leaf's place picks a child of the record
    found under the digest reached, the other children are collected, and at last the path is reversed. Requests that share
    their first digits go down together, so only the last ``LEVELS`` digits are walked for each leaf, beside the records of
    its block. A request for a place that the manifest does not have is an error.
    """
    spark = manifest.leaves.sparkSession
    wanted = manifest.leaves.select("tree", "pos", "carried") if requests is None else requests
    trees = wanted.select(F.col("tree").alias("asked")).distinct()
    roots = manifest.roots.join(trees, F.col("tree").eqNullSafe(F.col("asked")), "left_semi")
    roots = roots.select(F.lit(None).cast("string").alias("tree"), "pos", F.struct("tree").alias("carried"))
    top = spark.range(1 if manifest.root else 0).select(
        F.lit(None).cast("string").alias("tree"), F.lit(0).cast("long").alias("pos"), F.lit(manifest.root).cast("string").alias("digest"),
        F.lit(manifest.root).cast("string").alias("subroot"), F.array().cast(PATH).alias("path"),
    )
    subroots = _walk(manifest.root_bands, top, roots)
    subroots = subroots.select(
        "carried.tree", F.lit(0).cast("long").alias("pos"), "digest", F.col("digest").alias("subroot"), "path"
    )
    found = _walk(manifest.bands, subroots, wanted)
    return found.select("tree", "pos", F.col("digest").alias("leaf"), "subroot", F.reverse("path").alias("siblings"), "carried")


def _walk(bands: list[DataFrame], reached: DataFrame, requests: DataFrame) -> DataFrame:
    """Descend all bands from ``reached(tree, pos, digest, subroot, path)``, one row for each tree."""
    for number in reversed(range(len(bands))):
        prefix = F.expr(f"pos div {BLOCK**number}").alias("pos")
        wanted = requests.select("tree", prefix).distinct() if number else requests
        reached = _descend(bands[number], reached, wanted)
    return reached


def _descend(records: DataFrame, reached: DataFrame, requests: DataFrame) -> DataFrame:
    """The digests and paths of ``requests(tree, pos, ...)`` from those ``reached`` at the tops of their blocks.

    Records, tops and requests of a block meet in one task in this order; a block has at most ``BLOCK`` requested places.
    """
    carried = [field for field in requests.schema.fields if field.name == "carried"]
    dealt = records.withColumn("kind", F.lit(0)).unionByName(
        reached.withColumnRenamed("pos", "block").withColumn("kind", F.lit(1)), allowMissingColumns=True
    ).unionByName(
        requests.withColumns({"block": F.expr(f"pos div {BLOCK}"), "kind": F.lit(2)}), allowMissingColumns=True
    )
    dealt = dealt.repartition("tree", "block").sortWithinPartitions("tree", "block", "kind")
    columns = ["tree", "block", "kind", "pos", "digest", "subroot", "children", "height", "path"]
    schema = f"tree string, pos long, digest string, subroot string, path {PATH}"
    schema += "".join(f", carried {field.dataType.simpleString()}" for field in carried)
    return dealt.select(*columns, *(field.name for field in carried)).mapInArrow(_descend_blocks, schema)


def _descend_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, bounds in whole_runs(batches, 2):
        kinds, digests = batch.column(2).to_numpy(), batch.column(4).to_pylist()
        places = batch.column(3).fill_null(0).to_numpy() % BLOCK
        rows, tops, ends, steps, left, right = [], [], [], [0], [], []
        for start, stop in zip(bounds, bounds[1:]):
            top, first = start + np.searchsorted(kinds[start:stop], [1, 2])
            if first == stop:
                continue
            if first != top + 1:
                raise ValueError("a leaf was requested that the manifest does not have")
            below = dict(zip(digests[start:top], batch.column(6).slice(start, top - start).to_pylist()))
            height = batch.column(7)[start].as_py() if top > start else 0
            way = batch.column(8)[top].as_py()
            for row in range(first, stop):
                digest = digests[top]
                left += [step["left"] for step in way]
                right += [step["right"] for step in way]
                for level in reversed(range(height)):
                    children, digit = below[digest], places[row] // FANOUT**level % FANOUT
                    if digit >= len(children):
                        raise ValueError("a leaf was requested that the manifest does not have")
                    left.append("".join(children[:digit]))
                    right.append("".join(children[digit + 1 :]))
                    digest = children[digit]
                ends.append(digest)
                steps.append(len(left))
            rows += range(first, stop)
            tops += [top] * (stop - first)
        if rows:
            path = pa.ListArray.from_arrays(
                pa.array(steps, pa.int32()),
                pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["left", "right"]),
            )
            at, over = pa.array(rows), pa.array(tops)
            out = [batch.column(0).take(at), batch.column(3).take(at), pa.array(ends, pa.string()), batch.column(5).take(over), path]
            out += [column.take(at) for column in batch.columns[9:]]
            yield pa.RecordBatch.from_arrays(out, ["tree", "pos", "digest", "subroot", "path", "carried"][: len(out)])


def fold(leaf: Column, siblings: Column) -> Column:
    """The root that a leaf and its siblings make."""
    return F.aggregate(siblings, leaf, lambda node, run: F.sha2(F.concat(run["left"], node, run["right"]), 256))


def siblings_digest(siblings: Column) -> Column:
    """The SHA-256 digest of all siblings, from the leaf up, left to right."""
    return F.sha2(F.array_join(F.transform(siblings, lambda run: F.concat(run["left"], run["right"])), "").cast("binary"), 256)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
