"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from nearwise.session import materialize


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest node that can be reached from it, for every node of ``links(u, v)``.

    A large-star step links each larger neighbour of a node to the smallest node around it, a small-star step each
    smaller one; in the end every component is a star about its smallest node. Each step is a grouped minimum (combined
    before the shuffle) and a join of links with one row for each node, so no node's neighbours meet in one task. Steps
    are written to the shared folder, which cuts the plan. An empty table gives an empty one.
    """
    stars = materialize(_small_star(_large_star(links)), "stars")
    while not _settled(stars):
        stars = materialize(_small_star(_large_star(stars)), "stars")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        stars.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("least"))
    near = both.where(F.col("v") > F.col("u")).join(least, "u")
    return near.select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("least"))
    near = down.join(least, "u").where(F.col("v") != F.col("least"))
    moved = near.select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.union(least.select("u", F.col("least").alias("v"))).distinct()


def _settled(links: DataFrame) -> bool:
    """Whether the links, each from a larger to a smaller node, are stars: a node is a centre, or has one link to one."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("leaf")).union(links.select("v", F.lit(0)))
    roles = ends.groupBy("node").agg(F.sum("leaf").alias("leaves"), F.min("leaf").alias("least"))
    return not roles.where((F.col("leaves") > 1) | (F.col("leaves") > 0) & (F.col("least") == 0)).head(1)
