"""Comparing the result lists of two metrics.

All operators read the hits once and group them by query, so the search behind them runs once. A query's
group holds its two result lists, at most 2k rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def compare_metrics(hits: DataFrame, k: int, queries: DataFrame | None = None) -> DataFrame:
    """Per query: both id lists in rank order, the common ids, the overlap share of ``k``, score ranges.

    With ``queries`` every query appears, also one without hits.
    """
    lists = hits.groupBy("query_id").agg(
        _ranked(_of("l2", "doc_id"), "l2").alias("l2_ids"),
        _ranked(_of("cosine", "doc_id"), "cosine").alias("cosine_ids"),
        F.min(_of("l2", "score")).alias("l2_min"),
        F.max(_of("l2", "score")).alias("l2_max"),
        F.min(_of("cosine", "score")).alias("cosine_min"),
        F.max(_of("cosine", "score")).alias("cosine_max"),
    )
    if queries is not None:
        none = F.array().cast("array<bigint>")
        lists = queries.select("query_id").join(lists, "query_id", "left").withColumns(
            {name: F.coalesce(name, none) for name in ("l2_ids", "cosine_ids")}
        )
    common = F.sort_array(F.array_intersect("l2_ids", "cosine_ids"))
    return lists.withColumn("common_ids", common).withColumns(
        {"common_count": F.size("common_ids"), "common_share": F.size("common_ids") / F.lit(float(k))}
    )


def compare_names(hits: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """Per query: the names found under both metrics, in order, and their share of the l2 list.

    Names are compared as sets: equal names of different rows count once.
    """
    lists = hits.groupBy("query_id").agg(
        F.collect_set(_of("l2", "name")).alias("l2_names"),
        F.collect_set(_of("cosine", "name")).alias("cosine_names"),
        F.count(_of("l2", "doc_id")).alias("l2_count"),
    )
    if queries is not None:
        none = F.array().cast("array<string>")
        lists = queries.select("query_id").join(lists, "query_id", "left").withColumns(
            {
                "l2_names": F.coalesce("l2_names", none),
                "cosine_names": F.coalesce("cosine_names", none),
                "l2_count": F.coalesce("l2_count", F.lit(0).cast("long")),
            }
        )
    common = F.sort_array(F.array_intersect("l2_names", "cosine_names"))
    return lists.select(
        "query_id",
        "l2_count",
        common.alias("common_names"),
        F.size(common).alias("common_count"),
        F.try_divide(F.size(common), F.col("l2_count")).alias("common_share"),
    )


def compare_aligned(hits: DataFrame) -> DataFrame:
    """Per query and row: its rank and score under each metric (null where absent) and the rank change."""
    aligned = hits.groupBy("query_id", "doc_id").agg(
        F.max(_of("l2", "rank")).alias("l2_rank"),
        F.max(_of("cosine", "rank")).alias("cosine_rank"),
        F.max(_of("l2", "score")).alias("l2_score"),
        F.max(_of("cosine", "score")).alias("cosine_score"),
    )
    return aligned.withColumn("rank_change", F.col("cosine_rank") - F.col("l2_rank"))


def _of(metric: str, column: str) -> Column:
    return F.when(F.col("metric") == metric, F.col(column))


def _ranked(value: Column, metric: str) -> Column:
    entry = F.when(F.col("metric") == metric, F.struct("rank", value.alias("value")))
    return F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["value"])
