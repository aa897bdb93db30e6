"""Ranking within keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def rank_within(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Add the 1-based row number of each row within its keys."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_k(
    df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank", part: str | None = None
) -> DataFrame:
    """The first ``k`` rows of each key, ranked.

    Spark cuts each map task's share to ``k`` rows per key before the shuffle. ``part`` names a column
    that splits a key's candidates into groups, which are cut to ``k`` rows each in a shuffle of their own,
    so that no task receives all candidates of a hot key.
    """
    if part is not None:
        df = rank_within(df, [*keys, part], order, name).where(F.col(name) <= k).drop(name)
    return rank_within(df, keys, order, name).where(F.col(name) <= k)
