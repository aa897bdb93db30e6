"""Looking at a table: preview, column profile, vector statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from nearwise.functions.vectors import l2_norm


def preview(records: DataFrame, key: str = "doc_id", n: int = 5) -> DataFrame:
    """The first rows by key."""
    return records.orderBy(key).limit(n)


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: position, type, rows and non-null values, counted in one pass."""
    counted = df.agg(
        F.count("*").alias("rows"), *[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(df.columns)]
    )
    entries = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(field.name).alias("column_name"),
            F.lit(field.dataType.simpleString()).alias("data_type"),
            F.col("rows").alias("rows"),
            F.col(f"n{i}").alias("non_null"),
        )
        for i, field in enumerate(df.schema.fields)
    ]
    return counted.select(F.inline(F.array(*entries)))


def vector_stats(vectors: DataFrame, vector: str = "embedding", digits: int = 6) -> DataFrame:
    """Size, dimension and length range of a vector table, and how many vectors are null or zero."""
    measured = vectors.select(F.size(vector).alias("dim"), l2_norm(vector).alias("norm"))
    measured = measured.withColumn("dim", F.when(F.col("norm").isNotNull(), F.col("dim")))
    return measured.agg(
        F.count("*").alias("n_rows"),
        F.count("dim").alias("n_vectors"),
        F.count_if(F.col("norm") == 0).alias("n_zero"),
        F.min("dim").alias("min_dim"),
        F.max("dim").alias("max_dim"),
        F.round(F.min("norm"), digits).alias("min_norm"),
        F.round(F.max("norm"), digits).alias("max_norm"),
    )
