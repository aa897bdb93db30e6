"""Facet filters, and finding a facet named inside a query text."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from nearwise.functions.text import clean_query_text
from nearwise.operators.needles import Needles, first_contained, index_needles
from nearwise.session import fresh_path, materialize

# The label that means "no facet", the class of facets every filter lets through, and the
# names looked for in query texts, in order of priority.
ALL_FACETS = "All States"
ALWAYS_CONTAINS = "ministry"
STATES = (
    "Andhra Pradesh", "Arunachal Pradesh", "Assam", "Bihar", "Chhattisgarh", "Goa", "Gujarat", "Haryana",
    "Himachal Pradesh", "Jharkhand", "Karnataka", "Kerala", "Madhya Pradesh", "Maharashtra", "Manipur",
    "Meghalaya", "Mizoram", "Nagaland", "Odisha", "Punjab", "Rajasthan", "Sikkim", "Tamil Nadu",
    "Telangana", "Tripura", "Uttar Pradesh", "Uttarakhand", "West Bengal", "Andaman and Nicobar Islands",
    "Chandigarh", "Dadra and Nagar Haveli and Daman and Diu", "Delhi", "Jammu and Kashmir", "Ladakh",
    "Lakshadweep", "Puducherry",
)

MAX_INLINE_VALUES = 512  # dictionary values tested by one expression
MAX_INLINE_LETTERS = 1 << 16
BLOCK_BYTES = 32 << 20  # needles with their index that a task may hold


def facet_equals(facet: Column, value: Column) -> Column:
    """Case-insensitive equality; null is false."""
    return F.coalesce(F.lower(facet) == F.lower(value), F.lit(False))


def facet_always(facet: Column, always_contains: str | None = ALWAYS_CONTAINS) -> Column:
    """Whether a facet belongs to the class that passes every filter; null is false."""
    if always_contains is None:
        return F.lit(False)
    return F.coalesce(F.contains(F.lower(facet), F.lit(always_contains.lower())), F.lit(False))


def facet_match(facet: Column, value: Column, always_contains: str | None = ALWAYS_CONTAINS) -> Column:
    """The facet filter: equal to the value, or in the always-included class."""
    return facet_equals(facet, value) | facet_always(facet, always_contains)


def facet_bucket(facet: Column, value: Column, always_contains: str | None = ALWAYS_CONTAINS) -> Column:
    """0 for the value itself, 1 for the always-included class, 2 for the rest."""
    return (
        F.when(facet_equals(facet, value), 0)
        .when(facet_always(facet, always_contains), 1)
        .otherwise(2)
    )


def resolve_facet(queries: DataFrame, explicit: str = "explicit_facet", detected: str = "detected_facet") -> DataFrame:
    """Add ``facet_used`` (an explicit facet wins over a detected one) and ``facet_origin``."""
    chosen = F.nullif(F.nullif(F.col(explicit), F.lit(ALL_FACETS)), F.lit(""))
    used = F.coalesce(chosen, F.nullif(F.col(detected), F.lit("")))
    origin = F.when(chosen.isNotNull(), "explicit").when(used.isNotNull(), "detected").otherwise("none")
    return queries.withColumns({"facet_used": used, "facet_origin": origin})


def facet_options(records: DataFrame, facet: str = "facet", sentinel: str = ALL_FACETS) -> DataFrame:
    """The choices of a facet list: the sentinel first, then the distinct values in order."""
    values = records.where(F.col(facet).isNotNull()).select(F.col(facet).alias("option")).distinct()
    head = records.sparkSession.range(1).select(F.lit(sentinel).alias("option"), F.lit(0).alias("section"))
    return head.unionByName(values.withColumn("section", F.lit(1))).orderBy("section", "option")


def detect_facet(
    texts: DataFrame,
    dictionary: DataFrame | Sequence[str] = STATES,
    *,
    key: str = "query_id",
    text: str = "text",
    word_boundary: bool = False,
    max_inline: int = MAX_INLINE_VALUES,
) -> DataFrame:
    """Add ``detected_facet``: the first dictionary value, in dictionary order, contained in the text.

    The test ignores case and, unless ``word_boundary`` is set, also finds values inside longer words.
    ``dictionary`` is a list, or a table of ``(pos, value)``; of values that read alike the lowest position counts. A
    dictionary of checked small size becomes one expression. A larger one is broadcast as an index of hashes; beyond
    ``BLOCK_BYTES`` in blocks, one after the other, so memory does not grow with it. Every row is answered for itself, so
    keys may be null or repeat (``key`` is not read).
    """
    spark = texts.sparkSession
    if not isinstance(dictionary, DataFrame):
        dictionary = spark.createDataFrame(list(enumerate(dictionary)), "pos int, value string")
    dictionary = dictionary.where(F.col("value").isNotNull())
    n, letters = dictionary.agg(F.count("*"), F.coalesce(F.sum(F.length("value")), F.lit(0))).first()
    if n <= max_inline and letters <= MAX_INLINE_LETTERS:
        values = [row.value for row in sorted(dictionary.select("pos", "value").collect())]
        return texts.withColumn("detected_facet", _first_contained(F.col(text), values, word_boundary))
    return _detect_in_blocks(texts, dictionary, text, word_boundary)


def _first_contained(text: Column, values: list[str], word_boundary: bool) -> Column:
    if not values:
        return F.lit(None).cast("string")
    needles = F.array(*[_needle(F.lit(value), word_boundary) for value in values])
    originals = F.array(*[F.lit(value) for value in values])
    entries = F.arrays_zip(needles.alias("needle"), originals.alias("value"))  # constant, folded when planned
    # The one-element array binds the lowered text once for all tests.
    found = F.transform(
        F.array(_haystack(text, word_boundary)),
        lambda hay: F.get(F.filter(entries, lambda e: F.contains(hay, e["needle"])), F.lit(0))["value"],
    )
    return F.get(found, F.lit(0))


def _haystack(text: Column, word_boundary: bool) -> Column:
    return F.concat(F.lit(" "), clean_query_text(text), F.lit(" ")) if word_boundary else F.lower(text)


def _needle(value: Column, word_boundary: bool) -> Column:
    return F.concat(F.lit(" "), clean_query_text(value), F.lit(" ")) if word_boundary else F.lower(value)


def _detect_in_blocks(texts: DataFrame, dictionary: DataFrame, text: str, word_boundary: bool) -> DataFrame:
    """Search for a dictionary of any size: in place while its needles fit, else for one block of them after the other.

    Only the text goes through Python. With several blocks the rows are stored under numbers of their own, each block
    scans them and writes what it finds, and the first value found of each row is joined back.
    """
    needles = dictionary.groupBy(_needle(F.col("value"), word_boundary).alias("needle")).agg(
        F.min(F.struct("pos", "value")).alias("first")
    )
    needles = materialize(needles.select("needle", "first.pos", "first.value"), "facet-needles")
    size = needles.agg(F.coalesce(F.sum(F.octet_length("needle") + F.octet_length("value") + 64), F.lit(0))).first()[0]
    n_blocks = max(1, -(-size // BLOCK_BYTES))
    hay = _haystack(F.col(text), word_boundary)
    if n_blocks == 1:
        return texts.withColumn("detected_facet", _finder(needles)(hay)["value"])
    row = "row number"
    stored = materialize(texts.withColumn(row, F.monotonically_increasing_id()), "facet-texts")
    hits = fresh_path(texts.sparkSession, "facet-hits")
    for block in range(n_blocks):
        find = _finder(needles.where(F.pmod(F.xxhash64("needle"), F.lit(n_blocks)) == block))
        found = stored.select(row, find(hay).alias("found"))
        found.where(F.col("found").isNotNull()).select(row, "found.*").write.parquet(f"{hits}/block={block}")
    found = texts.sparkSession.read.parquet(f"{hits}/*").groupBy(row).agg(F.min(F.struct("pos", "value")).alias("found"))
    joined = stored.join(found, row, "left")
    return joined.select(*(F.col(f"`{name}`") for name in texts.columns), F.col("found.value").alias("detected_facet"))


def _finder(needles: DataFrame):
    """A function of a text: position and value of the first needle that it contains, or null."""
    table = needles.orderBy("pos", "needle").toArrow().combine_chunks()
    texts, first, value = (pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type) for column in table.columns)
    shared = needles.sparkSession.sparkContext.broadcast((tuple(index_needles(texts)), first, value))
    kind = T.StructType().add("pos", needles.schema["pos"].dataType).add("value", "string")

    @F.arrow_udf(kind)
    def find(hays: pa.Array) -> pa.Array:
        index, first, value = shared.value
        rank = first_contained(hays, Needles(*index))
        at = pa.array(rank, mask=rank == len(first))
        return pa.StructArray.from_arrays([first.take(at), value.take(at)], ["pos", "value"], mask=at.is_null())

    return find


cloudpickle.register_pickle_by_value(__import__("sys").modules[__name__])
