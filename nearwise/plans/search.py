"""Retrieval for whole tables of queries."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from nearwise.functions.tags import render_tags
from nearwise.functions.text import CLEANERS, add_combined_text, four_decimals, title_case
from nearwise.operators import bloom
from nearwise.operators.embed import DIM, embed_tfidf, embed_with, fit_terms
from nearwise.operators.facets import ALWAYS_CONTAINS, facet_always, facet_bucket, facet_match
from nearwise.operators.knn import METRICS, Facets, Postfilter, knn_join, nearest_first
from nearwise.operators.topk import rank_within
from nearwise.session import materialize
from nearwise.sources.records import corpus_mapping
from nearwise.sources.vector_table import UnfinishedTable, load_vectors, write_vectors

DISPLAY_COLUMNS = ("name", "facet", "description", "tags")
MAX_HITS_BROADCAST_BYTES = 32 << 20
HIT_BYTES = 128


class Settings(NamedTuple):
    """What corpus and queries must agree on: the cleaner of their texts and the width of their vectors."""

    cleaner: str = "index"
    dim: int = DIM


class SearchTables(NamedTuple):
    """What a search needs: records with their combined text, the terms (none with an encoder), the vectors."""

    corpus: DataFrame
    terms: DataFrame | None
    vectors: DataFrame
    settings: Settings = Settings()


def combined_corpus(records: DataFrame, cleaner: str) -> DataFrame:
    """The records with their texts cleaned and combined.

    ``records`` has ``doc_id, name, facet, description, tags``; tags may be text or an array.
    """
    flat = dict(records.dtypes)["tags"] == "array<string>"
    source = records.withColumn("tags_text", render_tags(F.col("tags")) if flat else F.col("tags"))
    return add_combined_text(source, ("name", "description", "tags_text"), cleaner).drop("tags_text")


def build_corpus(
    records: DataFrame, cleaner: str = "index", dim: int = DIM, load_encoder: Callable | None = None
) -> SearchTables:
    """Clean and combine the texts of the records and turn them into vectors ``(doc_id, facet, embedding)``.

    Vectors come from ``load_encoder`` when given, else from the terms of these records.
    """
    return _embedded(combined_corpus(records, cleaner), Settings(cleaner, dim), load_encoder)


def _embedded(corpus: DataFrame, settings: Settings, load_encoder: Callable | None) -> SearchTables:
    if load_encoder is not None:
        return SearchTables(corpus, None, embed_with(corpus, load_encoder, carry=["facet"]), settings)
    terms = fit_terms(corpus, dim=settings.dim)
    return SearchTables(corpus, terms, embed_tfidf(corpus, terms, dim=settings.dim, carry=["facet"]), settings)


def write_search_tables(
    records: DataFrame, base: str, cleaner: str = "index", dim: int = DIM, load_encoder: Callable | None = None
) -> None:
    """Store the mapping, the terms, the vectors and the settings as tables under one folder.

    The mapping is written first: terms and vectors are made from the texts it holds, which are cleaned once. The
    settings are written last, because their presence says that the set is complete.
    """
    spark = records.sparkSession
    corpus_mapping(combined_corpus(records, cleaner)).write.mode("overwrite").parquet(f"{base}/mapping")
    tables = _embedded(spark.read.parquet(f"{base}/mapping"), Settings(cleaner, dim), load_encoder)
    if tables.terms is not None:
        tables.terms.write.mode("overwrite").parquet(f"{base}/terms")
    write_vectors(tables.vectors, f"{base}/vectors", mode="overwrite")
    row = (cleaner, dim, load_encoder is None)
    spark.createDataFrame([row], _SETTINGS).coalesce(1).write.mode("overwrite").parquet(f"{base}/settings")


_SETTINGS = "cleaner string, dim int, with_terms boolean"


def load_search_tables(spark: SparkSession, base: str) -> SearchTables:
    """Open stored tables; a missing or unfinished set is an error."""
    stored = spark.read.schema(_SETTINGS).parquet(f"{base}/settings").collect()
    if len(stored) != 1:
        raise UnfinishedTable(f"the tables at {base} were not written to their end")
    terms = spark.read.parquet(f"{base}/terms") if stored[0].with_terms else None
    settings = Settings(stored[0].cleaner, stored[0].dim)
    return SearchTables(spark.read.parquet(f"{base}/mapping"), terms, load_vectors(spark, f"{base}/vectors"), settings)


def ensure_search_tables(
    records: DataFrame, base: str, cleaner: str | None = None, dim: int | None = None, load_encoder: Callable | None = None
) -> SearchTables:
    """Open stored tables, building them from the records first when there is no complete set.

    Stored tables of another cleaner or width than asked for, or with terms where an encoder is given or the other
    way round, are an error.
    """
    spark = records.sparkSession
    try:
        tables = load_search_tables(spark, base)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        tables = None
    except UnfinishedTable:
        tables = None
    if tables is None:
        write_search_tables(records, base, cleaner or Settings().cleaner, dim or Settings().dim, load_encoder)
        tables = load_search_tables(spark, base)
    _check(tables.settings, cleaner, dim)
    if (tables.terms is None) != (load_encoder is not None):
        raise ValueError(f"the tables at {base} were made {'with an encoder' if tables.terms is None else 'from terms'}")
    return tables


def _check(settings: Settings, cleaner: str | None, dim: int | None) -> Settings:
    wanted = Settings(cleaner or settings.cleaner, dim or settings.dim)
    if wanted != settings:
        raise ValueError(f"the tables were made with {settings}, not with {wanted}")
    return wanted


def nonblank(queries: DataFrame, text: str = "text") -> DataFrame:
    """Queries with something to search for."""
    return queries.where(F.length(F.trim(F.regexp_replace(text, r"[\s\x1c-\x1f\x85\p{Z}]+", " "))) > 0)


def embed_queries(
    queries: DataFrame, terms: DataFrame | SearchTables, cleaner: str | None = None, dim: int | None = None
) -> DataFrame:
    """Vectors of query texts, made as the corpus vectors were; words the corpus lacks are ignored.

    Given search tables, cleaner and width are theirs, and asking for others is an error. Given a table of terms only,
    they default to those of ``build_corpus``.
    """
    if isinstance(terms, SearchTables):
        cleaner, dim = _check(terms.settings, cleaner, dim)
        terms = terms.terms
    cleaned = queries.select("query_id", CLEANERS[cleaner or Settings().cleaner]("text").alias("combined_text"))
    return embed_tfidf(cleaned, terms, key="query_id", dim=dim or Settings().dim)


def search_text(
    queries: DataFrame, tables: SearchTables, *, k: int = 10, metric: str = "l2", digits: int | None = None
) -> DataFrame:
    """Text queries to ranked hits under one metric."""
    embedded = embed_queries(nonblank(queries), tables)
    return knn_join(embedded, tables.vectors, k, metrics=[metric], digits=digits)


def search_compare(
    queries: DataFrame,
    vectors: DataFrame,
    *,
    k: int = 10,
    overfetch: int = 10,
    mode: str = "postfilter",
    always_contains: str | None = ALWAYS_CONTAINS,
    metrics: tuple[str, ...] = METRICS,
    digits: int | None = None,
) -> DataFrame:
    """Facet-filtered retrieval under both metrics.

    ``queries`` has ``query_id, embedding`` and ``facet_used`` (null for no filter); ``vectors`` has
    ``doc_id, facet, embedding``. In ``postfilter`` mode one scan finds the ``k * overfetch`` nearest rows, which are
    filtered and cut to ``k``, so a matching row further away is not found; ``prefilter`` ranks matching rows only. A
    query whose filter leaves nothing gets its unfiltered nearest rows. ``fallback_used`` is true in that
    case, false when the filter was applied and null when there was none.

    ``prefilter`` takes two phases. The first reads the asked facets only, which of a table partitioned by facet
    (:func:`write_vectors`) are the files of those facets. The second scans all rows for the queries that ask for no
    facet or found nothing; without such queries it reads nothing.
    """
    if mode == "prefilter":
        return _search_prefiltered(queries, vectors, k, always_contains, metrics, digits)
    if mode != "postfilter":
        raise ValueError(f"unknown mode: {mode}")
    used = F.col("facet_used")

    def test(used: Column, facet: Column) -> Column:
        return used.isNull() | facet_match(facet, used, always_contains)

    found = knn_join(
        queries, vectors, k * overfetch, metrics=metrics, query_carry=["facet_used"], corpus_carry=["facet"],
        postfilter=Postfilter("facet_used", "facet", test, k), digits=digits,
    )
    return found.select(*FOUND, F.when(used.isNotNull(), ~F.col("any_match")).alias("fallback_used"))


FOUND = ("query_id", "metric", "rank", "doc_id", "score", "facet", "facet_used")
MAX_LISTED_FACETS = 1000  # facets named one by one in a filter


def _search_prefiltered(
    queries: DataFrame, vectors: DataFrame, k: int, always_contains: str | None, metrics: tuple[str, ...], digits: int | None
) -> DataFrame:
    carry = {"metrics": metrics, "query_carry": ["facet_used"], "corpus_carry": ["facet"], "digits": digits}
    used = F.col("facet_used")
    queries = materialize(queries.select("query_id", "embedding", "facet_used"), "prefilter-queries")
    asking = queries.where(used.isNotNull())
    always = facet_always(F.col("facet"), always_contains)
    test = Facets(query=used, corpus=F.col("facet"), always=always)
    first = knn_join(asking, of_facets(vectors, asking, always), k, prefilter=test, **carry)
    first = materialize(first, "prefilter-hits")
    lists = first.groupBy("query_id").agg(F.count_distinct("metric").alias("lists"))
    served = lists.where(F.col("lists") == len(metrics)).select("query_id")
    open_queries = queries.where(used.isNull()).union(asking.join(served, "query_id", "left_anti"))
    second = knn_join(open_queries, vectors, k, **carry)
    second = second.join(first.select("query_id", "metric").distinct(), ["query_id", "metric"], "left_anti")
    return first.select(*FOUND, F.lit(False).alias("fallback_used")).union(
        second.select(*FOUND, F.when(used.isNotNull(), F.lit(True)).alias("fallback_used"))
    )


def of_facets(vectors: DataFrame, asking: DataFrame, always: Column) -> DataFrame:
    """The vectors of facets that ``asking`` has in ``facet_used``, ignoring case, and those that pass every filter.

    Up to ``MAX_LISTED_FACETS`` distinct facets are named in the filter, so that Spark picks the files of a partitioned
    table when it plans; more of them are a table that the vectors are joined with.
    """
    facet = F.lower("facet")
    asked = materialize(asking.select(F.lower("facet_used").alias("asked")).distinct(), "asked-facets")
    if asked.count() <= MAX_LISTED_FACETS:
        return vectors.where(facet.isin([row.asked for row in asked.collect()]) | always)
    return vectors.where(always).union(vectors.where(~always).join(asked, facet == F.col("asked"), "left_semi"))


def materialize_hits(hits: DataFrame, corpus: DataFrame, max_hits: int | None = None) -> DataFrame:
    """Attach the display columns of each hit's row, joining on the key.

    The hits are written to the shared folder first, which keeps the search from being repeated and gives them a
    measured size. Few are broadcast whole. Of more, the ids make a Bloom filter that grows with them, and only records
    that pass it leave the scan of the corpus, to be joined with the hits; Spark splits the partitions of a record that
    very many queries hit. ``max_hits`` is a proven bound on the number of hits (queries x metrics x k) that makes the
    first step unnecessary where hits hold no long strings.
    """
    shown = corpus.select("doc_id", *[c for c in DISPLAY_COLUMNS if c in corpus.columns and c not in hits.columns])
    strings = [name for name, kind in hits.dtypes if kind == "string"]
    if max_hits is not None and max_hits * HIT_BYTES <= MAX_HITS_BROADCAST_BYTES and set(strings) <= {"metric"}:
        return shown.join(F.broadcast(hits), "doc_id")
    hits = materialize(hits, "hits")
    letters = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in strings), F.lit(0))
    size = hits.agg(F.coalesce(F.sum(letters + HIT_BYTES), F.lit(0))).first()[0]
    if size <= MAX_HITS_BROADCAST_BYTES:
        return shown.join(F.broadcast(hits), "doc_id")
    ids = materialize(hits.select("doc_id").distinct(), "hit-ids")
    passed = bloom.with_possible(shown, F.col("doc_id"), ids, ids.count()).where("possible").select("row.*")
    return passed.join(hits, "doc_id")


def order_for_display(
    results: DataFrame, order: str = "best_first", always_contains: str | None = ALWAYS_CONTAINS
) -> DataFrame:
    """Add ``bucket`` and ``position`` in each list: rows of the facet, of the always-included class, others.

    Within a bucket ``best_first`` puts the nearest row first. ``score_descending`` puts the highest score
    first under both metrics, which for a distance is the worst row. Without a facet there is one bucket.
    """
    bucket = F.when(F.col("facet_used").isNull(), 0).otherwise(
        facet_bucket(F.col("facet"), F.col("facet_used"), always_contains)
    )
    within = {"best_first": nearest_first(), "score_descending": [F.col("score").desc(), F.col("doc_id").asc()]}[order]
    bucketed = results.withColumn("bucket", bucket.cast("int"))
    return rank_within(bucketed, ["query_id", "metric"], [F.col("bucket"), *within], "position")


def display_rows(results: DataFrame) -> DataFrame:
    """Hits as shown to a reader: defaults for missing fields, rendered tags and score, titled facet."""

    def shown(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit("N/A"))

    tags = render_tags(F.col("tags")) if dict(results.dtypes)["tags"].startswith("array") else F.col("tags")
    return results.select(
        "query_id", "metric", "rank", "doc_id",
        shown("name").alias("name"),
        shown("facet").alias("facet"),
        title_case(F.col("facet")).alias("facet_title"),
        shown("description").alias("description"),
        F.coalesce(tags, F.lit("")).alias("tags"),
        four_decimals("score").alias("score_text"),
    )
