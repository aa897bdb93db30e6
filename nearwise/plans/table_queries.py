"""The registered queries: every operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from nearwise.functions import tags as tag_fns, text as text_fns, vectors as vec
from nearwise.functions.romanize import romanize
from nearwise.operators import compare, extract, facets, knn, profile
from nearwise.operators.embed import embed_tfidf, embed_with, fit_terms
from nearwise.plans import search
from nearwise.session import Resources, fresh_path
from nearwise.sources import records as record_io, vector_table
from nearwise.streaming.search_stream import search_stream

K = 10
DIGITS = 6  # the SQL adds elements in another order, so these queries rank on scores rounded to six decimals
ALWAYS = "src1"  # the always-included class of the document sources


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, in at least as many tasks as there are cores.

    A small file may be one row group, which is one task however many cores there are. A table with fewer scan tasks
    than cores is spread over them by its key; a larger one is scanned in place.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores, df.columns[0]) if df.rdd.getNumPartitions() < cores else df


def first_line(text: Column) -> Column:
    """The title of a document: its first line."""
    return F.split_part(text, F.lit("\n"), F.lit(1))


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records."""
    return load(spark, sf_dir, "documents").select(
        "doc_id",
        first_line(F.col("text")).alias("name"),
        F.col("source").alias("facet"),
        F.col("text").alias("description"),
        F.array("lang", "source").alias("tags"),
    )


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as a query."""
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


def corpus_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as a corpus vector, stretched so that the two metrics rank differently."""
    stretched = vec.scale("embedding", 1 + F.col("vec_id") % 7)
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), stretched.alias("embedding"))


def facet_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus vectors with the source of the document of the same number as facet."""
    sources = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("source").alias("facet"))
    return corpus_vectors(spark, sf_dir).join(sources, "doc_id", "left")


def facet_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query vectors that ask for a facet explicitly, by naming it in their text, in both ways, or not at all."""
    n = F.col("query_id")
    explicit = (
        F.when(n % 4 == 0, facets.ALL_FACETS).when(n % 4 == 1, F.concat(F.lit("SRC"), (n * 7 % 22).cast("string")))
    )
    text = F.when(n % 3 != 2, F.concat(F.lit("loans from Src"), (n * 3 % 25).cast("string"), F.lit(" today")))
    return query_vectors(spark, sf_dir).withColumns(
        {"explicit_facet": explicit, "text": F.coalesce(text, F.lit("loans"))}
    )


def source_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of the documents, in order."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return documents.select(F.col("source").alias("value")).distinct().select(F.col("value").alias("pos"), "value")


# Sources and sinks


def corpus_mapping(spark, sf_dir):
    corpus = text_fns.add_combined_text(
        document_records(spark, sf_dir).withColumn("tags", tag_fns.render_tags(F.col("tags")))
    )
    return record_io.corpus_mapping(corpus)


def records_csv(spark, sf_dir):
    """Records written as CSV and read back: quotes, line breaks and tag lists survive."""
    path = fresh_path(spark, "records-csv")
    rows = document_records(spark, sf_dir).select("name", F.col("facet").alias("state"), "description", "tags")
    record_io.write_records_csv(rows, path)
    back = record_io.read_records_csv(spark, path)
    return back.select("name", "state", "description", tag_fns.display_tags("tags").alias("tags"))


def vectors_normalized(spark, sf_dir):
    rows = corpus_vectors(spark, sf_dir).select("doc_id", F.posexplode(vec.unit("embedding")).alias("pos", "x"))
    return rows.select("doc_id", "pos", F.round("x", 6).alias("unit_value"))


def vectors_stored(spark, sf_dir):
    """A vector table built from the rows of one label when missing, then appended to twice with all rows."""
    path = fresh_path(spark, "vectors")
    everything = facet_vectors(spark, sf_dir)
    first = load(spark, sf_dir, "embeddings").where("label = 0").select(F.col("vec_id").alias("doc_id"))
    for _ in range(2):
        vector_table.ensure_vectors(spark, path, lambda: everything.join(first, "doc_id"))
    vector_table.append_vectors(everything, path)
    vector_table.append_vectors(everything, path)
    stored = vector_table.load_vectors(spark, path)
    return stored.select("doc_id", "facet", F.size("embedding").alias("dim"), F.round("norm", 4).alias("norm"))


def vectors_partitioned(spark, sf_dir):
    """A vector table partitioned by facet, written from the rows of one label and appended to with all rows."""
    path = fresh_path(spark, "vectors-by-facet")
    everything = facet_vectors(spark, sf_dir)
    first = load(spark, sf_dir, "embeddings").where("label = 0").select(F.col("vec_id").alias("doc_id"))
    vector_table.write_vectors(everything.join(first, "doc_id"), path, partition_by_facet=True)
    vector_table.append_vectors(everything, path)
    stored = vector_table.load_vectors(spark, path)
    return stored.select("doc_id", "facet", F.size("embedding").alias("dim"), F.round("norm", 4).alias("norm"))


def vectors_stored_keyless(spark, sf_dir):
    """As ``vectors_stored``, with the keys of every tenth row missing: of rows without a key one is stored."""
    path = fresh_path(spark, "vectors")
    key = F.when(F.col("doc_id") % 10 != 3, F.col("doc_id"))
    everything = facet_vectors(spark, sf_dir).withColumn("doc_id", key)
    vector_table.write_vectors(everything.where("doc_id % 2 = 0"), path)
    for _ in range(2):
        vector_table.append_vectors(everything, path)
    return vector_table.load_vectors(spark, path).select("doc_id", F.size("embedding").alias("dim"))


def resource_shared(spark, sf_dir):
    """Vectors with their facets, stored once for two readers and removed when both are done."""
    out = fresh_path(spark, "resource-stats")
    with Resources(spark) as resources:
        for reader in range(2):
            key, stored = resources.open(facet_vectors(spark, sf_dir), "facet-vectors")
            by_facet = stored.groupBy("facet").agg(F.count("*").alias("n"), F.round(F.sum(vec.l2_norm("embedding")), 3).alias("length"))
            by_facet.withColumn("builds", F.lit(resources.built)).write.parquet(f"{out}/reader={reader}")
        for _ in range(2):
            resources.close(key)
    return spark.read.parquet(out).select("reader", "facet", "n", "length", "builds")


def pages_extract_fields(spark, sf_dir):
    return extract.page_fields(load(spark, sf_dir, "pages"))


def pages_extract_links(spark, sf_dir):
    return extract.page_links(load(spark, sf_dir, "pages"))


def card_pages(spark, sf_dir):
    """The given pages, and one card page per document with a nested card in every third."""
    docs = load(spark, sf_dir, "documents")

    def escaped(text):
        return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))

    name, text = escaped(first_line(F.col("text"))), escaped(F.col("text"))
    nested = F.when(
        F.col("doc_id") % 3 == 0, F.concat(F.lit('<div class="x group"><h2><a><span>'), F.col("lang"), F.lit("</span></a></h2></div>"))
    ).otherwise(F.lit(""))
    html = F.concat(
        F.lit('<html><body><div class="groups"><h2>no card</h2></div><div class="group flex"><h2><a href="/x"><span>'), name,
        F.lit("</span></a></h2><h2> "), F.col("source"),
        F.lit('</h2><span class="line-clamp-2"><span>'), text,
        F.lit('</span></span><div title="t"><span> '), F.col("lang"),
        F.lit("</span><br><span>"), F.col("source"), F.lit("</span></div>"), nested, F.lit("</div></body></html>"),
    )
    made = docs.select((-1 - F.col("doc_id")).alias("page_id"), html.alias("html"))
    return load(spark, sf_dir, "pages").select("page_id", "html").unionByName(made)


def cards_extract(spark, sf_dir):
    cards = extract.extract_cards(card_pages(spark, sf_dir))
    return cards.withColumn("tags", F.array_join("tags", "|"))


# Projections, filters, profiles


def corpus_preview(spark, sf_dir):
    return profile.preview(document_records(spark, sf_dir).drop("tags"))


def column_profile(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return profile.column_profile(docs.withColumn("source", F.nullif("source", F.lit("src7"))))


def vector_stats(spark, sf_dir):
    return profile.vector_stats(corpus_vectors(spark, sf_dir))


def facet_filter(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    facet = F.nullif("source", F.lit("src17"))
    rows = docs.select("doc_id", facet.alias("facet"))
    return rows.where(facets.facet_match(F.col("facet"), F.lit("SRC5"), ALWAYS))


def facet_values(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return facets.facet_options(docs.select(F.nullif("source", F.lit("src7")).alias("facet")))


def facet_detect(spark, sf_dir):
    """Nation names found in the texts of all conversations and in a sentence about each customer."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("value"))
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    sentence = F.concat(F.lit("schemes in nation_"), F.col("c_nationkey").cast("string"), F.lit(" for "), F.lower("c_mktsegment"))
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    texts = customers.select(F.col("c_custkey").cast("long").alias("query_id"), sentence.alias("text")).unionByName(
        turns.select((-1 - F.col("conv_id") * 1000 - F.col("turn")).alias("query_id"), "text")
    )
    return facets.detect_facet(texts, nations).select("query_id", "detected_facet")


def facet_detect_passages(spark, sf_dir):
    """For every document the first benchmark passage it contains; the dictionary is joined, not inlined."""
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), "text")
    passages = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("pos"), F.col("text").alias("value"))
    return facets.detect_facet(docs, passages, max_inline=0).select("query_id", "detected_facet")


def resolved_queries(spark, sf_dir):
    found = facets.detect_facet(facet_queries(spark, sf_dir), source_dictionary(spark, sf_dir))
    return facets.resolve_facet(found)


def facet_resolve(spark, sf_dir):
    return resolved_queries(spark, sf_dir).select("query_id", "explicit_facet", "detected_facet", "facet_used", "facet_origin")


def facet_title(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    label = F.concat_ws(" ", "p_name", F.lower("p_type"), F.concat(F.lit("o'"), F.col("p_name")))
    return parts.select("p_partkey", text_fns.title_case(label).alias("title"))


def query_nonblank(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    blanked = F.when(F.col("turn") % 3 == 1, F.lit(" \t\n")).when(F.col("turn") % 3 == 2, F.concat(F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    return search.nonblank(turns.select("conv_id", "turn", blanked.alias("text")))


def clean_query_text(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return docs.select("doc_id", text_fns.clean_query_text("text").alias("cleaned"))


def clean_index_text(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return docs.select("doc_id", text_fns.clean_index_text("text").alias("cleaned"))


def combined_text(spark, sf_dir):
    records = document_records(spark, sf_dir).withColumn("tags", tag_fns.render_tags(F.col("tags")))
    return text_fns.add_combined_text(records, cleaner="query").select("doc_id", "combined_text")


LATIN = "aeioukgcjtdnpbmyrlvsh"
DEVANAGARI = "ाेिोुकगचजतदनपबमयरलवसह"


def romanize_text(spark, sf_dir):
    """Document texts written with Devanagari letters, and their romanised form."""
    docs = load(spark, sf_dir, "documents")
    written = F.translate(F.lower("text"), LATIN, DEVANAGARI)
    return docs.select("doc_id", romanize(written).alias("romanized"))


def tags_parse(spark, sf_dir):
    """Link texts of every page as a list literal, parsed and rendered; every fifth literal is broken."""
    pages = load(spark, sf_dir, "pages")
    literal = tag_fns.tags_literal(F.transform(extract.link_texts(F.col("html")), lambda t: F.concat(F.lit(" "), t)))
    broken = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("no list "), literal)).otherwise(literal)
    return pages.select("page_id", tag_fns.display_tags(broken).alias("tags"))


# Nearest neighbours


def knn_l2(spark, sf_dir):
    hits = knn.knn_join(query_vectors(spark, sf_dir), corpus_vectors(spark, sf_dir), K, metrics=["l2"], digits=DIGITS)
    return hits.select("query_id", "rank", "doc_id", F.col("score").alias("d2"), F.round(F.sqrt("score"), 4).alias("distance"))


def knn_small_vectors(spark, sf_dir):
    """Vectors a thousandth as long, ranked on the exact distance; only the result is scaled and rounded."""
    short = lambda df: df.withColumn("embedding", vec.scale("embedding", F.lit(0.001)))
    hits = knn.knn_join(short(query_vectors(spark, sf_dir)), short(corpus_vectors(spark, sf_dir)), K, metrics=["l2"])
    return hits.select("query_id", "rank", "doc_id", F.round(F.col("score") * 1e6, 4).alias("d2_millionths"))


def knn_cosine(spark, sf_dir):
    hits = knn.knn_join(query_vectors(spark, sf_dir), corpus_vectors(spark, sf_dir), K, metrics=["cosine"], digits=DIGITS)
    return hits.select("query_id", "rank", "doc_id", F.col("score").alias("similarity"))


def knn_l2_block(spark, sf_dir):
    """As ``knn_l2``, with the queries cut into blocks that are answered one after the other."""
    hits = knn.knn_join(
        query_vectors(spark, sf_dir), corpus_vectors(spark, sf_dir), K, metrics=["l2"], digits=DIGITS, strategy="grid",
        max_query_bytes=1 << 20,
    )
    return hits.select("query_id", "rank", "doc_id", F.col("score").alias("d2"))


def knn_single(spark, sf_dir):
    """The rows nearest to the centre of all vectors."""
    vectors = corpus_vectors(spark, sf_dir)
    means = vectors.select(F.posexplode("embedding").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("x"))
    centre = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("v"))
    return knn.single_query(centre.first()["v"], vectors, K, digits=DIGITS)


def both_metrics(spark, sf_dir):
    return knn.knn_join(query_vectors(spark, sf_dir), corpus_vectors(spark, sf_dir), K, digits=DIGITS)


def named_hits(spark, sf_dir):
    return search.materialize_hits(both_metrics(spark, sf_dir), document_records(spark, sf_dir))


def knn_materialize(spark, sf_dir):
    return named_hits(spark, sf_dir).select("query_id", "metric", "rank", "doc_id", "score", "name", "facet", "description")


def display_rows(spark, sf_dir):
    return search.display_rows(named_hits(spark, sf_dir).withColumn("facet", F.nullif("facet", F.lit("src7"))))


# Filtered retrieval


def search_filtered(spark, sf_dir):
    return search.search_compare(
        resolved_queries(spark, sf_dir), facet_vectors(spark, sf_dir), k=K, always_contains=ALWAYS, digits=DIGITS
    )


def search_fallback(spark, sf_dir):
    """A third of the queries asks for a facet no row has; with no spare candidates others fall back too."""
    n = F.col("query_id")
    used = F.when(n % 3 == 0, F.lit("src99")).when(n % 3 == 1, F.concat(F.lit("src"), (n % 20).cast("string")))
    queries = query_vectors(spark, sf_dir).withColumn("facet_used", used)
    return search.search_compare(queries, facet_vectors(spark, sf_dir), k=K, overfetch=1, always_contains=None, digits=DIGITS)


def partitioned_vectors(spark, sf_dir):
    """The facet vectors, stored in double precision and partitioned by facet."""
    path, rows = fresh_path(spark, "vectors-by-facet"), facet_vectors(spark, sf_dir)
    rows.write.partitionBy("facet").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def search_prefilter(spark, sf_dir):
    return search.search_compare(
        resolved_queries(spark, sf_dir), partitioned_vectors(spark, sf_dir), k=K, mode="prefilter", always_contains=None, digits=DIGITS
    )


def search_prefilter_fallback(spark, sf_dir):
    """Prefiltered: a third of the queries asks for a facet no row has, a third for one by its name in capitals."""
    n = F.col("query_id")
    used = F.when(n % 3 == 0, F.lit("src99")).when(n % 3 == 1, F.concat(F.lit("SRC"), (n % 20).cast("string")))
    queries = query_vectors(spark, sf_dir).withColumn("facet_used", used)
    return search.search_compare(
        queries, partitioned_vectors(spark, sf_dir), k=K, mode="prefilter", always_contains=ALWAYS, digits=DIGITS
    )


def search_bucketed(spark, sf_dir):
    results = search.order_for_display(search_filtered(spark, sf_dir), always_contains=ALWAYS)
    return results.select("query_id", "metric", "position", "bucket", "doc_id", "score")


def search_order_reference(spark, sf_dir):
    results = search.order_for_display(search_filtered(spark, sf_dir), "score_descending", ALWAYS)
    return results.select("query_id", "metric", "position", "bucket", "doc_id", "score")


# Comparison


def compare_metrics(spark, sf_dir):
    found = compare.compare_metrics(both_metrics(spark, sf_dir), K, query_vectors(spark, sf_dir))
    lists = {name: F.array_join(F.col(name).cast("array<string>"), ",") for name in ("l2_ids", "cosine_ids", "common_ids")}
    return found.withColumns(lists)


def compare_aligned(spark, sf_dir):
    return compare.compare_aligned(both_metrics(spark, sf_dir))


def compare_names(spark, sf_dir):
    found = compare.compare_names(named_hits(spark, sf_dir), query_vectors(spark, sf_dir))
    return found.withColumn("common_names", F.array_join("common_names", "|"))


# Text retrieval


def text_corpus(spark, sf_dir, cleaner):
    """Terms and vectors of all documents."""
    return search.build_corpus(document_records(spark, sf_dir), cleaner)


def text_queries(spark, sf_dir):
    """Every benchmark passage as a query that also names a source."""
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    named = F.concat(F.col("text"), F.lit(" src"), (F.col("item_id") % 23).cast("string"))
    return rows.select(F.col("item_id").alias("query_id"), named.alias("text"))


def embed_documents(spark, sf_dir):
    weights = text_corpus(spark, sf_dir, "index").vectors.select("doc_id", F.posexplode("embedding").alias("bucket", "weight"))
    return weights.where(F.col("weight") != 0).select("doc_id", "bucket", F.round(F.col("weight").cast("double"), 4).alias("weight"))


def embed_rare_terms(spark, sf_dir):
    """The same vectors when only the most common terms are broadcast."""
    corpus = text_fns.add_combined_text(
        document_records(spark, sf_dir).withColumn("tags", tag_fns.render_tags(F.col("tags")))
    )
    vectors = embed_tfidf(corpus, fit_terms(corpus), max_broadcast_terms=500)
    weights = vectors.select("doc_id", F.posexplode("embedding").alias("bucket", "weight"))
    return weights.where(F.col("weight") != 0).select("doc_id", "bucket", F.round(F.col("weight").cast("double"), 4).alias("weight"))


def embed_encoder(spark, sf_dir):
    """Vectors from a plugged-in batch encoder: here one that counts letters."""

    def load_encoder():
        import numpy as np

        def count(texts):
            raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
            owner = np.repeat(np.arange(len(raw)), [len(x) for x in raw])
            return np.bincount(owner * 256 + np.concatenate(raw), minlength=256 * len(raw)).reshape(-1, 256)[:, 97:123]

        return count

    docs = load(spark, sf_dir, "documents").select("doc_id", text_fns.clean_query_text("text").alias("combined_text"))
    rows = embed_with(docs, load_encoder).select("doc_id", F.posexplode("embedding").alias("pos", "n"))
    return rows.select("doc_id", "pos", F.col("n").cast("double").alias("n"))


def search_text_l2(spark, sf_dir):
    return search.search_text(text_queries(spark, sf_dir), text_corpus(spark, sf_dir, "index"), k=K, digits=DIGITS)


def search_text_compare(spark, sf_dir):
    """The whole search: detect a facet in the text, clean, embed, rank under both metrics, filter, order, show."""
    tables = text_corpus(spark, sf_dir, "query")
    queries = facets.detect_facet(text_queries(spark, sf_dir), source_dictionary(spark, sf_dir))
    queries = facets.resolve_facet(queries.withColumn("explicit_facet", F.lit(facets.ALL_FACETS)))
    embedded = search.embed_queries(search.nonblank(queries), tables)
    found = search.search_compare(
        queries.select("query_id", "facet_used").join(embedded, "query_id"),
        tables.vectors,
        k=K, always_contains=ALWAYS, digits=DIGITS,
    )
    ordered = search.order_for_display(found, always_contains=ALWAYS)
    shown = search.materialize_hits(ordered, document_records(spark, sf_dir))
    return shown.select(
        "query_id", "metric", "position", "bucket", "rank", "doc_id", "score", "name", "facet", "facet_used", "fallback_used"
    )


def search_text_stored(spark, sf_dir):
    """Text search over stored tables: built when missing, opened again, searched by cosine."""
    base, records = fresh_path(spark, "search-tables"), document_records(spark, sf_dir)
    search.ensure_search_tables(records, base)
    stored = search.ensure_search_tables(records, base)
    hits = search.search_text(text_queries(spark, sf_dir), stored, k=K, metric="cosine", digits=DIGITS)
    shown = search.materialize_hits(hits, stored.corpus)
    return shown.select("query_id", "rank", "doc_id", F.col("score").alias("similarity"), "name", "facet")


def stream_search(spark, sf_dir):
    """All embeddings arriving as a stream of queries, answered batch by batch."""
    corpus = corpus_vectors(spark, sf_dir)
    schema = spark.read.parquet(f"{sf_dir}/embeddings.parquet").schema
    arriving = spark.readStream.schema(schema).parquet(f"{sf_dir}/[e]mbeddings.parquet")  # a pattern may be a single file too
    out = fresh_path(spark, "stream-hits")
    stream = search_stream(
        arriving.select(F.col("vec_id").alias("query_id"), "embedding"),
        lambda batch: knn.knn_join(batch, corpus, K, metrics=["l2"], digits=DIGITS),
        out,
        fresh_path(spark, "stream-checkpoint"),
        availableNow=True,
    )
    stream.awaitTermination()
    return spark.read.parquet(out).select("query_id", "rank", "doc_id", F.col("score").alias("d2"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "knn_l2": knn_l2,
    "knn_cosine": knn_cosine,
    "knn_small_vectors": knn_small_vectors,
    "knn_l2_block": knn_l2_block,
    "knn_single": knn_single,
    "knn_materialize": knn_materialize,
    "display_rows": display_rows,
    "vectors_normalized": vectors_normalized,
    "vectors_stored": vectors_stored,
    "vectors_partitioned": vectors_partitioned,
    "vectors_stored_keyless": vectors_stored_keyless,
    "resource_shared": resource_shared,
    "vector_stats": vector_stats,
    "corpus_mapping": corpus_mapping,
    "corpus_preview": corpus_preview,
    "column_profile": column_profile,
    "records_csv": records_csv,
    "pages_extract_fields": pages_extract_fields,
    "pages_extract_links": pages_extract_links,
    "cards_extract": cards_extract,
    "clean_query_text": clean_query_text,
    "clean_index_text": clean_index_text,
    "combined_text": combined_text,
    "romanize": romanize_text,
    "tags_parse": tags_parse,
    "query_nonblank": query_nonblank,
    "facet_filter": facet_filter,
    "facet_values": facet_values,
    "facet_detect": facet_detect,
    "facet_detect_passages": facet_detect_passages,
    "facet_resolve": facet_resolve,
    "facet_title": facet_title,
    "search_filtered": search_filtered,
    "search_fallback": search_fallback,
    "search_prefilter": search_prefilter,
    "search_prefilter_fallback": search_prefilter_fallback,
    "search_bucketed": search_bucketed,
    "search_order_reference": search_order_reference,
    "compare_metrics": compare_metrics,
    "compare_aligned": compare_aligned,
    "compare_names": compare_names,
    "embed_tfidf": embed_documents,
    "embed_tfidf_rare_terms": embed_rare_terms,
    "embed_encoder": embed_encoder,
    "search_text_l2": search_text_l2,
    "search_text_compare": search_text_compare,
    "search_text_stored": search_text_stored,
    "stream_search": stream_search,
}
