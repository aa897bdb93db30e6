"""Turning texts into vectors: a hashed TF-IDF job, and a hook for any batch encoder."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

from nearwise.functions.text import tokens
from nearwise.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIM = 256
MAX_BROADCAST_TERMS = 1_000_000  # terms a task may hold, and their letters in bytes
MAX_BROADCAST_BYTES = 32 << 20


def fit_terms(docs: DataFrame, text: str = "combined_text", dim: int = DIM) -> DataFrame:
    """The vocabulary of a corpus as a table ``(term, df, idf, bucket)``, written to the shared folder.

    Every document counts a term once, so the map side already reduces a task's documents to one row per
    term before the only shuffle.
    """
    n_docs = docs.count()
    words = docs.select(F.explode(F.array_distinct(tokens(text))).alias("term"))
    terms = words.groupBy("term").agg(F.count("*").alias("df"))
    bucket = F.conv(F.substring(F.md5("term"), 1, 8), 16, 10).cast("long") % dim
    return materialize(
        terms.select(
            "term",
            "df",
            (F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf"),
            bucket.cast("int").alias("bucket"),
        ),
        "terms",
    )


def embed_tfidf(
    docs: DataFrame,
    terms: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "combined_text",
    dim: int = DIM,
    carry: Sequence[str] = (),
    max_broadcast_terms: int = MAX_BROADCAST_TERMS,
) -> DataFrame:
    """One dense vector per text: each term adds its share of the text times its idf to its bucket.

    Terms that are not in ``terms`` add nothing; a text without known terms gets a zero vector, and a null
    text an empty one's. Documents and queries must use the same ``terms`` and ``dim``. The columns of ``carry``
    are handed through.

    A vocabulary of checked size is broadcast and texts are encoded where they lie, without a shuffle. Of a
    larger one only the most common terms are broadcast, at most ``max_broadcast_terms`` and as many as a measured
    number of bytes holds. Their part of each text is encoded in place; of the other words only their counts in each text
    leave it, to be joined with the rest of the vocabulary. What is shuffled are weights of the buckets that a text fills,
    never a text or a whole vector. Each row is carried through under a
    number of its own, so keys may be null or repeat.
    """
    lookup = terms.select("term", "idf", "bucket")
    n_terms, term_bytes, top = terms.agg(
        F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0)), F.coalesce(F.max("bucket"), F.lit(0))
    ).first()
    if top >= dim:
        raise ValueError(f"the terms were fitted with more than {dim} buckets")
    source = docs.select(key, text, *carry)
    if n_terms <= max_broadcast_terms and term_bytes <= MAX_BROADCAST_BYTES:
        return _encode_in_place(source, lookup.toArrow(), dim)
    n_hot = max_broadcast_terms
    while True:
        threshold = terms.agg(F.percentile_approx("df", max(0.0, 1 - n_hot / n_terms), 1_000_000)).first()[0]
        hot = terms.where(F.col("df") > threshold)
        count, size = hot.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
        if count <= max_broadcast_terms and size <= MAX_BROADCAST_BYTES:
            break
        n_hot //= 2
    partial = _encode_in_place(source, hot.select("term", "idf", "bucket").toArrow(), dim, split=True)
    partial = materialize(partial.withColumn("row number", F.monotonically_increasing_id()), "partly-encoded")
    rare = partial.select("row number", "n words", F.explode("rare words").alias("w")).select("row number", "n words", "w.term", "w.n")
    weight = (F.col("n") * F.col("idf") / F.col("n words")).alias("weight")
    rare = rare.join(terms.where(F.col("df") <= threshold).select("term", "idf", "bucket"), "term")
    rare = rare.select("row number", F.struct("bucket", weight).alias("part")).groupBy("row number")
    both = partial.drop("rare words", "n words").join(rare.agg(F.collect_list("part").alias("parts")), "row number", "left")
    added = [f for f in both.drop("row number", "parts", "common").schema]
    schema = T.StructType([*added, T.StructField("embedding", T.ArrayType(T.FloatType()))])
    return both.drop("row number").mapInArrow(_adder(dim), schema)


def _adder(dim: int):
    """Add the rare words' weights to the common ones'."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.zeros((batch.num_rows, dim))
            for parts in (batch.column("common"), batch.column("parts")):
                owner, flat = pc.list_parent_indices(parts).to_numpy(), parts.flatten()
                np.add.at(sums, (owner, flat.field("bucket").to_numpy()), flat.field("weight").to_numpy())
            yield batch.drop_columns(["common", "parts"]).append_column("embedding", _lists(sums.astype(np.float32)))

    return add


def _encode_in_place(texts: DataFrame, vocabulary: pa.Table, dim: int, split: bool = False) -> DataFrame:
    """Look up each batch's distinct words and add up their weights, text by text.

    With ``split`` the sums stay in double and come as ``common``, those that are not zero with their buckets; ``n words``
    and the counts of words outside the vocabulary are added.
    """
    vocabulary = vocabulary.combine_chunks()
    shared = texts.sparkSession.sparkContext.broadcast(
        (_single(vocabulary.column(0)), vocabulary.column(1).to_numpy(), vocabulary.column(2).to_numpy())
    )

    name = uuid.uuid4().hex

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, idf, bucket = _kept(name, lambda: _vocabulary(*shared.value))
        for batch in batches:
            n = batch.num_rows
            words = pc.split_pattern(pc.fill_null(batch.column(1), ""), " ")
            owner = pc.list_parent_indices(words).to_numpy().astype(np.int64)
            coded = words.flatten().dictionary_encode()
            names, code = coded.dictionary, coded.indices.to_numpy()
            place = np.array([known.get(name, len(known)) for name in names.to_pylist()], np.int64)
            filled = (pc.binary_length(names).to_numpy() > 0)[code]
            at = place[code]
            n_words = np.maximum(np.bincount(owner[filled], minlength=n), 1)
            sums = np.bincount(owner * dim + bucket[at], weights=idf[at], minlength=n * dim).reshape(n, dim)
            sums /= n_words[:, None]
            batch = batch.drop_columns([text])
            if not split:
                yield batch.append_column("embedding", _lists(sums.astype(np.float32)))
                continue
            outside = filled & (at == len(known))
            pairs, times = np.unique(owner[outside] * len(names) + code[outside], return_counts=True)
            entries = pa.StructArray.from_arrays([names.take(pa.array(pairs % len(names))), pa.array(times, pa.int64())], ["term", "n"])
            bounds = np.searchsorted(pairs // len(names), np.arange(n + 1)).astype(np.int32)
            filled_at = np.flatnonzero(sums)
            weights = pa.StructArray.from_arrays([pa.array(filled_at % dim, pa.int32()), pa.array(sums.ravel()[filled_at])], ["bucket", "weight"])
            ends = np.searchsorted(filled_at, np.arange(n + 1) * dim).astype(np.int32)
            batch = batch.append_column("common", pa.ListArray.from_arrays(pa.array(ends), weights))
            batch = batch.append_column("n words", pa.array(n_words, pa.int64()))
            yield batch.append_column("rare words", pa.ListArray.from_arrays(pa.array(bounds), entries))

    text = texts.columns[1]
    kept = [f for f in texts.schema if f.name != text]
    if split:
        weight = T.StructType().add("bucket", T.IntegerType()).add("weight", T.DoubleType())
        entry = T.StructType().add("term", "string").add("n", "long")
        kept += [T.StructField("common", T.ArrayType(weight)), T.StructField("n words", T.LongType())]
        kept.append(T.StructField("rare words", T.ArrayType(entry)))
    else:
        kept.append(T.StructField("embedding", T.ArrayType(T.FloatType())))
    return texts.mapInArrow(encode, T.StructType(kept))


def _vocabulary(terms: pa.Array, idf: np.ndarray, bucket: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
    """The place of each term, and what lies there; the last entry stands for unknown words."""
    return {term: place for place, term in enumerate(terms.to_pylist())}, np.append(idf, 0.0), np.append(bucket, 0)


def _kept(name: str, make: Callable[[], object]) -> object:
    """What a worker made for an earlier task of the same name, or makes now; it keeps one such thing at a time."""
    held = vars(sys).setdefault("_nearwise_vocabulary", {})
    if name not in held:
        held.clear()
        held[name] = make()
    return held[name]


def _single(column: pa.ChunkedArray) -> pa.Array:
    chunks = column.combine_chunks()
    return chunks if isinstance(chunks, pa.Array) else pa.concat_arrays(chunks.chunks)


def _lists(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as an Arrow list array."""
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).reshape(-1)))


def embed_with(
    docs: DataFrame,
    load_encoder: Callable[[], Callable[[list[str]], np.ndarray]],
    *,
    key: str = "doc_id",
    text: str = "combined_text",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Vectors from any batch encoder.

    ``load_encoder`` runs once per task and returns a function from a list of texts to a float matrix;
    texts reach it in Arrow batches. Null texts are encoded as the empty string.
    """
    source = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias(text), *carry)
    kept = ", ".join(f"{name} {kind}" for name, kind in source.dtypes if name != text)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or load_encoder()
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            matrix = np.asarray(encoder(texts), dtype=np.float32)
            yield batch.drop_columns([text]).append_column("embedding", _lists(matrix))

    return source.mapInArrow(encode, f"{kept}, embedding array<float>")
