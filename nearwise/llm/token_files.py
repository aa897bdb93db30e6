"""Token-id files: every text as ids of a public tokenizer, packed, in ascending order of document, and read back."""

from __future__ import annotations

import re
import sys
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from nearwise.llm import frames, words as w
from nearwise.llm.chunks import ChunkMemo

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
#: Ids after which a segment ends. A document is never split, so a longer one is a segment of its own.
SEGMENT_IDS = 1 << 20

#: Bytes of text that one task packs, about.
RANGE_BYTES = 64 << 20
#: Bytes of text that are encoded at a time: the more, the fewer words are looked up again.
SLICE_BYTES = 8 << 20
#: Distinct words, and parts of words not met before, that a worker remembers; some 200 bytes each.
MEMO_WORDS, MEMO_PIECES = 800_000, 400_000
#: Starts of segments that may be broadcast (some 40 bytes each); more are joined by shuffle.
BROADCAST_STARTS = 1_000_000

SEGMENT = "part int, seq int, n_docs long, n_ids long, doc_ids array<long>, lengths array<long>, ids binary"

#: One pre-token each in the tokenizer's pattern, in which letters, digits and other signs never share one; or the line
#: feed between two words. Its contractions begin with an apostrophe, and Latin-1 letters are NFC.
PIECES = re.compile(r"[a-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+|\n")
SIMPLE_ASCII = np.array([chr(i) not in "'\x7f" and i > 0x20 or i == 0x0A for i in range(128)] + [False] * 128)
SIMPLE_AFTER_C3 = np.array([0x80 <= i <= 0xBF and i not in (0x97, 0xB7) for i in range(256)])
JOINED = 1000


class WordEncoder:
    """Ids of texts, equal to what the library gives for each whole text.

    The tokenizer drops white space and never merges across it, so each word can be encoded by itself; upper-case ASCII
    is the same to it as lower-case. Words of Latin letters, digits and signs are cut further into the pre-tokens that
    its pattern would make, of which many are given to the library at once, joined by spaces: each ends with the one
    end-of-word token. Words of any other make-up, and texts that spell a special token, go to the library as they are.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words = ChunkMemo(self._encode_words, silent=[b""], limit=MEMO_WORDS)
        self.pieces = ChunkMemo(self._encode_pieces, silent=["\n"], limit=MEMO_PIECES)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each text; a null is an empty text."""
        data, bounds = w.flat(texts)
        raw, cuts, odd = data.tobytes(), bounds.tolist(), {}
        texts = texts.fill_null("")
        if special := [s for s in self.special if s in raw]:
            for i in range(len(texts)):
                text = raw[cuts[i] : cuts[i + 1]]
                if any(s in text for s in special):
                    odd[i] = self.tokenizer.encode(text.decode(), add_special_tokens=False).ids
            spelled = pa.array(np.isin(np.arange(len(texts)), list(odd)))
            texts = pc.if_else(spelled, "", texts)
        # Arrow cuts the words and numbers the distinct ones, so that only those are looked up one by one.
        found = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        counts = found.value_lengths().to_numpy()
        coded = found.flatten().cast(pa.binary()).dictionary_encode()
        data, bounds = w.flat(coded.dictionary)
        raw, cuts = data.tobytes(), bounds.tolist()
        places = self.words.look_up([raw[a:b] for a, b in zip(cuts, cuts[1:])])
        ids, per_chunk = self.words.tokens(places[coded.indices.to_numpy()])
        ends = np.concatenate([[0], np.cumsum(per_chunk)])[np.concatenate([[0], np.cumsum(counts)])]
        lengths = np.diff(ends)
        if odd:
            pieces = [odd.get(i, ids[ends[i] : ends[i + 1]]) for i in range(len(texts))]
            lengths = np.array([len(p) for p in pieces], np.int64)
            ids = np.concatenate([np.asarray(p, np.int32) for p in pieces])
        return ids, lengths

    def _encode_words(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"\n".join(chunks) + b"\n", np.uint8)
        simple = SIMPLE_ASCII[raw]
        pair = np.flatnonzero((raw[:-1] == 0xC3) & SIMPLE_AFTER_C3[raw[1:]])
        simple[pair] = simple[pair + 1] = True
        ends = np.flatnonzero(raw == 0x0A)
        plain = np.ones(len(chunks), bool)
        plain[np.searchsorted(ends, np.flatnonzero(~simple))] = False
        lines = [chunks[i] for i in np.flatnonzero(plain).tolist()]
        places = self.pieces.look_up(PIECES.findall((b"\n".join(lines) + b"\n" * bool(lines)).decode()))
        ids, per_piece = self.pieces.tokens(places)
        upto = np.concatenate([[0], np.cumsum(per_piece)[places == 0]])
        counts = np.zeros(len(chunks), np.int64)
        counts[plain] = np.diff(upto)
        rest = np.flatnonzero(~plain).tolist()
        if not rest:
            return ids, counts
        found = [x.ids for x in self.tokenizer.encode_batch_fast([chunks[i].decode() for i in rest], add_special_tokens=False)]
        counts[rest] = [len(x) for x in found]
        out, is_plain = np.zeros(int(counts.sum()), np.int32), np.repeat(plain, counts)
        out[is_plain] = ids
        out[~is_plain] = [i for x in found for i in x]
        return out, counts

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lines = [" ".join(pieces[i : i + JOINED]) for i in range(0, len(pieces), JOINED)]
        found = self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)
        ids = np.concatenate([np.array(x.ids, np.int32) for x in found])
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(pieces):
            raise ValueError("the tokenizer's pattern is not the one this encoder was written for")
        return ids, np.diff(ends, prepend=0)


def _tokenizer(path: str) -> WordEncoder:
    return w.per_process(("words", path), lambda: WordEncoder(path))


def write_token_files(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> None:
    """Write the ids of every text to ``path``, in ascending order of ``doc_id``.

    Each text (a null counts as empty) is encoded without special tokens and ends with ``end_id``. The documents are
    range-partitioned by id before they are encoded, so that only texts are shuffled and each task writes one run of
    consecutive documents; rows of one id are ordered by hash and text, and may share several tasks. Null ids come
    first. Other columns than ``doc_id`` and ``text`` are not read.

    The files are Parquet tables of segments; each row holds the directory of its documents (ids and lengths) and one
    packed segment with its own index of block starts (see ``frames``). A task failing and running again replaces its
    file.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    ordered = rows.repartitionByRange(ranges, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    ordered.select("doc_id", "text").mapInArrow(_packer(tokenizer, end_id), SEGMENT).write.parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments of the files at ``path``, each with ``start``, the number of ids in all segments before it.

    The starts are summed up from the segments' numbers of ids, one row for each written file, and broadcast while they are
    few, so that the segments themselves are decoded where they lie.
    """
    segments = spark.read.schema(SEGMENT).parquet(path)
    order = segments.select("part", "seq", "n_ids")
    parts = order.groupBy("part").agg(F.sum("n_ids").alias("n"), F.collect_list(F.struct("seq", "n_ids")).alias("segments"))
    sums = [(r.part, r.n) for r in parts.select("part", "n").toLocalIterator()]  # one row for each file
    bases, before = [], 0
    for part, n in sorted(sums):
        bases.append((part, before))
        before += n
    table = spark.createDataFrame(bases, "part int, base long")
    inner = F.aggregate(
        F.filter("segments", lambda s: s.seq < F.col("at.seq")), F.lit(0).cast("long"), lambda n, s: n + s.n_ids
    )
    starts = parts.join(table, "part").withColumn("at", F.explode("segments"))
    starts = starts.select("part", F.col("at.seq").alias("seq"), (F.col("base") + inner).alias("start"))
    few = order.count() <= BROADCAST_STARTS
    return segments.join(F.broadcast(starts) if few else starts, ["part", "seq"])


def documents(segments: DataFrame) -> DataFrame:
    """Decode segments: ``doc_id``, ``start`` (ids of all documents before it) and the document's ``ids``."""
    return segments.select("start", "doc_ids", "lengths", "ids").mapInArrow(_reader(False), "doc_id long, start long, ids array<long>")


def summaries(segments: DataFrame) -> DataFrame:
    """Decode segments: ``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of the ids as unsigned 32-bit numbers."""
    return segments.select("start", "doc_ids", "lengths", "ids").mapInArrow(
        _reader(True), "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def _packer(path: str, end_id: int):
    def pack(batches):
        encoder, part, seq = _tokenizer(path), TaskContext.get().partitionId(), 0
        docs: list = []
        lengths: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = 0

        def segment():
            n, flat = np.concatenate(lengths), np.concatenate(ids)
            row = {"part": part, "seq": seq, "n_docs": len(n), "n_ids": len(flat), "doc_ids": docs, "lengths": n.tolist(), "ids": frames.pack(flat)}
            return pa.RecordBatch.from_pylist([row], _SEGMENT_TYPE)

        for batch in w.slices(batches, size=SLICE_BYTES):
            flat, n = encoder.encode(batch.column("text"))
            ends = np.cumsum(n)
            flat = np.insert(flat, ends, end_id)
            docs += batch.column("doc_id").to_pylist()
            lengths.append(n + 1)
            ids.append(flat)
            held += len(flat)
            if held >= SEGMENT_IDS:
                yield segment()
                docs, lengths, ids, held, seq = [], [], [], 0, seq + 1
        if docs:
            yield segment()
        w.release()

    return pack


def _reader(summed: bool):
    def read(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                docs = one.column("doc_ids").flatten()
                lengths = one.column("lengths").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                ids = frames.unpack(one.column("ids")[0].as_py()).astype("<u4")
                ends = np.cumsum(lengths)
                starts = pa.array(one.column("start")[0].as_py() + ends - lengths, pa.int64())
                if summed:
                    raw = memoryview(ids.tobytes())
                    sums = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [docs, starts, pa.array(lengths), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
                    )
                else:
                    lists = w.as_lists(pa.array(ids.astype(np.int64)), np.concatenate([[0], ends]))
                    yield pa.RecordBatch.from_arrays([docs, starts, lists], ["doc_id", "start", "ids"])

    return read


_SEGMENT_TYPE = pa.schema([
    ("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("ids", pa.binary()),
])

cloudpickle.register_pickle_by_value(sys.modules[__name__])
