"""SentencePiece encoding with the byte span of every piece in the original text, and decoding."""

import hashlib
import re
import struct
import sys
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType
from sentencepiece import sentencepiece_model_pb2

from nearwise.llm import words as w
from nearwise.llm.chunks import ChunkMemo

MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: Distinct chunks a worker remembers, some 200 bytes each.
MEMO_CHUNKS = 150_000
SPACE = "▁".encode()
#: A chunk is a run of spaces with what follows it, or a line feed with what follows it.
CHUNK = re.compile(rb" *[^ \n]+| +|\n[^ \n]*")
NORMAL, UNKNOWN, BYTE = 1, 2, 6


class CharacterMap:
    """The compiled character map of a model: a double-array trie of source strings and their replacements.

    The format is public: the trie's size, its 32-bit units, then zero-ended replacement strings. An empty map leaves
    every character as it is.
    """

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist() if compiled else []
        self.strings = compiled[4 + size :] if compiled else b""

    def longest(self, text: bytes, at: int) -> "tuple[int, bytes] | None":
        """The longest source string that ``text`` has at ``at``: its length and its replacement."""
        units, found, node = self.units, None, 0
        if not units:
            return None
        node ^= _offset(units[0])
        for end in range(at, len(text)):
            node ^= text[end]
            unit = units[node]
            if unit & 0x800000FF != text[end]:
                break
            node ^= _offset(unit)
            if unit >> 8 & 1:
                found = end + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.strings[found[1] : self.strings.index(b"\0", found[1])]


def _offset(unit: int) -> int:
    return unit >> 10 << ((unit & 1 << 9) >> 6)


class Normalizer:
    """A model's normalisation of a text, with the source position of every normalised byte.

    At each position the longest string of the character map is replaced; without one a character stays. Then spaces
    are trimmed and merged, a leading space is added and spaces are escaped, each only if the model says so.
    """

    def __init__(self, spec):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.trim, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        #: Whether the only changes are the leading space and the escaping of spaces.
        self.plain = not self.map.units and not self.trim and self.escape and self.prefix

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes and, for each of them and for the end, its position in ``text``."""
        pieces, at = [], 0
        while at < len(text):
            found = self.map.longest(text, at)
            if found is None:
                size = _character(text[at])
                found = size, text[at : at + size]
            pieces.append((found[1], at))
            at += found[0]
        end = len(text)
        if self.trim:
            while pieces and not pieces[0][0].strip(b" "):
                pieces.pop(0)
            while pieces and not pieces[-1][0].strip(b" "):
                end = pieces.pop()[1]
        space = SPACE if self.escape else b" "
        out, source = bytearray(), []
        if self.prefix and pieces:
            out += space
            source += [pieces[0][1]] * len(space)
        after_space = self.trim
        for new, start in pieces:
            if self.trim and after_space:
                new = new.lstrip(b" ")
            if not new:
                continue
            after_space = new.endswith(b" ")
            if self.escape:
                new = new.replace(b" ", space)
            out += new
            source += [start] * len(new)
        if self.trim:
            while out.endswith(space):
                del out[-len(space) :]
                end = source[-len(space)]
                del source[-len(space) :]
        return bytes(out), np.array([*source, end], np.int64)


def _character(lead: int) -> int:
    return 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


class PieceEncoder:
    """Ids, as the library gives them for whole texts, and the source span of each.

    No piece of the vocabulary holds a space or line feed after another character, so no merge crosses the start of a
    chunk, and each chunk can be encoded by itself. That property is checked; a model without it, or with another
    normalisation, is encoded text by text.
    """

    def __init__(self, path: str):
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.normalize = Normalizer(proto.normalizer_spec)
        kinds = [p.type for p in proto.pieces]
        if not proto.trainer_spec.byte_fallback:
            raise ValueError("spans need a model with byte fallback")
        spelled = [p.piece.encode() for p in proto.pieces]
        #: Normalised bytes of each piece; a byte piece is one byte.
        self.sizes = np.array([1 if k == BYTE else len(s) for s, k in zip(spelled, kinds)], np.int64)
        #: Source bytes of each piece where a space is one byte, as it is in a plainly normalised text.
        self.source_sizes = np.array([1 if k == BYTE else len(s.replace(SPACE, b" ")) for s, k in zip(spelled, kinds)], np.int64)
        inner = re.compile(rb"[^\n]\n|(?<!^)(?<!" + SPACE + rb")" + SPACE)
        apart = not any(inner.search(s) or s.count(b"\n") for s, k in zip(spelled, kinds) if k != BYTE)
        self.by_chunk = self.normalize.plain and apart and not any(k == 4 for k in kinds)
        self.chunks = ChunkMemo(self._encode_chunks, limit=MEMO_CHUNKS)
        self.line_feed = len(self.model.encode("\n")) - 1

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all texts in a row: ids, number of ids of each text, first and end source byte of each id.

        A null is an empty text. The leading space that normalisation adds has no source bytes: a piece that begins with
        it starts at the first byte of the text.
        """
        data, bounds = w.flat(texts)
        raw, cuts, n = data.tobytes(), bounds.tolist(), len(texts)
        chunks, counts, odd = [], np.zeros(n, np.int64), {}
        literal = SPACE in raw
        for i in range(n):
            text = raw[cuts[i] : cuts[i + 1]]
            if not text:
                continue
            if not self.by_chunk or literal and SPACE in text:
                odd[i] = self._encode_text(text)
            else:
                found = CHUNK.findall(b" " + text)
                counts[i] = len(found)
                chunks += found
        ids, per_chunk = self.chunks.tokens(self.chunks.look_up(chunks))
        ends = np.concatenate([[0], np.cumsum(per_chunk)])[np.concatenate([[0], np.cumsum(counts)])]
        lengths = np.diff(ends)
        upto = np.concatenate([[0], np.cumsum(self.source_sizes[ids])])
        base = np.repeat(upto[ends[:-1]] + 1, lengths)  # one source byte less: the leading space
        first, last = np.maximum(upto[:-1] - base, 0), upto[1:] - base
        if not odd:
            return ids, lengths, first, last
        parts = [odd.get(i) or (ids[a:b], first[a:b], last[a:b]) for i, (a, b) in enumerate(zip(ends[:-1], ends[1:]))]
        lengths = np.array([len(p[0]) for p in parts], np.int64)
        ids, first, last = (np.concatenate([p[k] for p in parts]) for k in range(3))
        return ids, lengths, first, last

    def _encode_text(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One text as a whole, its spans through the normaliser's alignment."""
        ids = np.array(self.model.encode(text.decode()), np.int32)
        normal, source = self.normalize(text)
        ends = np.cumsum(self.sizes[ids])
        if len(ids) and ends[-1] != len(normal):
            raise ValueError("the pieces do not spell the normalised text")
        starts = ends - self.sizes[ids]
        # a piece ends where the source of the next other character begins
        last = source[ends]
        inside = np.flatnonzero((last <= source[starts]) & (ends < len(normal)))
        for i in inside.tolist():
            last[i] = source[np.searchsorted(source, source[starts[i]], "right")] if self.sizes[ids[i]] == 1 else last[i]
        return ids, source[starts], np.maximum(last, source[starts])

    def _encode_chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        # The library adds the leading space itself; before a line feed that space is a piece of its own.
        spelled = [c.decode() if c[:1] == b"\n" else c[1:].decode() for c in chunks]
        found = self.model.encode(spelled, num_threads=1)
        found = [ids[1:] if c[:1] == b"\n" else ids for c, ids in zip(chunks, found)]
        lone = self.model.piece_to_id(SPACE.decode())
        found = [ids if ids else [lone] for ids in found]  # a lone space: the library gives nothing for an empty text
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.int32, int(counts.sum())), counts

    def decode(self, ids: np.ndarray) -> str:
        """The library's text for ``ids``."""
        return self.model.decode(ids.tolist())


def _encoder(path: str) -> PieceEncoder:
    return w.per_process(("pieces", path), lambda: PieceEncoder(path))


def encode_pieces(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id``, ``ids`` and the source spans ``starts`` and ``ends`` (bytes of the UTF-8 text) of every text.

    Without begin and end ids and without sampling. A null text counts as empty and has no ids; every row is answered
    for itself, ids may be null or repeat; other columns are not read. Texts are encoded where they lie, without a
    shuffle.
    """
    out = docs.select("doc_id").schema.add("ids", ArrayType(IntegerType()))
    out = out.add("starts", ArrayType(LongType())).add("ends", ArrayType(LongType()))
    return docs.select("doc_id", "text").mapInArrow(_spans(model), out)


def decode_pieces(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``encoded`` with ``text``, the library's decoding of ``ids`` (null counts as no ids)."""
    decode = F.pandas_udf(_decoder(model), "string")
    return encoded.withColumn("text", decode(F.coalesce("ids", F.array().cast("array<int>"))))


def piece_digests(docs: DataFrame, model: str = MODEL, with_ids: bool = False) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``, as ``encode_pieces`` and
    ``decode_pieces`` give them, made in one pass; ``spans_crc32`` sums up the spans, little-endian pairs of 64 bits.
    ``with_ids`` adds the ``ids`` themselves.
    """
    out = docs.select("doc_id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    out = out.add("spans_crc32", "long")
    return docs.select("doc_id", "text").mapInArrow(_digests(model, with_ids), out.add("ids", ArrayType(IntegerType())) if with_ids else out)


def _spans(path: str):
    def encode(batches):
        encoder = _encoder(path)
        for batch in w.slices(batches):
            ids, lengths, first, last = encoder.encode(batch.column("text"))
            bounds = np.concatenate([[0], np.cumsum(lengths)])
            lists = [w.as_lists(pa.array(x), bounds) for x in (ids, first, last)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], ["doc_id", "ids", "starts", "ends"])

    return encode


def _decoder(path: str):
    def decode(lists: pd.Series) -> pd.Series:
        encoder = _encoder(path)
        return lists.map(encoder.decode)

    return decode


def _digests(path: str, with_ids: bool):
    def digest(batches):
        w.release()  # what earlier tasks of this worker left
        encoder = _encoder(path)
        spelled = [str(i).encode() for i in range(len(encoder.sizes))]
        for batch in w.slices(batches):
            ids, lengths, first, last = encoder.encode(batch.column("text"))
            spans = np.stack([first, last], 1).astype("<i8")
            listed, at, rows = ids.tolist(), 0, []
            for n in lengths.tolist():
                own = listed[at : at + n]
                text = encoder.model.decode(own)
                rows.append((
                    hashlib.sha256(b",".join([spelled[i] for i in own])).hexdigest(),
                    hashlib.sha256(text.encode()).hexdigest(),
                    zlib.crc32(spans[at : at + n].tobytes()),
                ))
                at += n
            a, b, c = zip(*rows)
            columns = [batch.column("doc_id"), pa.array(lengths, pa.int64()), pa.array(a), pa.array(b), pa.array(c, pa.int64())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"]
            if with_ids:
                columns.append(w.as_lists(pa.array(ids), np.concatenate([[0], np.cumsum(lengths)])))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
        w.release()

    return digest


cloudpickle.register_pickle_by_value(sys.modules[__name__])
