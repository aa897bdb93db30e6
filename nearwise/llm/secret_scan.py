"""Secret scans: three patterns, and candidates near sensitive words that zstandard can't compress from what it knows."""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from nearwise.llm import words as w

#: The kinds of spans, in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "novel")
#: Fixed patterns of the base scan, with the least length of what must be long enough.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_LENGTH = 12
ACCESS, ACCESS_LENGTH = re.compile(r"AKIA[A-Z0-9]+"), 18
HEX, HEX_LENGTH = re.compile(r"[0-9a-f]{16,}"), 16  # only whole runs match, so short ones need not be found first

ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: Words that make what follows them sensitive, in lower case.
SENSITIVE_WORDS = (*ASSIGN_WORDS, b"passphrase", b"credential", b"private", b"bearer", b"authorization", b"access_key", b"access key", b"signature")
SENSITIVE = re.compile("|".join(x.decode() for x in SENSITIVE_WORDS))
#: A candidate ends at "=", so a value is one without its key; at the end of a run "=" pads it.
CANDIDATE_LENGTH = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?")
#: How far behind a sensitive word a candidate may start, and how much text around it may explain it, in characters.
REACH, AROUND = 64, 512
#: Of so many characters without digits one must change case.
CASE_CHANGES = 4
#: How far behind a novel candidate the next one may start; and what follows it as the short last line of a key.
CHAIN = 16
LAST_LINE = re.compile(r"\r?\n[ \t]*([A-Za-z0-9+/_-]{1,15}={0,2})(?=[ \t]*(?:\r?\n|$))")
#: Marginal compressed bytes for each character from which a candidate counts as novel. Random base64 needs about 0.75, a word
#: in its own language about half of that.
NOVELTY = 0.66

#: What code around secrets commonly spells: the dictionary that primes the compressor.
IDENTIFIERS = (
    "password passwd passphrase secret token api_key apikey access_key secret_key private_key public_key client_id "
    "client_secret access_token refresh_token session_id authorization Authorization: Bearer Basic credential "
    "credentials username user_name account_id tenant_id database_url connection_string localhost example.com "
    "https://www. http://api. .json .yaml .config config.get( os.environ[ getenv( process.env. settings. return self. "
    "import from def class const let var public static final String function null None True False undefined "
    "placeholder changeme your_token_here your_api_key_here YOUR_SECRET_KEY xxxxxxxxxxxxxxxx 0000000000000000 "
    "0123456789abcdef 1234567890 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ "
    "signature checksum sha256 sha1 md5 base64 encode decode encrypt decrypt cipher certificate "
    "-----BEGIN RSA PRIVATE KEY----- -----END RSA PRIVATE KEY----- -----BEGIN CERTIFICATE-----"
).split()


class SecretScanner:
    """Finds the spans of one text, as ``(start, kind, end)`` in code points."""

    def __init__(self, identifiers: Sequence[str] = IDENTIFIERS, novelty: float = NOVELTY):
        known = zstandard.ZstdCompressionDict("\n".join(identifiers).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.zstd = zstandard.ZstdCompressor(level=19, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.novelty = novelty

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """What the three patterns find: leftmost matches of each, without those that are too short."""
        found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LENGTH]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        return sorted(found)

    def novel(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Candidates in a sensitive context that nothing around them explains, but for those within one base span.

        A sensitive word opens a context of ``REACH`` characters. A novel candidate carries it on: to what follows within
        ``CHAIN`` characters, line after line of a key or part after part of a token, and to the short last line of a key.
        """
        lower, out, seen = text.encode().lower().decode(), [], 0
        for word in SENSITIVE.finditer(lower):
            at, limit = max(word.end(), seen), word.end() + REACH
            # one that starts at the end of the reach is found, and no search goes on behind it
            while m := CANDIDATE.search(text, at, min(len(text), limit + CANDIDATE_LENGTH)):
                # the run may begin before and end after what was searched
                start, end = m.start(), CANDIDATE.match(text, m.start()).end()
                at = seen = end
                whole = start == 0 or not CANDIDATE_CHARACTER.match(text, start - 1)
                if not whole or not self.is_novel(text, start, end):
                    continue
                limit = max(limit, end + CHAIN)
                spans = [(start, end)]
                if (last := LAST_LINE.match(text, end)) and self.is_novel(text, *last.span(1)):
                    spans.append(last.span(1))
                    at = seen = last.end()
                out += [(x, 3, y) for x, y in spans if not any(i <= x and y <= j for i, _, j in base)]
        return out

    def is_novel(self, text: str, start: int, end: int) -> bool:
        """Whether a span that is no word adds at least ``novelty`` compressed bytes for each of its characters."""
        return mixed(text[start:end]) and self.marginal(text, start, end) >= self.novelty * (end - start)

    def marginal(self, text: str, start: int, end: int) -> int:
        """The bytes that a span adds to its surroundings when both are compressed with the dictionary."""
        before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
        around = (after + before).encode()
        return len(self.zstd.compress(around + text[start:end].encode())) - len(self.zstd.compress(around))

    def __call__(self, text: str) -> tuple[list, list]:
        base = self.base(text)
        return base, sorted(base + self.novel(text, base))


CANDIDATE_CHARACTER = re.compile(r"[A-Za-z0-9+/_-]")


def mixed(candidate: str) -> bool:
    """Whether a candidate has digits and letters, or changes case as often as no word or name does.

    Short surroundings don't tell the compressor that a long word is one.
    """
    changes = sum(a.isupper() != b.isupper() for a, b in zip(candidate, candidate[1:]))
    return any(c.isalpha() for c in candidate) and (any(c.isdigit() for c in candidate) or CASE_CHANGES * changes >= len(candidate))


def suspicious(texts: pa.Array) -> np.ndarray:
    """Which texts can have a span at all: a word of the patterns, a sensitive word, or a long run of hex digits."""
    data, bounds = w.flat(texts)
    raw, cuts = data.tobytes(), bounds
    out = np.zeros(len(texts), bool)
    lower = raw.lower()
    for word, where in [(b"AKIA", raw), *((x, lower) for x in SENSITIVE_WORDS)]:
        at = where.find(word)
        while at >= 0:  # go on in the next text
            row = int(np.searchsorted(cuts, at, "right")) - 1
            out[row] = True
            at = where.find(word, int(cuts[row + 1]))
    digits = HEX_BYTES[data]
    first, last = digits.copy(), digits.copy()
    first[1:] &= ~digits[:-1]
    last[:-1] &= ~digits[1:]
    inner = cuts[(cuts > 0) & (cuts < len(data))]  # a run ends where its text ends
    first[inner] = digits[inner]
    last[inner - 1] = digits[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    out[np.searchsorted(cuts, starts[ends - starts >= HEX_LENGTH], "right") - 1] = True
    return out


HEX_BYTES = np.array([chr(i) in "0123456789abcdef" for i in range(256)])


def find_secrets(docs: DataFrame, identifiers: Sequence[str] = IDENTIFIERS, novelty: float = NOVELTY) -> DataFrame:
    """``doc_id``, ``n_assign``, ``n_access``, ``n_hex``, ``n_novel``, ``base_sha256`` and ``spans`` of every text.

    A span is ``kind:start:end`` in code points, end exclusive; spans are sorted by start, then kind as in ``KINDS``, and
    joined by commas. A ``novel`` span may overlap a base span but does not lie within one. ``base_sha256`` is the hash of the spans of the three patterns; the novelty method only adds
    ``novel`` spans. A null text counts as empty and has no spans; every row is answered for itself, where it lies; other
    columns are not read.
    """
    out = docs.select("doc_id").schema
    for name in ("n_assign", "n_access", "n_hex", "n_novel"):
        out = out.add(name, "long")
    return docs.select("doc_id", "text").mapInArrow(
        _finder(tuple(identifiers), novelty), out.add("base_sha256", "string").add("spans", "string")
    )


def redact_secrets(docs: DataFrame, mask: str = "[SECRET]", identifiers: Sequence[str] = IDENTIFIERS, novelty: float = NOVELTY) -> DataFrame:
    """``docs`` with every span replaced by ``mask``, overlapping ones by one. All rows and other columns stay."""
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    return plain.mapInArrow(_redacter(f"c{names.index('text')}", mask, tuple(identifiers), novelty), plain.schema).toDF(*names)


def _spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def _finder(identifiers, novelty):
    def find(batches):
        scan = SecretScanner(identifiers, novelty)
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in w.slices(batches):
            texts, rows = batch.column("text"), []
            for text, likely in zip(texts, suspicious(texts)):
                base, spans = scan(text.as_py()) if likely else ((), ())
                kinds = [kind for _, kind, _ in spans]
                digest = hashlib.sha256(_spelled(base).encode()).hexdigest() if base else nothing
                rows.append((*(kinds.count(k) for k in range(4)), digest, _spelled(spans)))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"],
            )

    return find


def _redacter(column, mask, identifiers, novelty):
    def redact(batches):
        scan = SecretScanner(identifiers, novelty)
        for batch in w.slices(batches, column):
            texts = batch.column(column)
            likely = suspicious(texts)
            if likely.any():
                new = [masked(t.as_py(), scan(t.as_py())[1], mask) if x else t.as_py() for t, x in zip(texts, likely)]
                place = batch.schema.get_field_index(column)
                batch = batch.set_column(place, batch.schema.field(place), pa.array(new, texts.type))
            yield batch

    return redact


def masked(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    """``text`` with the spans replaced."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


cloudpickle.register_pickle_by_value(sys.modules[__name__])
