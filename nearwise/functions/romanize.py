"""Devanagari to Latin letters, in the published ITRANS scheme."""

from __future__ import annotations

import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# The ITRANS letters.
CONSONANTS = {
    "क": "k", "ख": "kh", "ग": "g", "घ": "gh", "ङ": "~N",
    "च": "ch", "छ": "Ch", "ज": "j", "झ": "jh", "ञ": "~n",
    "ट": "T", "ठ": "Th", "ड": "D", "ढ": "Dh", "ण": "N",
    "त": "t", "थ": "th", "द": "d", "ध": "dh", "न": "n",
    "प": "p", "फ": "ph", "ब": "b", "भ": "bh", "म": "m",
    "य": "y", "र": "r", "ल": "l", "व": "v",
    "श": "sh", "ष": "Sh", "स": "s", "ह": "h", "ळ": "L",
    "क़": "q", "ख़": "K", "ग़": "G", "ज़": "z",
    "ड़": ".D", "ढ़": ".Dh", "फ़": "f", "य़": "Y", "ऱ": "R", "\u0929": "^n", "\u0934": "zh",
}
VOWELS = {
    "अ": "a", "आ": "A", "इ": "i", "ई": "I", "उ": "u", "ऊ": "U",
    "ऋ": "RRi", "ॠ": "RRI", "ऌ": "LLi", "ॡ": "LLI",
    "ए": "e", "ऐ": "ai", "ओ": "o", "औ": "au",
    "\u090d": "a.c", "\u0972": "a.c", "\u0911": "A.c", "\u090e": "^e", "\u0912": "^o",
}
VOWEL_SIGNS = {
    "ा": "A", "ि": "i", "ी": "I", "ु": "u", "ू": "U",
    "ृ": "RRi", "ॄ": "RRI", "ॢ": "LLi", "ॣ": "LLI",
    "े": "e", "ै": "ai", "ो": "o", "ौ": "au",
    "\u0945": "a.c", "\u0949": "A.c", "\u0946": "^e", "\u094a": "^o",
}
VIRAMA = "्"
MARKS = {"ं": "M", "ः": "H", "ँ": ".N", "ऽ": ".a", "ॐ": "OM", "।": "|", "॥": "||"}
DIGITS = {"०": "0", "१": "1", "२": "2", "३": "3", "४": "4", "५": "5", "६": "6", "७": "7", "८": "8", "९": "9"}
NUKTA = "़"
NUKTA_LETTERS = {
    "क": "क़", "ख": "ख़", "ग": "ग़", "ज": "ज़",
    "ड": "ड़", "ढ": "ढ़", "फ": "फ़", "य": "य़", "र": "ऱ",
    "न": "\u0929", "ळ": "\u0934",
}


# The code points of the consonants above, and of what replaces their inherent vowel.
CONSONANT_CLASS = "\u0915-\u0939\u0958-\u095f"
CLOSER_CLASS = "\u093e-\u094d\u0962\u0963"

#: Runs of letters that a batch remembers before it starts afresh.
MEMO_RUNS = 500_000


def _transitions() -> dict[str, tuple[str, bool, bool]]:
    """For each letter its spelling, whether it takes the place of an inherent vowel, and whether it brings one."""
    letters = {**CONSONANTS, **VOWELS, **VOWEL_SIGNS, VIRAMA: "", **MARKS, **DIGITS}
    closer, consonant = re.compile(f"[{CLOSER_CLASS}]"), re.compile(f"[{CONSONANT_CLASS}]")
    block = map(chr, range(0x0900, 0x0980))
    return {c: (letters.get(c, c), bool(closer.match(c)), bool(consonant.match(c))) for c in block}


TRANSITIONS = _transitions()
RUNS = re.compile("([\u0900-\u097f]+)")
WITH_NUKTA = re.compile(f"[{''.join(NUKTA_LETTERS)}]{NUKTA}")


def spell(run: str) -> str:
    """A run of Devanagari letters in ITRANS, letter by letter."""
    if NUKTA in run:
        run = WITH_NUKTA.sub(lambda pair: NUKTA_LETTERS[pair[0][0]], run)
    out, open_consonant = [], False
    for letter in run:
        spelled, closes, opens = TRANSITIONS[letter]
        if open_consonant and not closes:
            out.append("a")
        out.append(spelled)
        open_consonant = opens
    return "".join(out) + "a" * open_consonant


@F.arrow_udf(StringType())
def _spelled(texts: pa.Array) -> pa.Array:
    """Texts with their Devanagari runs spelled, each distinct run once."""
    memo, out = {}, []
    for text in texts.to_pylist():
        if text is not None:
            pieces = RUNS.split(text)  # every second piece is a run
            for run in set(pieces[1::2]).difference(memo):
                memo[run] = spell(run)
            pieces[1::2] = [memo[run] for run in pieces[1::2]]
            text = "".join(pieces)
            if len(memo) > MEMO_RUNS:
                memo.clear()
        out.append(text)
    return pa.array(out, pa.string())


def romanize(text: Column) -> Column:
    """The text with Devanagari letters spelled in ITRANS; all other characters stay.

    A consonant without a vowel sign or virama carries an inherent ``a``. Only texts with Devanagari letters are sent to
    Python; there runs of such letters are cut out, spelled, and put back in their places.
    """
    return F.coalesce(_spelled(F.when(has_devanagari(text), text)), text)


def has_devanagari(text: Column) -> Column:
    """Whether any character is in the Devanagari block."""
    return F.rlike(text, F.lit("[\u0900-\u097f]"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
