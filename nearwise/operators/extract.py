"""Records out of tables of web pages."""

from __future__ import annotations

import html
import re
import sys
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType

from nearwise.functions.text import collapse_space, strip

# Fixed value: what a page's character references look like.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


@F.arrow_udf(ArrayType(ArrayType(StringType())))
def _resolved(references: pa.Array) -> pa.Array:
    """Lists of lists of character references, resolved: each distinct one of a batch once."""
    if isinstance(references, pa.ChunkedArray):
        references = references.combine_chunks()
    inner = references.flatten()
    coded = inner.flatten().dictionary_encode()
    texts = pa.array([html.unescape(reference) for reference in coded.dictionary.to_pylist()], pa.string())

    def offsets(lists: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))

    flat = texts.take(coded.indices) if len(texts) else pa.array([], pa.string())
    return pa.ListArray.from_arrays(offsets(references), pa.ListArray.from_arrays(offsets(inner), flat))


def plain_texts(markups: Column) -> Column:
    """Each markup without tags, with all character references resolved, trimmed.

    Only the references themselves are sent to Python; texts are cut there and put together again in the JVM.
    """
    bare = F.transform(markups, lambda markup: F.regexp_replace(markup, "<[^>]*>", ""))

    def references(text: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))
        return F.coalesce(F.when(F.contains(text, F.lit("&")), found), F.array().cast("array<string>"))

    def filled(text: Column, resolved: Column) -> Column:
        between = F.split(text, REFERENCE, -1)
        whole = F.array_join(F.zip_with(between, resolved, lambda part, r: F.concat(part, F.coalesce(r, F.lit("")))), "")
        return strip(F.when(F.size(resolved) > 0, whole).otherwise(text))

    return F.zip_with(bare, _resolved(F.transform(bare, references)), filled)


def page_fields(pages: DataFrame) -> DataFrame:
    """Flat fields of every page: url, title, heading and body text; a missing one is the empty string."""

    article = F.regexp_extract("html", r"(?is)<article[^>]*>(.*?)</article>", 1)
    fields = F.array(
        F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1),
        F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1),
        F.regexp_replace(article, "<[^>]*>", " "),
    )
    found = pages.select("page_id", "url", plain_texts(fields).alias("fields"))
    title, heading, body = (F.get("fields", F.lit(i)) for i in range(3))
    return found.select("page_id", "url", title.alias("title"), heading.alias("heading"), collapse_space(body).alias("body"))


def link_texts(page: Column) -> Column:
    """The texts of all links of a page, in order."""
    return plain_texts(F.regexp_extract_all(page, F.lit(r"(?is)<a\b[^>]*>(.*?)</a>"), F.lit(1)))


def page_links(pages: DataFrame) -> DataFrame:
    """One row per link of every page: position from 1 and text."""
    links = pages.select("page_id", F.posexplode(link_texts(F.col("html"))).alias("at", "link_text"))
    return links.select("page_id", (F.col("at") + 1).alias("link_no"), "link_text")


CARD_SCHEMA = (
    "page_id long, card_no int, name string, facet string, description string, tags array<string>, corrupt boolean"
)
VOID_TAGS = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
}
UNREAD_TAGS = {"script", "style", "template"}


def extract_cards(pages: DataFrame) -> DataFrame:
    """One row per record card of every page.

    A card is a ``div`` of class ``group``. Its name is the first ``h2 a span``, its facet the second
    ``h2``, its description the first ``span.line-clamp-2 span``, its tags every ``div[title] span``; a
    missing field is the empty string. A card inside a card is a row of its own. A page the parser rejects
    becomes one row with ``corrupt`` set.

    Pages that cannot hold a card are dropped before any row reaches Python.
    """
    may_hold = F.contains("html", F.lit("group")) | F.contains("html", F.lit("&#"))

    names, schema = [part.split(" ")[0] for part in CARD_SCHEMA.split(", ")], _CARD_TYPES

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row for page in zip(*(column.to_pylist() for column in batch.columns)) for row in _cards_of(*page)]
            columns = zip(*rows) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return pages.select("page_id", "html").where(may_hold).mapInArrow(read, CARD_SCHEMA)


_CARD_TYPES = pa.schema([
    ("page_id", pa.int64()), ("card_no", pa.int32()), ("name", pa.string()), ("facet", pa.string()),
    ("description", pa.string()), ("tags", pa.list_(pa.string())), ("corrupt", pa.bool_()),
])


def _cards_of(page_id: int, html: str) -> list[tuple]:
    reader = _CardReader()
    try:
        reader.feed(html)
        reader.close()
    except (AssertionError, ValueError):
        return [(page_id, None, None, None, None, None, True)]
    return [(page_id, number, *card, False) for number, card in enumerate(reader.finished(), start=1)]


#: A place in the tree that fields are read from, as a bit of what an element lies within.
IN_HEADING, IN_LINK, IN_CLAMP, IN_TITLED, UNREAD = 1, 2, 4, 8, 16


#: Tags written so plainly that the general parser need not look at them.
_PLAIN_START = re.compile(r'<([a-zA-Z][a-zA-Z0-9]*)((?:\s+[a-zA-Z][-a-zA-Z0-9]*="[^"<>&]*")*)\s*>')
_PLAIN_ATTRIBUTE = re.compile(r'([a-zA-Z][-a-zA-Z0-9]*)="([^"<>&]*)"')
_PLAIN_END = re.compile(r"</([a-zA-Z][a-zA-Z0-9]*)\s*>")


class _CardReader(HTMLParser):
    """Reads a page's cards in one pass, in time that grows with the page and with what comes out.

    All text goes into one list. An element that a field is read from remembers from where to where its text lies there.
    The elements of a card are those begun while it is open, which is a range of each field's elements: a card remembers
    two ends of it, so cards within cards share what they hold.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.found = {"name": [], "heading": [], "description": [], "tag": []}  # of each element its [start, end) in texts
        self.cards: list[list[tuple]] = []  # of each card the numbers of elements found when it began and when it ended
        self.open: list[tuple] = [("", 0, (), None)]  # tag, what it lies within, its texts' spans, its card
        self.places = defaultdict(list)  # where each tag lies in ``open``

    def updatepos(self, i, j):
        return j  # no line numbers

    def parse_starttag(self, i):
        found = _PLAIN_START.match(self.rawdata, i)
        if not found or (tag := found[1].lower()) in self.CDATA_CONTENT_ELEMENTS:
            return super().parse_starttag(i)
        self.handle_starttag(tag, [(name.lower(), value) for name, value in _PLAIN_ATTRIBUTE.findall(found[2])] if found[2] else [])
        return found.end()

    def parse_endtag(self, i):
        found = _PLAIN_END.match(self.rawdata, i)
        if not found or self.cdata_elem is not None:
            return super().parse_endtag(i)
        self.handle_endtag(found[1].lower())
        return found.end()

    def handle_starttag(self, tag, attrs):
        within = self.open[-1][1]
        classes = next((value or "" for name, value in reversed(attrs) if name == "class"), "").split() if attrs else ()
        fields = ()
        if tag == "span" and within & (IN_LINK | IN_CLAMP | IN_TITLED):
            fields = [f for f, place in (("name", IN_LINK), ("description", IN_CLAMP), ("tag", IN_TITLED)) if within & place]
        elif tag == "h2":
            fields = ("heading",)
        spans = [[len(self.texts), None] for _ in fields]
        for field, span in zip(fields, spans):
            self.found[field].append(span)
        card = None
        if tag == "div" and "group" in classes:
            card = [self._counts(), None]
            self.cards.append(card)
        if tag in VOID_TAGS:
            return
        if tag == "h2":
            within |= IN_HEADING
        elif tag == "a" and within & IN_HEADING:
            within |= IN_LINK
        elif tag == "span" and "line-clamp-2" in classes:
            within |= IN_CLAMP
        elif tag == "div" and any(name == "title" for name, _ in attrs):
            within |= IN_TITLED
        elif tag in UNREAD_TAGS:
            within |= UNREAD
        self.places[tag].append(len(self.open))
        self.open.append((tag, within, spans, card))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag not in VOID_TAGS and self.places[tag]:
            self._close(self.places[tag][-1])

    def handle_data(self, data):
        if not self.open[-1][1] & UNREAD:
            self.texts.append(data)

    def finished(self) -> Iterator[tuple]:
        """Name, facet, description and tags of every card, in order of their beginnings."""
        self._close(1)
        for first, last in self.cards:
            ranges = {field: (found, a, b) for (field, found), a, b in zip(self.found.items(), first, last)}
            tags, a, b = ranges["tag"]
            yield (
                self._at(0, *ranges["name"]), self._at(1, *ranges["heading"]), self._at(0, *ranges["description"]),
                [self._text(span) for span in tags[a:b]],
            )

    def _at(self, place, found, first, last):
        return self._text(found[first + place]) if first + place < last else ""

    def _text(self, span):
        return "".join(self.texts[span[0] : span[1]]).strip()

    def _counts(self):
        return tuple(len(found) for found in self.found.values())

    def _close(self, size):
        """End all open elements but the first ``size``."""
        while len(self.open) > size:
            tag, _, spans, card = self.open.pop()
            self.places[tag].pop()
            for span in spans:
                span[1] = len(self.texts)
            if card:
                card[1] = self._counts()


cloudpickle.register_pickle_by_value(sys.modules[__name__])
