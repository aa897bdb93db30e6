"""Main text of HTML pages: blocks are judged by stop words, length and links; ambiguous ones follow their neighbours."""

from __future__ import annotations

import html
import itertools
import re
import sys
from typing import NamedTuple

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from nearwise.llm import words as w

# Names of the HTML standard, and words by which pages name their parts.
RAW = frozenset("script style textarea title noscript template iframe svg math object canvas audio video select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
DROPPED = frozenset("nav aside footer menu dialog button label fieldset legend".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
DROPPED_NAMES = frozenset(
    "ad ads adv advert advertisement adverts sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs sidebar footer comment comments disqus respond "
    "reply replies share sharing social related recommended newsletter subscribe subscription signup login search widget "
    "toolbar pagination pager".split()
)
#: Words that may stand beside those in a name: "site-footer" is a footer, "has-sidebar" or "ad-free" name no part.
BESIDE = frozenset(
    "site page main global primary secondary top bottom left right box bar list item items link links wrap wrapper container "
    "section area inner outer block row col column panel holder group button buttons icon icons form title head body".split()
)
#: These are only dropped outside an article, inside which they hold its own title.
DROPPED_OUTSIDE = frozenset(["header", "masthead"])
ARTICLE = frozenset(["article", "main"])
STOP_WORDS = frozenset(
    # English, German, French and Spanish: function words
    ("a about after all also am an and any are as at be because been before being between both but by can could "
    "did do does down during each even few first for from had has have he her here him his how i if in into is it "
    "its just like made make many may me more most much must my new no not now of on one only or other our out "
    "over own s said same she should so some such t than that the their them then there these they this those "
    "through time to too two under up us very was we well were what when where which while who will with would "
    "you your "
    "aber alle allem allen aller alles als also am an andere anderen auch auf aus bei beim bin bis da damit dann "
    "das dass dem den denn der des dessen die dies diese diesem diesen dieser dieses doch dort du durch ein eine "
    "einem einen einer eines er es etwas für gegen hat hatte hatten haben hier ich ihm ihn ihnen ihr ihre ihrem "
    "ihren ihrer im in ins ist ja jede jeder jetzt kann kein keine können man mehr mein mit muss nach nicht noch "
    "nun nur ob oder ohne sehr sein seine seinem seinen seiner seit sich sie sind so soll über um und uns unter "
    "vom von vor war waren was weil wenn werden wie wieder wir wird wo wurde wurden zu zum zur zwischen "
    "à ai alors après au aussi autre autres aux avait avant avec avoir bien c ce cela celle ces cet cette chez "
    "comme d dans de depuis des deux dont du elle elles en encore entre es est et été être eu fait fut il ils j "
    "je l la le les leur leurs lui m ma mais me même mes moins mon n ne nos notre nous on ont or ou où par pas "
    "pendant peu peut plus pour qu quand que qui s sa sans se sera ses si son sont sous sur t ta te tes ton tous "
    "tout toute toutes très tu un une vers vos votre vous y "
    "a al algo ante antes así aún aunque cada como con contra cual cuando de del desde donde dos durante e el él "
    "ella ellas ellos en entre era eran es esa ese eso esta está están estas este esto estos fue fueron ha había "
    "han hasta hay la las le les lo los más me mi mientras muy ni no nos nosotros o otra otras otro otros para "
    "pero poco por porque puede que qué quien se sea según ser si sí sido sin sobre solo son su sus también tan "
    "tanto te tiene tienen toda todas todo todos tras tu un una uno unos y ya yo "
    ).split()
)

#: A block of fewer characters is ambiguous; one of more stands by itself if it has stop words enough.
SHORT, LONG = 70, 200
#: Shares of stop words. Of the article paragraphs of sf0.01 and sf0.1 from SHORT characters on, 9 in 10 have the upper and 19
#: in 20 the lower in each of the four languages; a list of names or terms has hardly any.
STOP_LOW, STOP_HIGH = 0.07, 0.16
#: Share of characters in links from which a block is no text; inside an article one with stop words may cite more.
MOST_LINKS, MOST_LINKS_INSIDE = 0.2, 0.7
WORD = re.compile(r"[^\W\d_]+")
#: The end of a sentence, in scripts with and without spaces; prose has one in so many characters at least.
SENTENCE, SENTENCE_LENGTH = re.compile(r"[.!?…](?=[\s\"'»”)]|$)|[。！？।؟۔]"), 300

COMMENT = "<!--"
#: A tag up to its end if no attribute value holds "<" or ">", else only its name. A value is quoted where a quote follows "=".
TAG = re.compile(
    r"<(?:!--|(/?)([a-zA-Z][^\s/<>]*+)(?:((?:[^<>\"'=]++|[\"']|=\s*+(?:\"[^\"<>]*+\"|'[^'<>]*+'|(?![\"'])))*+)>)?"
    r"|[!?/][^<>]*>)"
)
OPENING, UNQUOTED = re.compile(r"=\s*+([\"'])|[<>]"), re.compile(r"([^<>]*)>")
ATTRIBUTE = re.compile(r"([^\s\"'=<>/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>][^\s>]*+)))?")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

GOOD, BAD, NEAR, AMBIGUOUS = "good", "bad", "near", "ambiguous"


class Block(NamedTuple):
    text: str
    link_share: float
    inside: bool  # of an article
    form: bool  # inside a form, but not of an article


def blocks_of(page: str) -> list[Block]:
    """The visible blocks of a page in order, without the parts that its markup sets aside."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, dropped from here on, inside an article, in a form outside of one
    count: dict[str, int] = {}
    pieces: list[str] = []
    links: list[str] = []
    dropped = inside = form = False
    at, n, comments, unclosed, values = 0, len(page), True, set(), _Values(page)

    def close_block():
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                linked = len(" ".join(html.unescape("".join(links)).split()))
                out.append(Block(text, linked / len(text), inside, form))
            pieces.clear()
            links.clear()

    def pop_to(tag):
        nonlocal dropped, inside, form
        while stack:
            name = stack.pop()[0]
            count[name] -= 1
            if name == tag:
                break
        dropped, inside, form = stack[-1][1:] if stack else (False, False, False)

    while at < n:
        m = TAG.search(page, at)
        end = m.start() if m else n
        if end > at and not dropped:
            pieces.append(page[at:end])
            if count.get("a"):
                links.append(page[at:end])
        if not m:
            break
        at = m.end()
        if m[0] == COMMENT:
            close = page.find("-->", at) if comments else -1
            comments = close >= 0
            at = close + 3 if close >= 0 else at
            continue
        tag, attributes = (m[2] or "").lower(), m[3]
        if not tag:
            continue
        if attributes is None:
            close = values.tag_end(at)
            loose = UNQUOTED.match(page, at) if close < 0 else None
            if close < 0 and not loose:  # no tag: the sign stands for itself
                if not dropped:
                    pieces.append("<")
                    if count.get("a"):
                        links.append("<")
                at = end + 1
                continue
            attributes = loose[1] if loose else page[at:close]
            at = loose.end() if loose else close + 1
        if m[1]:  # an end tag
            if tag in BLOCKS:
                close_block()
            if count.get(tag):
                pop_to(tag)
            continue
        if tag == "br" or tag in ("td", "th") and not dropped:
            pieces.append(" ")
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^<>]*>?", re.I).search(page, at) if tag not in unclosed else None
            if close:
                at = close.end()
            elif tag in ("script", "style"):
                at = n  # as in a browser, the rest of the page is code
            else:
                unclosed.add(tag)
            continue
        if tag in BLOCKS:
            close_block()
            if count.get("p") and tag != "p" or tag == "p" and count.get("p"):
                pop_to("p")
            if tag == "li" and stack and stack[-1][0] == "li":
                pop_to("li")
            if tag in ARTICLE:
                for left_open in ("nav", "header"):
                    if count.get(left_open):
                        pop_to(left_open)
        if tag in VOID:
            continue
        article = inside or tag in ARTICLE
        drop = dropped or _set_aside(tag, attributes, inside)
        stack.append((tag, drop, article, (form or tag == "form") and not article))
        count[tag] = count.get(tag, 0) + 1
        if drop and not dropped and tag in BLOCKS:  # a button in a paragraph does not end it
            close_block()
        dropped, inside, form = stack[-1][1:]
    close_block()
    return out


class _Values:
    """Finds the ends of tags whose attribute values hold "<" or ">", in time linear in the page over all its tags."""

    def __init__(self, page: str):
        self.page = page
        self.failed: set[int] = set()  # quotes from which no end of a tag was reached
        self.absent: set[str] = set()  # quotes that do not follow any more

    def tag_end(self, at: int) -> int:
        """Where the tag ends whose attributes start at ``at``, or -1 if a value is not closed or another tag starts."""
        opened = []
        while m := OPENING.search(self.page, at):
            if m[0] == ">":
                return m.start()
            if m[0] == "<" or m.start(1) in self.failed:
                break
            opened.append(m.start(1))
            close = self.page.find(m[1], m.end()) if m[1] not in self.absent else -1
            if close < 0:
                self.absent.add(m[1])
                break
            at = close + 1
        self.failed.update(opened)
        return -1


def _set_aside(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element's tag, role, class, id or style says that it is not part of the text."""
    if tag in DROPPED or tag in DROPPED_OUTSIDE and not inside or tag == "form" and inside:
        return True  # a form around everything may be how a site is served; one in an article is a form
    if not attributes.strip() or tag in ("html", "body"):
        return False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        value, name = a or b or c, name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and value.lower() in DROPPED_ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name in ("class", "id") and tag not in ARTICLE | {"a", "p", "b", "i", "em", "strong", "h1"} or name == "class":
            if any(names_a_part(x, inside) for x in value.split()):
                return True
    return False


def names_a_part(name: str, inside: bool = False) -> bool:
    """Whether a whole class or id names a part of a page that is no main text, alone or with words like site or list."""
    words = {x.lower() for x in NAME.findall(name) if not x.isdigit()}
    parts = DROPPED_NAMES if inside else DROPPED_NAMES | DROPPED_OUTSIDE
    return bool(words & parts) and words <= parts | BESIDE


def stop_share(text: str) -> float:
    """The share of stop words among the words of a text; a word is a run of letters."""
    words = WORD.findall(text.lower())
    return sum(x in STOP_WORDS for x in words) / len(words) if words else 0.0


def in_sentences(text: str) -> bool:
    """Whether a text has the ends of sentences as often as prose of any language."""
    return len(SENTENCE.findall(text)) * SENTENCE_LENGTH >= len(text)


def judge(block: Block, share: float, known: bool = True) -> str:
    """First pass: the label of a block by itself, from its links, its length and its ``share`` of stop words.

    An article is a prior: what would be bad for its words is ambiguous in it. So is a form outside of articles: only a long
    text is good in it. On a page whose language is not ``known`` to the lists of stop words sentences stand for them.
    """
    if block.link_share > (MOST_LINKS_INSIDE if block.inside else MOST_LINKS) or not block.inside and "©" in block.text:
        return BAD
    if len(block.text) < SHORT:
        return BAD if block.form or block.link_share and not block.inside else AMBIGUOUS
    long = len(block.text) > LONG
    if share >= STOP_HIGH or not known and block.link_share <= MOST_LINKS and in_sentences(block.text):
        return GOOD if long or block.inside else BAD if block.form else NEAR
    if block.link_share > MOST_LINKS or block.form:
        return BAD
    if share >= STOP_LOW:
        return NEAR
    # one stop word among few says little, none at all or few among many say enough
    return AMBIGUOUS if block.inside or share and not long else BAD


def settle(labels: list[str], default: str) -> list[bool]:
    """Second pass: whether each block is kept. An undecided one follows the nearest decided one.

    Between a good and a bad one at the same distance a block with some stop words is kept and a short one is not; where
    nothing is decided the first is kept and for the other the ``default`` holds.
    """
    before: list[tuple[int, str] | None] = []
    last = None
    for i, label in enumerate(labels):
        before.append(last)
        if label in (GOOD, BAD):
            last = (i, label)
    out, following = [False] * len(labels), None
    for i in range(len(labels) - 1, -1, -1):
        label = labels[i]
        if label in (GOOD, BAD):
            following = (i, label)
            out[i] = label == GOOD
            continue
        near = [(abs(i - x[0]), x[1]) for x in (before[i], following) if x]
        if not near:
            out[i] = default == GOOD or label == NEAR
        elif len(near) == 2 and near[0][0] == near[1][0] and near[0][1] != near[1][1]:
            out[i] = label == NEAR
        else:
            out[i] = min(near)[1] == GOOD
    return out


def main_text(page: str | None) -> str:
    """The main text of a page, one line for each block; empty for a null or a page without text.

    Blocks in and out of articles are judged; an undecided one follows its neighbours on the same side.
    """
    blocks = blocks_of(page or "")
    shares = [stop_share(b.text) if len(b.text) >= SHORT else 0.0 for b in blocks]
    known = any(share >= STOP_LOW and b.link_share <= MOST_LINKS for b, share in zip(blocks, shares))
    labels = [judge(b, share, known) for b, share in zip(blocks, shares)]
    undecided = GOOD if not {GOOD, BAD} & set(labels) else BAD  # a page of nothing but short blocks is all the text there is
    out = []
    for inside, run in itertools.groupby(zip(blocks, labels), lambda x: x[0].inside):
        run = list(run)
        kept = settle([label for _, label in run], GOOD if inside else undecided)
        out += [b.text for (b, _), keep in zip(run, kept) if keep]
    return "\n".join(out)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points) of every row of ``pages``.

    The first pass labels each block by its share of links, its length and its share of stop words; inside an article (or
    main) element few stop words make it ambiguous, elsewhere bad. On a page without the stop words of any listed language
    the ends of sentences stand for them. The second pass gives every ambiguous block the label of its
    nearest decided neighbour inside, or outside, of articles; one without any is kept inside, and everywhere on a page
    without any decided block. Menus, page headers, footers, sidebars, notices, adverts, controls of forms, comments,
    scripts and styles are set aside by their markup before that, by the names of elements and by whole classes and ids
    that name such a part; of other text in a form outside of articles only long text is kept. White space in a block becomes one space; character references are decoded.

    A null html counts as empty and gives an empty text. Every row is answered for itself, where it lies; keys may be
    null or repeat; other columns are not read. Time is linear in the length of a page, whatever its markup.
    """
    schema = pages.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")
    return pages.select("page_id", "url", "html").mapInArrow(_extractor, schema)


def _extractor(batches):
    for batch in w.slices(batches, "html"):
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
