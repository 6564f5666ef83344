"""Main text of web pages: two-pass block rules.

A page is cut into blocks at block-level tags. Pass one decides each block by itself:
blocks of many link characters are boilerplate; long blocks with enough stop words are
text; long blocks with few are boilerplate. Short blocks stay undecided. Pass two gives an
undecided block the label of its nearest decided neighbours, or text when they differ in
favour of the nearer one; where pass one finds no text, undecided blocks are text if one
of them is punctuated like a sentence. Marked-up boilerplate (menus, page headers, footers, sidebars,
forms, notices, adverts, reader comments, hidden parts) never becomes a block, and where
a page marks its article, blocks outside it are boilerplate and blocks inside are
boilerplate only for their links, before its first and after its last other block. A form
is boilerplate unless it holds most of the prose of the page or is all there is. A class or id marks boilerplate only as a whole name
(``related-posts``, not ``has-sidebar`` or ``related-work``), and not where the element
holds most of the prose of the page. Long blocks in other languages than those of the stop
words are text if they are punctuated like sentences and hardly linked.

Defined cases: null or empty html gives the empty text; broken markup is read as far as it
goes, unclosed elements end with their parent; a page without any text block is empty.
Time is linear in the length of the page, whatever is left open or closed too often.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>""", re.S)
OPEN_COMMENT = re.compile(r"<!--.*|<!\[CDATA\[.*", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
PART = re.compile(r"[^a-z0-9]+")

# Element names, words of class and id attributes, stop words of four languages.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "noscript", "iframe", "template", "svg", "math", "object", "noframes", "title", "select", "button")
DROPPED = frozenset("head nav footer aside dialog menu".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice pagination paywall popup promo promoted "
    "promotion recommended related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
# pieces that a name of boilerplate may have besides
NEUTRAL = frozenset(
    "area bar block body bottom box btn button buttons center column container content fixed footer form inner item items left link links list main "
    "page panel post posts article articles primary right row secondary section site sticky text top wrap wrapper".split()
)
# names that stay boilerplate however much text they hold
FIRM = frozenset("ad ads advert advertisement comment comments commentlist consent cookie cookies disqus gdpr replies reply respond".split())
HEADER_NAMES = frozenset("header topbar".split())
ARTICLE_NAMES = frozenset("article articlebody post entry story".split())
STOP_WORDS = frozenset(
    "a an and are as at be by for from has have he her his in is it its not of on or she that the they this to was we were which will with you "
    "aber als am auch auf aus bei das dass dem den der des die ein eine einen einer er es für hat ich im ist mit nach nicht oder sich sie sind so über um und von war wie zu zum zur "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou où par pas plus pour que qui sa se ses son sur un une vous "
    "al como con del el ella en es esta este fue ha las lo los más muy no para pero por que se sin sobre su sus un una y ya".split()
)

LONG = 140  # characters
LINKED = 0.5  # share of characters inside links
STOPPED = 0.12  # share of stop words
PROSE = 0.8  # share of the page's prose by which an element overrules its name
SENTENCE = re.compile(r"[.!?…](?=[\s\"'»”’)]|\Z)|[。！？｡؟۔।॥።]")
SPREAD = 400  # characters that a sentence may have on average
TEXT, BOILERPLATE, UNDECIDED = 1, 0, -1


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    article: bool
    named: int = 0  # the outermost element whose name says boilerplate, 0 if none
    firm: bool = False
    form: bool = False  # the named element is a form


def _named(given: dict[str, str], kinds: frozenset[str]) -> set[str]:
    """The words of ``kinds`` that whole class names or the id consist of, apart from neutral ones and numbers."""
    out: set[str] = set()
    for name in f"{given.get('class', '')} {given.get('id', '')}".lower().split():
        parts = {x for x in PART.split(name) if x and not x.isdigit()}
        if parts & kinds and parts <= kinds | NEUTRAL:
            out |= parts & kinds
    return out


def _flags(tag: str, attributes: str, dropped: bool, article: bool) -> tuple[bool, bool, set[str]]:
    """Whether the content of an element is dropped, whether it belongs to the article, and names of boilerplate."""
    here = article or tag in ("article", "main")
    if dropped and tag not in ("article", "main"):
        return True, article, set()
    if tag in DROPPED or (tag == "header" and not here):
        return True, article, set()
    form = {"form"} if tag == "form" else set()
    if not attributes or not attributes.strip():
        return False, here, form
    given = {m[0].lower(): m[1] or m[2] or m[3] for m in ATTRIBUTE.findall(attributes)}
    role = given.get("role", "").lower()
    names = set(PART.split(f"{given.get('class', '')} {given.get('id', '')}".lower()))
    if role in DROPPED_ROLES or "hidden" in given or given.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", given.get("style", "")):
        return True, article, set()
    if tag not in ("body", "html", "main"):
        named = _named(given, DROPPED_NAMES)
        if not here and not names & ARTICLE_NAMES:
            named |= _named(given, HEADER_NAMES)
        if named or form:
            return tag not in BLOCK, article, named or form
    here = here or role in ("main", "article") or "articlebody" in given.get("itemprop", "").lower() or bool(names & ARTICLE_NAMES and tag in ("div", "section"))
    return False, here, set()


def blocks(page: str) -> list[Block]:
    """The text blocks of a page that no element, role or attribute excludes, in page order."""
    out: list[Block] = []
    parts: list[str] = []
    linked = 0
    # tag, dropped, article, inside a link, named, firm, place of the innermost block element
    stack: list[tuple[str, bool, bool, bool, int, bool, int]] = []
    held: defaultdict[str, int] = defaultdict(int)  # open elements of each tag
    endless: set[str] = set()  # raw elements without an end tag in the rest of the page
    forms: set[int] = set()
    dropped = article = link = firm = False
    named = last = 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, linked, article, named, firm, named in forms))
            parts.clear()
        linked = 0

    def top() -> None:
        nonlocal dropped, article, link, named, firm
        _, dropped, article, link, named, firm, _ = stack[-1] if stack else ("", False, False, False, 0, False, -1)

    def cut(i: int) -> None:
        while len(stack) > i:
            held[stack.pop()[0]] -= 1

    def add(text: str) -> None:
        nonlocal linked
        if not dropped and text:
            parts.append(text)
            if link:
                linked += len(text.strip())

    at, low = 0, None
    final = page.rfind(">")  # no tag ends behind it
    while (m := (TOKEN if at <= final else OPEN_COMMENT).search(page, at)) is not None:
        add(page[at : m.start()])
        at = m.end()
        if m.lastindex is None:
            continue
        tag = m[2].lower()
        if m[1]:  # an end tag
            if tag in BLOCK:
                close()
            if held[tag] > 0:
                i = len(stack) - 1
                while stack[i][0] != tag:
                    i -= 1
                cut(i)
                top()
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                low = low if low is not None else page.lower() if len(page.lower()) == len(page) else re.sub("[A-Z]+", lambda x: x[0].lower(), page)
                end = -1 if tag in endless else low.find(f"</{tag}", at)
                if end < 0:
                    endless.add(tag)
                if end < 0 and tag in ("button", "select", "title", "svg", "object"):
                    continue
                close_at = low.find(">", end) if end >= 0 else -1
                at = close_at + 1 if close_at >= 0 else len(page)
            continue
        if tag == "br" or tag == "wbr":
            if tag == "br":
                add(" ")
            continue
        if tag in BLOCK:
            close()
            i = stack[-1][6] if stack else -1
            if i >= 0 and stack[i][0] == "p":  # an open p ends, also inside inline elements
                cut(i)
                i = stack[-1][6] if stack else -1
            if tag in ("li", "dd", "dt", "td", "th", "tr", "option"):
                if i >= 0 and (stack[i][0] == tag or {stack[i][0], tag} in ({"dd", "dt"}, {"td", "th"})):
                    cut(i)
            top()
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            continue
        if tag == "a" and held["a"] > 0:  # its place stays, so that the places above it do
            i = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "a")
            before = stack[i - 1] if i else ("", False, False, False, 0, False, -1)
            stack[i] = ("", *before[1:])
            held["a"] -= 1
            top()
        if tag in ("article", "main"):
            named, firm = 0, False
        dropped, article, names = _flags(tag, m[3], dropped, article)
        if names and (not named or named in forms):
            last += 1
            named = last
            if names == {"form"}:
                forms.add(named)
        firm = firm or bool(names & FIRM)
        link = link or tag == "a"
        stack.append((tag, dropped, article, link, named, firm, len(stack) if tag in BLOCK else stack[-1][6] if stack else -1))
        held[tag] += 1
    add(page[at:])
    close()
    return out


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W\d_]+", text.lower()) if w]


def decide(block: Block, marked: bool) -> int:
    """Pass one. ``marked``: the page marks its article."""
    if marked and not block.article:
        return BOILERPLATE
    if block.linked > LINKED * len(block.text):
        return BOILERPLATE
    if len(block.text) < LONG:
        return UNDECIDED
    words = _words(block.text)
    if words and sum(w in STOP_WORDS for w in words) >= STOPPED * len(words):
        return TEXT
    told = block.linked <= STOPPED * len(block.text) and len(SENTENCE.findall(block.text)) * SPREAD >= len(block.text)
    return UNDECIDED if marked else TEXT if told else BOILERPLATE


def unmarked(found: list[Block]) -> list[Block]:
    """The blocks without those of elements named as boilerplate, except elements that hold most of the prose."""
    held: dict[int, int] = {}
    for b in found:
        if len(b.text) >= LONG and not b.firm and b.linked <= LINKED * len(b.text):
            held[b.named] = held.get(b.named, 0) + len(b.text)
    main = {n for n, size in held.items() if n and size >= PROSE * sum(held.values())}
    left = [b for b in found if not b.firm and (not b.named or b.named in main)]
    if not left and any(b.form and not b.firm and SENTENCE.search(b.text) for b in found):
        left = [b for b in found if b.form and not b.firm]
    return left


def inherit(labels: list[int], default: int) -> list[int]:
    """Pass two: undecided blocks take the label of the nearest decided one, text on a tie."""
    before: list[tuple[int, int]] = []
    seen = (default, 1 << 30)
    for x in labels:
        seen = (x, 0) if x != UNDECIDED else (seen[0], seen[1] + 1)
        before.append(seen)
    out, seen = [], (default, 1 << 30)
    for x, b in zip(reversed(labels), reversed(before), strict=True):
        seen = (x, 0) if x != UNDECIDED else (seen[0], seen[1] + 1)
        out.append(x if x != UNDECIDED else b[0] if b[1] < seen[1] else seen[0] if seen[1] < b[1] else max(b[0], seen[0]))
    return out[::-1]


def main_text(page: str | None) -> str:
    found = unmarked(blocks(page or ""))
    marked = any(b.article for b in found)
    if marked:  # blocks outside the article are no neighbours
        found = [b for b in found if b.article]
    labels = [decide(b, marked) for b in found]
    if marked:  # links are boilerplate only at the edges of the article
        kept = [i for i, x in enumerate(labels) if x != BOILERPLATE]
        labels = [TEXT if x == BOILERPLATE and kept and kept[0] < i < kept[-1] else x for i, x in enumerate(labels)]
    elif TEXT not in labels and any(x == UNDECIDED and SENTENCE.search(b.text) for b, x in zip(found, labels, strict=True)):
        labels = [TEXT if x == UNDECIDED else x for x in labels]
    labels = inherit(labels, TEXT if marked else BOILERPLATE)
    return " ".join(b.text for b, x in zip(found, labels, strict=True) if x == TEXT)


@F.pandas_udf(T.StringType())
def extract(html: pd.Series) -> pd.Series:
    return html.map(main_text, na_action=None)


def main_texts(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` as column ``page`` with its main text."""
    return pages.select(F.struct("*").alias("page"), F.coalesce(F.col(html), F.lit("")).alias("html")).select("page", extract("html").alias("text"))
