"""Main text of web pages by the distribution of line blocks: markup is stripped to lines, text lengths are summed over windows
of lines, and the text between a surge of these sums and the next dive is kept.

A line is what stands between two block-level tags. Lines of menus, page headers, footers, sidebars, notices, adverts, forms,
comments and scripts (by tag, role, class or id) are emptied, so they are dips of the distribution; so are lines outside
`article` (or, without one, `main`) where a page has such an element. Text of links has no length, so lists of links are dips, too.

Defined results: null and empty pages give the empty text; white space is what Unicode calls so, no-break spaces included; a tag or
comment that the end of the page cuts off is markup, a character reference that it cuts off is text; of elements that are never
closed, menus, headers, footers and adverts end where an article begins; repeated rows are rows of their own, without or with an id;
other columns do not matter. Pages are independent rows: nothing is shuffled, a page of n characters takes time in proportion to n.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import small_batches

#: Lines of a window, and the length that a window has to reach where no element marks the article.
WINDOW, SURGE = 3, 86

# Names of HTML elements and the usual words in classes and ids of parts that are no main text.
BLOCKS = frozenset(
    "address article aside blockquote body br button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td template "
    "tfoot th thead title tr ul video".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("nav footer aside form dialog menu select button template noscript svg object audio video canvas map datalist".split())
#: Parts that lie between texts rather than inside one.
APART = frozenset("nav header footer aside".split())
#: Elements whose end tags are often left out, or that only mark words.
LOOSE = frozenset("p li dt dd tr td th thead tbody tfoot option optgroup a b i em strong span font u s small".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog form menu menubar".split())
PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription paywall menu nav navbar navigation breadcrumb breadcrumbs pagination pager sidebar aside masthead "
    "topbar toolbar footer share sharing social related recommended recommendations widget login signup search skip".split()
)
REPLIES = frozenset("comment comments commentlist disqus replies respond discussion".split())

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/<>]*)((?:"[^"]*"|'[^']*'|[^<>"'])*+)>|</?[A-Za-z][^<>]*(?:>|(?=<)|\Z)""", re.DOTALL
)
ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"']+))?""")
WORD = re.compile(r"[a-z]+")


def _unwanted(tag: str, attributes: str, in_article: bool) -> str:
    """Why an element is not main text: "part", "replies", or nothing."""
    if tag in DROPPED or tag == "header" and not in_article:
        return "part"
    if not attributes:
        return ""
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            for words in map(WORD.findall, value.split()):
                # The page as a whole is no part of itself, and "no-sidebar" names no sidebar.
                if tag in ("main", "body", "html") or not words or words[0] in ("no", "has", "with", "without"):
                    continue
                if not REPLIES.isdisjoint(words):
                    return "replies"
                if tag != "article" and not (PARTS if in_article else PARTS | {"header"}).isdisjoint(words):
                    return "part"
        elif name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return "part"
        elif name == "style" and re.search(r"display\s*:\s*none", value):
            return "part"
    return ""


class _Lines:
    """The lines of a page: (text, characters outside links, lies in an article, lies in main)."""

    def __init__(self) -> None:
        self.lines: list[tuple[str, int, bool, bool]] = []
        self.text: list[str] = []
        self.unlinked = 0
        #: Open elements, (tag, why it is unwanted), and for each tag the places where it is open.
        self.open: list[tuple[str, str]] = []
        self.places: dict[str, list[int]] = {}
        self.unwanted = self.lasting = self.links = 0

    def is_in(self, tag: str) -> bool:
        return bool(self.places.get(tag))

    def add(self, text: str) -> None:
        if not self.unwanted:
            text = html.unescape(text)
            self.text.append(text)
            if not self.links:
                self.unlinked += len(text) - text.count(" ")

    def end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.unlinked, self.is_in("article"), self.is_in("main")))
        self.text, self.unlinked = [], 0

    def push(self, tag: str, why: str) -> None:
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, why))
        self.unwanted += why != ""
        self.lasting += why == "replies" or tag == "aside"

    def pop(self) -> None:
        tag, why = self.open.pop()
        self.places[tag].pop()
        self.unwanted -= why != ""
        self.lasting -= why == "replies" or tag == "aside"

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self.end_line()
            # A paragraph ends where a block begins, an item or a cell where its next one does.
            if self.open and self.open[-1][0] in ({"p", tag} if tag in LOOSE else {"p"}):
                self.pop()
        if tag in VOID:
            return
        if tag in ("article", "main", "body"):
            # What was left open and is no place of comments or asides ends here.
            while self.unwanted and not self.lasting:
                self.pop()
        if tag == "a":
            self.links = 1
        if tag in LOOSE and (self.unwanted or not attributes):
            return
        why = _unwanted(tag, attributes, self.is_in("article"))
        if tag in LOOSE and not why:
            return
        if tag in APART and why and not self.unwanted:
            self.end_line()
            self.lines += [("", 0, False, False)] * WINDOW
        self.push(tag, why)

    def end(self, tag: str) -> None:
        if tag in BLOCKS:
            self.end_line()
        if tag == "a":
            self.links = 0
        # An end tag closes the nearest element of its name, and all that was left open inside; one without a start does nothing.
        if places := self.places.get(tag):
            depth = places[-1]
            while len(self.open) > depth:
                self.pop()


def lines_of(page: str) -> list[tuple[str, int, bool, bool]]:
    found, at = _Lines(), 0
    while token := TOKEN.search(page, at):
        if token.start() > at:
            found.add(page[at : token.start()])
        at = token.end()
        if not (tag := (token[2] or "").lower()):
            continue
        if token[1]:
            found.end(tag)
        elif tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.IGNORECASE).search(page, at)
            at = close.end()
            found.end_line()
        else:
            found.start(tag, token[3])
    found.add(page[at:])
    found.end_line()
    return found.lines


def article_text(page: str | None) -> str:
    """The main text: lines between surges and dives of the sums over windows of lines."""
    lines = lines_of(page or "")
    marked = 2 if any(x[2] for x in lines) else 3 if any(x[3] for x in lines) else 0
    if marked:
        lines = [x if x[marked] else ("", 0, False, False) for x in lines]
        lengths = [len(x[0]) for x in lines]
    else:
        lengths = [x[1] for x in lines]
    before = [0]
    for n in lengths:
        before.append(before[-1] + n)
    sums = [before[min(i + WINDOW, len(lengths))] - before[i] for i in range(len(lengths))]
    least = 1 if marked else min(SURGE, max(sums, default=0) / 2)
    kept: list[str] = []
    i = 0
    while i < len(sums):
        if not sums[i]:
            i += 1
            continue
        first = i
        while i < len(sums) and sums[i]:
            i += 1
        # sums[first:i] lie between a surge and a dive; the window of the last one reaches no text beyond.
        if max(sums[first:i]) >= least:
            held = [k for k in range(first, i) if lengths[k]]
            kept += [x[0] for x in lines[held[0] : held[-1] + 1] if x[0]]
    return " ".join(kept)


def extracted(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, text, n_chars) for each page."""
    small_batches(pages.sparkSession)
    ids = pages.schema["page_id"].dataType.simpleString()

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [article_text(page) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(texts, f"page_id {ids}, url string, text string, n_chars long")
