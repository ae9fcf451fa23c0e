"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams events; they become lines, one for each block of text, with the
tags met on the way, the text inside links, and the elements that hold the line. A line's ratio is
its characters outside links over its tags. Ratios are smoothed along the page with a Gaussian, and
lines above a threshold (the smoothed ratios' standard deviation, or a share of their largest) form
clusters. The content region is the element that agrees best with the clusters: twice the clustered
characters that it holds, over all clustered characters and all characters that it holds; the
innermost of equals. Names are secondary: an ``article`` or ``main`` gets a bonus, and what is marked as
menus, headers, footers, sidebars, notices, adverts, forms, or comments neither counts nor is kept,
unless the clusters say otherwise: a mark under which most of the clustered text stands (a form around the page,
widget containers) tells nothing there and is passed over.

A page's short paragraphs lie in the region like its long ones, so all of the region's lines are
kept; from a region without a telling name, leading and trailing containers that hold no clustered
line go.

Each page is parsed by itself in the task that reads it, in time that grows with its length, however
deep its elements are nested and whatever tags are left unfinished.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brandweave.llm.common import small_batches, table

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that hold no page text at all, and the controls of forms.
SILENT = frozenset("head script style noscript template svg math iframe object canvas audio video map datalist".split())
CONTROLS = frozenset("button select textarea input".split())
#: Elements that mark what they hold by their name.
WRAPPERS = frozenset("aside form fieldset dialog search label nav footer menu".split())
DROPPED = SILENT | CONTROLS | WRAPPERS
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end an open paragraph, and elements that a new one of the same kind ends.
ENDS_P = BLOCKS - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "optgroup", "option"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
#: Words of class, id and role that mark what is not the article.
MARKS = re.compile(
    r"^(?:ads?|advert(?:isement|isements|s|ising)?|adsense|adslot|banner|sponsor(?:ed|s)?|promo(?:tion|s)?|nav|navbar|navigation|menus?|breadcrumbs?|sidebars?|side|aside|complementary|footer|foot|contentinfo|masthead|topbar|toolbar"
    r"|cookies?|consent|gdpr|notices?|notifications?|alerts?|popups?|modals?|overlays?|newsletter|subscribe|subscription|signup|login|comments?|disqus|replies|respond|threads?|discussions?|reactions?|share|sharing|social|related|recommend(?:ed|ations?)?|widgets?|pagination|pager|search|skip|hidden|copyright|legal|form)$"
)
#: Words that may stand beside them in a name; with any other word (share-prices, legal-news) a name
#: marks nothing.
NEUTRAL = frozenset(
    "site page post posts entry area block box bar wrap wrapper container inner outer section panel list lists item items link links button buttons group row col column left right top bottom primary secondary global header head title user users blog web module component region zone slot unit trail icon icons media google inline fixed sticky desktop mobile small large".split()
)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
SPACE = re.compile(r"\s+")
#: What begins a tag, or what is read as a comment. Without a '>' behind it, it takes the rest of the page.
OPENS = re.compile(r"<(?:[A-Za-z!?]|/[^>])")
#: A comment's end after its '<!--': at once, or where browsers end it.
COMMENT_END = re.compile(r"-?>|.*?--!?>", re.DOTALL)


#: A name with one of these words tells of a layout, such as has-sidebar, not of the part itself.
ABOUT = frozenset("has no with without layout enabled is".split())


#: The share of the clusters' characters outside links that must stand under a mark for it to be passed
#: over: half, more for words that seldom name wrappers, and nearly all for discussions, which are
#: often longer than the article, and for menus and footers.
SHARE, LOUD_SHARE, TALK_SHARE = 0.5, 0.75, 0.95
TALK = re.compile(r"^(?:<nav>|<footer>|<menu>|comments?|disqus|replies|respond|threads?|discussions?|reactions?)$")
LOUD = re.compile(
    r"^(?:<aside>|<dialog>|<header>|ad.*|banner|sponsor.*|nav.*|menus?|breadcrumbs?|sidebars?|foot.*|contentinfo|cookies?|consent|gdpr|newsletter|subscri.*|signup|login|related|recommend.*|pagination|pager|copyright|legal)$"
)
#: An article or main element with this share of the page in unmarked text, and with more of it than
#: it holds under a mark, keeps that mark.
ARTICLE_SHARE = 0.2
NAMED = ("article", "main")
#: What the agreement of an article or main element with the clusters is multiplied by.
NAMED_BONUS = 1.2
#: The share of the best agreement from which an element counts as good as the best.
CLOSE = 0.95
#: Elements that are single blocks of text, not regions.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr caption figcaption".split())
#: Leading and trailing containers of a region that go if no clustered line is in them.
CONTAINERS = frozenset("div section header hgroup table form fieldset address details center".split())


def _marked(token: str) -> set[str]:
    """The words of a name that mark what is not the article; none if the name has other words."""
    words = [w.lower() for w in WORDS.findall(token)]
    found = {w for w in words if MARKS.match(w)}
    return found if not ABOUT.intersection(words) and all(w in found or w in NEUTRAL or w.isdigit() for w in words) else set()


class _Element:
    __slots__ = ("tag", "parent", "silent", "marks", "depth", "holder", "named", "votes", "size", "first", "last")

    def __init__(self, tag: str, parent: "_Element | None", silent: bool, marks: frozenset[str]):
        self.tag, self.parent, self.silent, self.marks = tag, parent, silent, marks
        self.depth = parent.depth + 1 if parent else 0
        # the nearest block, and the nearest article or main element, that holds the element or is it
        self.holder = self if tag in BLOCKS or parent is None else parent.holder
        self.named = self if tag in NAMED else parent.named if parent else None
        # clustered and all characters of the lines it keeps, and those lines' first and last numbers
        self.votes = self.size = 0.0
        self.first, self.last = None, -1

    @property
    def block(self) -> bool:
        return self.holder is self

    def like(self, other: "_Element") -> bool:
        """Whether the two are dropped for the same reasons."""
        return self.silent == other.silent and self.marks == other.marks


class _Lines(HTMLParser):
    """Lines of a page: (text, tags before and in it, characters in links, holder)."""

    #: Elements whose text holds no tags and no comments; charrefs are read in two of them.
    CDATA_CONTENT_ELEMENTS = ("script", "style", "title", "textarea", "iframe", "noscript", "noembed", "noframes", "xmp")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Element("", None, False, frozenset())
        self.elements = [self.root]
        self.open: dict[str, list[_Element]] = {}
        self.lines: list[tuple[str, int, int, _Element]] = []
        self.parts: list[str] = []
        self.tags = self.linked = self.links = 0
        self.holder = self.root

    def _end_line(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.lines.append((text, self.tags, self.linked, self.holder))
            self.tags = 0
        self.parts, self.linked = [], 0

    def _pop_to(self, element: _Element) -> None:
        """Closes the element and all that is open in it."""
        while self.at is not element.parent:
            if self.at.block or not self.at.like(self.at.parent):
                self._end_line()
            self.links -= self.at.tag == "a"
            self.open[self.at.tag].pop()
            self.at = self.at.parent

    def _open(self, tags, scope=frozenset()) -> _Element | None:
        """The innermost open element of these tags, if none of the scope's is open inside it."""
        inner = lambda names: max((self.open[n][-1] for n in names if self.open.get(n)), key=lambda e: e.depth, default=None)
        found, edge = inner(tags), inner(scope)
        return found if found and (edge is None or edge.depth < found.depth) else None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in ENDS_P and (p := self._open({"p"}, {"td", "th", "table", "button"})):
            self._pop_to(p)
        if tag in SIBLINGS and tag != "p" and (e := self._open(SIBLINGS[tag], SCOPES.get(tag, frozenset()))):
            self._pop_to(e)
        if tag in VOID:
            if tag in BLOCKS:
                self._end_line()
            elif tag == "br":
                self.parts.append(" ")
            return
        own = self._dropped(tag, attrs)
        made = _Element(tag, self.at, self.at.silent or own is None, self.at.marks | own if own else self.at.marks)
        if tag in BLOCKS or not made.like(self.at):
            self._end_line()
        self.at = made
        self.elements.append(made)
        self.open.setdefault(tag, []).append(made)
        self.links += tag == "a"
        if tag in ("script", "style"):
            self.tags += 1

    def _dropped(self, tag: str, attrs: list[tuple[str, str | None]]) -> set[str] | None:
        """The element's own marks; None if it is never content."""
        if tag in DROPPED and tag not in WRAPPERS:
            return None
        marks = {f"<{tag}>"} if tag in WRAPPERS else set()
        if tag == "header":
            # An article's own header, as opposed to the page's, is part of the article.
            return marks if self._open((*NAMED, "section")) else {"<header>"}
        if tag in ("html", "body", "main", "article"):
            own = dict(attrs)
            return {"comments"} if tag == "article" and re.search(r"(?i)\bcomment|\brepl(?:y|ies)\b", f"{own.get('class') or ''} {own.get('id') or ''}") else marks
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value or "", re.I):
                return None
            if name in ("class", "id", "role") and value:
                for token in value.split():
                    marks |= _marked(token)
        return marks

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        scope = {"td", "th"} if tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "body", "html") else frozenset()
        if e := self._open({tag}, scope):
            if tag not in BLOCKS and tag not in DROPPED and self.at.holder.depth > e.depth:
                return  # an inline end tag does not close blocks that are open in it
            self._pop_to(e)

    def parse_comment(self, i: int, report: int = 1) -> int:
        """The comment's end; an unfinished one takes the rest of the page, which is fed at once."""
        end = COMMENT_END.match(self.rawdata, i + 4)
        return end.end() if end else len(self.rawdata)

    def parse_html_declaration(self, i: int) -> int:
        """The end of a comment, or of what browsers read as one: doctypes, sections and the like."""
        return self.parse_comment(i) if self.rawdata.startswith("<!--", i) else self.parse_pi(i)

    def parse_pi(self, i: int) -> int:
        return self.rawdata.find(">", i + 2) + 1 or len(self.rawdata)

    def handle_data(self, data: str) -> None:
        if self.at.tag in SILENT:
            return
        if self.cdata_elem in ("title", "textarea"):
            data = unescape(data)
        if not self.parts:
            self.holder = self.at.holder if self.at.holder.like(self.at) else self.at
        self.parts.append(data)
        if self.links:
            self.linked += len(data)

    def done(self) -> list[tuple[str, int, int, _Element]]:
        self._end_line()
        return self.lines


def smoothed(ratios: np.ndarray, radius: int = 2) -> np.ndarray:
    """The ratios under a Gaussian of standard deviation ``radius``, with weights summing to 1 at the ends too."""
    at = np.arange(-2 * radius, 2 * radius + 1)
    kernel = np.exp(-(at**2) / (2 * radius**2))
    full = lambda x: np.convolve(x, kernel, mode="full")[2 * radius : 2 * radius + len(ratios)]
    return full(ratios) / full(np.ones(len(ratios)))


def ratios(lines) -> np.ndarray:
    """Each line's characters outside links over its tags."""
    return np.array([max(0, len(text) - linked) / max(1, tags) for text, tags, linked, _ in lines], dtype=float)


def clustered(smooth: np.ndarray) -> np.ndarray:
    """Whether each line's smoothed ratio is above the threshold."""
    return smooth >= min(smooth.std(), smooth.max() / 2) if smooth.max() > 0 else np.ones(len(smooth), dtype=bool)


def main_text(html: str | None, radius: int = 2) -> str:
    """The page's main text: blocks in page order, joined by a line feed; empty if there is none."""
    if not html:
        return ""
    parser = _Lines()
    cut = OPENS.search(html, html.rfind(">") + 1)
    parser.feed(html[: cut.start()] if cut else html)
    parser.close()
    lines = [line for line in parser.done() if not line[3].silent]
    if not lines:
        return ""
    chosen = clustered(smoothed(ratios(lines), radius))
    passed = _passed_over(lines, chosen.tolist(), parser.elements)
    kept = [(text, holder, max(0, len(text) - linked) if c else 0) for (text, _, linked, holder), c in zip(lines, chosen.tolist(), strict=True) if holder.marks <= passed]
    for i, (text, e, votes) in enumerate(kept):
        e.votes, e.size, e.last = e.votes + votes, e.size + len(text), i
        e.first = i if e.first is None else e.first
    for e in reversed(parser.elements[1:]):
        up = e.parent
        up.votes, up.size, up.last = up.votes + e.votes, up.size + e.size, max(up.last, e.last)
        if e.first is not None:
            up.first = e.first if up.first is None else min(up.first, e.first)
    region = _region(parser.elements)
    low, high = (region.first, region.last + 1) if region.first is not None else (0, 0)
    if region.tag not in NAMED:
        edges = {e.first: e.last for e in parser.elements if e.parent is region and e.first is not None and not e.votes and e.tag in CONTAINERS}
        ends = {last: first for first, last in edges.items()}
        while low in edges:
            low = edges[low] + 1
        while high - 1 in ends and high > low:
            high = ends[high - 1]
    # lines between an element's first and last are all inside it, since elements close in order
    return "\n".join(text for text, _, _ in kept[low:high])


def _region(elements: list[_Element]) -> _Element:
    """The innermost element that agrees with the clusters about as well as any; the root where no line
    is clustered."""
    root = elements[0]
    agreement = lambda e: 2 * e.votes / (root.votes + e.size) * (NAMED_BONUS if e.tag in NAMED else 1)
    found = [e for e in elements if e.votes and e.tag not in LEAVES and e.block]
    best = max(map(agreement, found), default=0)
    return max((e for e in found if agreement(e) >= CLOSE * best), key=lambda e: (e.depth, agreement(e)), default=root)


def _passed_over(lines, chosen: list[bool], elements: list[_Element]) -> set[str]:
    """Marks under which most of the clusters' characters outside links stand."""
    sizes = [max(0, len(text) - linked) if c else 0 for (text, _, linked, _), c in zip(lines, chosen, strict=True)]
    total, under = sum(sizes), {}
    for size, (_, _, _, e) in zip(sizes, lines, strict=True):
        for mark in e.marks:
            under[mark] = under.get(mark, 0) + size
    most = {m for m, n in under.items() if n > total * (TALK_SHARE if TALK.match(m) else LOUD_SHARE if LOUD.match(m) else SHARE)}
    if not most:
        return most
    # what article and main elements hold, in all and by mark, from the innermost outwards
    plain: dict[_Element, int] = {}
    held: dict[tuple[_Element, str], int] = {}
    for size, (_, _, _, e) in zip(sizes, lines, strict=True):
        if e.named:
            if not e.marks:
                plain[e.named] = plain.get(e.named, 0) + size
            for mark in e.marks & most:
                held[e.named, mark] = held.get((e.named, mark), 0) + size
    for e in reversed([e for e in elements if e.tag in NAMED]):
        if (up := e.parent.named) is not None:
            plain[up] = plain.get(up, 0) + plain.get(e, 0)
            for mark in most:
                if (e, mark) in held:
                    held[up, mark] = held.get((up, mark), 0) + held[e, mark]
    return {m for m in most if not any(n >= total * ARTICLE_SHARE and n > held.get((e, m), 0) for e, n in plain.items())}


def extract(pages: DataFrame, radius: int = 2) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    A null or empty page, or one without text, has an empty text. Repeated rows, repeated or null
    page_ids each give a row. Malformed markup is read as browsers do in the common cases: open
    paragraphs and list items end where the next begins, unmatched end tags are passed over, and an
    unfinished tag, declaration or comment takes the rest of the page, which is dropped. Depth of nesting is not limited. Comments end at '-->' or '--!>', and begin neither in
    attribute values nor in scripts, styles, titles and the like.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html, radius) for html in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return small_batches(pages).select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
