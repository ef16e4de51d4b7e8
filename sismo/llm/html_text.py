"""Main text of web pages by text-to-tag ratios (operator 9).

The standard library's parser streams events; they become lines (the text of
one block-level stretch) with the number of tags met and of characters
inside links. The ratio of text to tags is smoothed with a Gaussian and split
into two clusters; the upper one marks content regions.

Names are evidence of what is no content (menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, reader comments): an element's own
name or role, and its class or id when a word of ``WORDS`` ends a name or
stands before one of ``PARTS``, mark it; such a word anywhere else in a name
(``comment-body``, ``sidebar-left``) marks it unless the element turns out to
hold nearly all the text of the page. with-, has- or no- such a word says
nothing, nor does a mark around a main element or the page's only articles.

The answer is every unmarked line of the element that holds the regions: the
article or main elements if most of them lie there, else the innermost
container around all of them and all lines whose own ratio reaches the upper
cluster, be it the whole page; so headlines and short lines before, between
and after long ones stay. Inside it, blocks wholly in the lower cluster whose
text is mostly links (three lines or more) go. Only where it is the whole page,
elements of links before the first and after the last region count as menus.

Map-only; a page is parsed in pieces, only its text and a few numbers a block
are held, and time grows with its length however deeply elements nest.

Defined results: null or empty html gives an empty text; repeated rows each
get their own equal row; an empty table gives an empty result; other columns
are ignored; a page cut short keeps what was read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SIGMA = 1.5
PIECE = 1 << 16
MOST_LINKS = 0.5  # share of a content line's characters inside links
LEAST_LIST = 3    # lines of a list of links
WRAPPED = 0.25    # free text beside a wrapper of doubtful name, as a share of its own

# Element and attribute names.
SILENT = {"script", "style", "noscript", "template", "svg", "math", "head", "title", "iframe", "object", "canvas", "audio", "video"}
ASIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "textarea", "fieldset", "datalist"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img",
          "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
          "time", "tt", "u", "var", "wbr", "input"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
            "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
            "option": {"option"}}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "form"}
WORDS = {"ad", "ads", "adbox", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promoted",
         "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "footer", "masthead", "sidebar",
         "aside", "widget", "cookie", "cookies", "consent", "gdpr", "notice", "notification", "popup", "modal", "overlay", "newsletter",
         "subscribe", "signup", "login", "comment", "comments", "commentlist", "disqus", "respond", "reply", "replies", "share", "sharing",
         "social", "related", "recommended", "toolbar", "skip"}
TALK = {"comment", "comments", "commentlist", "disqus", "respond", "reply", "replies"}  # of readers: may hold articles of their own
PARTS = {"area", "box", "form", "items", "links", "list", "posts"}  # may follow a name of WORDS
NOT = {"with", "has", "no", "without", "not", "non"}
FREE = {"free", "less", "off", "disabled"}
NO_CONTAINER = {"p", "li", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "tr", "td", "th", "tbody", "thead",
                "caption", "figcaption", "address", "summary"}
_WORD = re.compile("[a-z0-9]+")


def said(names: str) -> tuple[bool, bool, bool, bool]:
    """What class or id names say of their element: (surely no content,
    perhaps none, a header, talk of readers). Sure: the last word of a name, or
    the one before a word of PARTS, is one of WORDS. Perhaps: any word is. A
    name with a word of NOT before that word, or of FREE after it, says
    nothing."""
    sure = perhaps = header = talk = False
    for name in names.split():
        words = _WORD.findall(name)
        at = [i for i, w in enumerate(words) if w in WORDS and not NOT.intersection(words[:i]) and not FREE.intersection(words[i:])]
        perhaps |= bool(at)
        talk |= any(words[i] in TALK for i in at)
        if len(words) > 1 and words[-1] in PARTS:
            words.pop()
        sure |= len(words) - 1 in at
        header |= bool(words) and words[-1] == "header" and not NOT.intersection(words)
    return sure, perhaps, header, talk


@dataclass
class Line:
    """Text of one block stretch; ``block`` and ``mark`` number the innermost
    open block and the innermost open element that looks like no content."""
    text: str
    tags: int
    linked: int
    block: int
    mark: int


@dataclass(eq=False)
class _Open:
    name: str
    number: int = -1  # of a block
    mark: int = -1    # of an element that looks like no content
    inline: list[_Open] = field(default_factory=list)
    closed: bool = False


@dataclass
class Lines(HTMLParser):
    """Collects the lines of a page from parser events. Every event costs a
    constant time and every open element a constant size, however deep."""
    lines: list[Line] = field(default_factory=list)
    kinds: list[str] = field(default_factory=list)     # name of each block
    parents: list[int] = field(default_factory=list)   # block around each block
    #: elements that look like no content: around it, sure?, talk?
    marks: list[tuple[int, bool, bool]] = field(default_factory=list)
    mains: list[tuple[str, int, int]] = field(default_factory=list)  # name, block and mark of article and main

    def __post_init__(self):
        HTMLParser.__init__(self, convert_charrefs=True)
        self.blocks = [_Open("")]  # open blocks, a root below all
        self.named: dict[str, list[_Open]] = {}  # open elements by name
        self.marked: list[_Open] = []
        self.parts: list[str] = []
        self.tags = self.linked = self.silent = 0

    __hash__ = object.__hash__

    def count(self, *names):
        return sum(len(self.named.get(n, ())) for n in names)

    def mark(self):
        while self.marked and self.marked[-1].closed:
            self.marked.pop()
        return self.marked[-1].mark if self.marked else -1

    def flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append(Line(text, self.tags, self.linked, self.blocks[-1].number, self.mark()))
            self.tags = 0
        self.parts, self.linked = [], 0

    def _looks(self, name, attrs):
        """(looks like no content, surely, talk of readers)."""
        if name in ASIDE:
            return True, True, False
        inside = self.count("article", "main") > 0
        if name == "header":
            return not inside, True, False
        if name in ("html", "body", "article", "main"):
            return False, False, False
        a = {k: (v or "").lower() for k, v in attrs}
        if a.get("role") in ROLES or "hidden" in a or a.get("aria-hidden") == "true":
            return True, True, False
        sure, perhaps, header, talk = said(a.get("class", "") + " " + a.get("id", ""))
        sure |= header and not inside
        return sure or perhaps, sure, talk

    def handle_starttag(self, name, attrs):
        self.tags += 1
        if name in ("body", "main", "article") and self.silent:
            while self.silent:  # an element of the head that was never closed
                self._close_block()
        if name in CLOSES_P:
            self._close_sibling({"p"})
        if name in SIBLINGS:
            self._close_sibling(SIBLINGS[name])
        block = name not in INLINE
        if block:
            self.flush()
        if name == "br":
            self.parts.append(" ")
        if name in VOID:
            return
        if name == "a" and self.named.get("a"):  # anchors do not nest
            self._close(self.named["a"][-1])
        o = _Open(name)
        if name in ("article", "main"):
            self.mains.append((name, len(self.kinds), self.mark()))
        looks, sure, talk = self._looks(name, attrs)
        if looks:
            o.mark = len(self.marks)
            self.marks.append((self.mark(), sure, talk))
            self.marked.append(o)
        if block:
            o.number = len(self.kinds)
            self.kinds.append(name)
            self.parents.append(self.blocks[-1].number)
            self.blocks.append(o)
            self.silent += name in SILENT
        else:
            self.blocks[-1].inline.append(o)
        self.named.setdefault(name, []).append(o)

    def _close_sibling(self, names):
        at = len(self.blocks) - 1
        while self.blocks[at].name in ("tbody", "thead") and self.blocks[at].name not in names:
            at -= 1
        if self.blocks[at].name in names:
            while len(self.blocks) > at:
                self._close_block()

    def _close_block(self):
        self.flush()
        o = self.blocks.pop()
        for x in reversed(o.inline):
            if not x.closed:
                self._close(x)
        self._close(o)
        self.silent -= o.name in SILENT

    def _close(self, o):
        o.closed = True
        self.named[o.name].pop()  # what is closed is the last one open of its name

    def handle_endtag(self, name):
        self.tags += 1
        if self.named.get(name):
            o = self.named[name][-1]
            if o.number < 0:
                self._close(o)
                return
            while not o.closed:
                self._close_block()
        elif name not in INLINE:
            self.flush()

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)
            if self.named.get("a"):
                self.linked += len(data)


class Page:
    """Lines of a page and sums over its tree of blocks, in which every block
    has a larger number than the one around it."""

    def __init__(self, p: Lines):
        self.lines, self.kinds, self.parents = p.lines, p.kinds, p.parents
        self.marks, self.mains = p.marks, p.mains
        self.aside = [True] * len(p.marks)
        self._settle()

    def below(self, chosen) -> list[bool]:
        """For each block, whether it or one around it is ``chosen``."""
        out = []
        for n, up in enumerate(self.parents):
            out.append(bool(chosen(n)) or (up >= 0 and out[up]))
        return out

    def sums(self, values) -> list[float]:
        """Per block, the sum of its lines' values."""
        out = [0.0] * len(self.kinds)
        for x, v in zip(self.lines, values):
            if x.block >= 0:
                out[x.block] += v
        for n in range(len(out) - 1, -1, -1):
            if self.parents[n] >= 0:
                out[self.parents[n]] += out[n]
        return out

    def hidden(self) -> list[bool]:
        """For each mark, whether it or one around it stands."""
        out = []
        for n, (up, _, _) in enumerate(self.marks):
            out.append(self.aside[n] or (up >= 0 and out[up]))
        return out

    def _around(self, mark):
        while mark >= 0:
            yield mark
            mark = self.marks[mark][0]

    def _settle(self):
        """Takes back marks: those around a main element; those around articles
        when no article or main lies elsewhere and most text is in these; and
        doubtful ones around nearly all text that no mark hides."""
        done = set()
        for name, _, mark in self.mains:
            for m in self._around(mark) if name == "main" else ():
                if m in done:
                    break
                done.add(m)
                self.aside[m] = False
        hidden = self.hidden()
        if self.mains and all(mark >= 0 and hidden[mark] for _, _, mark in self.mains):
            numbers = {n for _, n, _ in self.mains}
            inside = self.below(numbers.__contains__)
            free = sum(len(x.text) for x in self.lines if x.mark < 0 or not hidden[x.mark])
            held = sum(len(x.text) for x in self.lines if x.block >= 0 and inside[x.block])
            if held > free:
                for _, _, mark in self.mains:
                    chain = list(self._around(mark))
                    if free == 0 or not any(self.marks[m][2] for m in chain):
                        for m in chain:
                            self.aside[m] = False
        self._take_back_doubtful()

    def _take_back_doubtful(self):
        held = [0] * len(self.marks)
        hidden = self.hidden()
        free = sum(len(x.text) for x in self.lines if x.mark < 0 or not hidden[x.mark])
        for x in self.lines:
            if x.mark >= 0:
                held[x.mark] += len(x.text)
        for n in range(len(held) - 1, -1, -1):  # text that only doubtful marks inside may hide
            up, sure, _ = self.marks[n]
            if up >= 0 and not (sure and self.aside[n]):
                held[up] += held[n]
        for n, (up, sure, talk) in enumerate(self.marks):
            if self.aside[n] and not sure and (up < 0 or not hidden[up] or not self.aside[up]) and free <= (0 if talk else WRAPPED * held[n]):
                self.aside[n] = False


def read_lines(html: str) -> Page:
    cut = html.rfind("<")
    if cut >= 0 and ">" not in html[cut:] and re.match("<[a-zA-Z/!?]", html[cut:cut + 2]):
        html = html[:cut]  # a tag that the page's end cuts off
    p = Lines()
    for i in range(0, len(html), PIECE):
        p.feed(html[i:i + PIECE])
    p.close()
    p.flush()
    return Page(p)


def smoothed(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(3 * sigma) + 1
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratio)), kernel)[reach:reach + len(ratio)]
    return np.convolve(ratio, kernel)[reach:reach + len(ratio)] / weight


def threshold(values: np.ndarray) -> float:
    """Midpoint of two cluster means, moved until it settles."""
    t = float(values.mean())
    for _ in range(100):
        low, high = values[values < t], values[values >= t]
        if len(low) == 0 or len(high) == 0:
            return t
        new = (low.mean() + high.mean()) / 2
        if abs(new - t) < 1e-9:
            return t
        t = float(new)
    return t


def main_text(html: str | None) -> str:
    """Main text of one page: its content lines in order, joined by \\n."""
    if not html:
        return ""
    page = read_lines(html)
    hidden = page.hidden()
    page.lines = lines = [x for x in page.lines if x.mark < 0 or not hidden[x.mark]]
    if not lines:
        return ""
    size = np.array([len(x.text) for x in lines], float)
    linked = np.array([x.linked for x in lines], float)
    own = size / np.array([max(1, x.tags) for x in lines])
    ratio = smoothed(own)
    chosen = (ratio >= threshold(ratio)) & (linked <= MOST_LINKS * size)
    if not chosen.any():
        chosen = ratio >= threshold(ratio)
    weight = np.where(chosen, size, 0)
    held = page.sums(weight)
    inside = page.below(lambda n: page.kinds[n] in ("article", "main") and held[n] > 0)
    here = np.array([x.block >= 0 and inside[x.block] for x in lines])
    # a line as dense as a region is one also where its neighbours are not
    dense = (own >= threshold(ratio)) & (linked <= MOST_LINKS * size)
    if here.any() and weight[here].sum() >= 0.5 * weight.sum():
        roots, region = -1, here
    else:
        found = page.sums(chosen | dense)
        every = [n for n in range(len(found)) if found[n] == (chosen | dense).sum()]
        roots = max(every, default=-1)  # the innermost block around all regions
        while roots >= 0 and page.kinds[roots] in NO_CONTAINER:
            roots = page.parents[roots]
        if roots >= 0 and page.kinds[roots] not in ("html", "body"):
            inner = page.below(lambda n: n == roots)
            region = np.array([x.block >= 0 and inner[x.block] for x in lines])
        else:
            region = _no_menus(page, roots, np.flatnonzero(chosen | dense), size, linked)
    gone = region & _link_lists(page, dense, size, linked)
    if size[gone].sum() <= MOST_LINKS * size[region].sum():  # else an anchor was never closed
        region = region & ~gone
    return "\n".join(x.text for x, stays in zip(lines, region) if stays)


def _link_lists(page: Page, dense: np.ndarray, size: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """Lines of blocks none of whose lines is ``dense`` itself, which hold
    LEAST_LIST lines or more and whose text is mostly links."""
    text, links, high, n = (page.sums(v) for v in (size, linked, dense, np.ones(len(size))))
    gone = page.below(lambda b: n[b] >= LEAST_LIST and high[b] == 0 and links[b] > MOST_LINKS * text[b])
    return np.array([x.block >= 0 and gone[x.block] for x in page.lines])


def _no_menus(page: Page, root: int, at: np.ndarray, size: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """Which lines of a whole page stay: all but those outside the regions
    (line numbers ``at``) in a block below the root, wholly outside, with most
    text inside links."""
    text, links = page.sums(size), page.sums(linked)
    far = np.ones(len(size))
    far[at[0]:at[-1] + 1] = 0
    out, n = page.sums(far), page.sums(np.ones(len(size)))
    gone = page.below(lambda b: page.parents[b] == root and out[b] == n[b] and links[b] > MOST_LINKS * text[b])
    return np.array([x.block < 0 or not gone[x.block] for x in page.lines])


def _extract(batches):
    for batch in batches:
        for a in range(0, len(batch), 256):
            part = batch.slice(a, 256)
            texts = [main_text(h) for h in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text,
    n_chars (code points)."""
    return pages.select("page_id", "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
