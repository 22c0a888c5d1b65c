"""HTML extraction by text-to-tag ratios.

The standard library's parser streams events; block-level tags end a line. Lines under elements that never hold an
article's text (menus, forms, scripts, ...), by tag name, role, class or id, are marked. A name counts if all its words
say so (`site-footer`, but not `has-sidebar`). Such a name, and a form, may also be around the whole page: an article or
main element inside lifts its mark, and so does nearly all of the page's text being in it; other marks (scripts, menus,
comments, what is hidden) are never lifted. Every line
has a ratio of text outside links to tags, marked lines have 0; the ratios are smoothed with a Gaussian, a threshold (the
deviation of the smoothed ratios) clusters the lines into content and the rest, and neighbouring content lines form
regions. A region inside an article element or a container named as one is widened to the outermost of these, with its
short lines; what regions of one container hold is added up. Containers and regions outside of any that have a good
part (REGION_SHARE) of the heaviest one's mass are taken, each with the headings just before it, and what lies between
them. Marked lines are in no case part of the text.

A block's white space becomes one blank and its ends are trimmed; blocks without text are left out; blocks are joined
by line ends in page order.

Nulls: null or empty html has empty text; a null id or url stays null. Repeated pages give a row each. A page without
tags is one block. Unclosed elements end with their parent; stray end tags are passed over. A page is worked on alone;
memory follows the longest page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketpulse.llm import frames

SIGMA = 1.0
REGION_SHARE = 0.5
WRAPPER_SHARE = 0.8

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary"
    " table tbody td tfoot th thead tr ul".split()
)
#: Elements that hold no article text.
DROPPED = frozenset(
    "aside audio button canvas datalist dialog fieldset footer form head header iframe input label map menu meter nav"
    " noembed noframes noscript object optgroup option output progress script search select style svg template textarea"
    " title video".split()
)
#: Words of a class, an id or a role that say the same.
DROPPED_WORDS = frozenset(
    "ad ads adslot adsense advert adverts advertise advertisement advertising alert banner breadcrumb breadcrumbs byline"
    " comment commentlist comments consent contentinfo cookie cookies copyright dialog disclaimer discussion disqus"
    " dropdown feedback footer form gdpr hidden login masthead menu menubar modal nav navbar navigation newsletter notice"
    " notices notification pager pagination paywall popup promo promoted promotion recommended related reply replies"
    " respond responses search share sharing sidebar sidebars signup skip social sponsor sponsored sponsors subscribe"
    " subscription teaser toc toolbar tooltip widget widgets".split()
)
#: Words that may stand beside them in a name.
NEUTRAL_WORDS = frozenset(
    "area bar block bottom box button buttons container content fixed global group holder inner item items left link"
    " links list main module outer overlay page panel posts primary right row secondary section side site stories text"
    " top wrap wrapper".split()
)
#: Words that name what readers wrote; with these a name is never lifted.
COMMENT_WORDS = frozenset("comment commentlist comments discussion disqus feedback replies reply respond responses".split())
#: Words that name a container of the article, as article and main elements do.
CONTAINER_WORDS = frozenset("article articlebody content entry main maincontent post story".split())
_KEPT_TAGS = frozenset(("html", "body", "main", "article"))
_NAMED = frozenset(("div", "section", "td"))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option"}
#: An element that ends an open one of these, looked for up to the nearest of the boundaries.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"tr"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
_WORDS = re.compile(r"[a-z0-9]+")


@dataclass
class Line:
    text: str
    tags: int
    linked: int  # characters inside links
    marked: bool
    wrappers: tuple[int, ...]  # marked elements it is in, whose marks may be lifted
    container: int  # the outermost article element or named container it is in, or 0
    heading: bool


@dataclass
class _Open:
    tag: str
    marked: bool
    wrappers: tuple[int, ...]
    container: int
    heading: bool


class _Lines(HTMLParser):
    """Collects the lines of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.stack = [_Open("", False, (), 0, False)]
        self.wrappers = 0
        self.open: dict[str, int] = {}
        self.parts: list[str] = []
        self.tags = 0
        self.linked = 0
        self.names = 0

    def _end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts.clear()
        if text:
            top = self.stack[-1]
            self.lines.append(Line(text, self.tags, self.linked, top.marked, top.wrappers, top.container, top.heading))
            self.tags = 0
        self.linked = 0

    def _pop(self, size: int) -> None:
        """Close elements down to `size` open ones."""
        below = self.stack[size - 1]
        if any(o.tag in BLOCK or (o.marked, o.wrappers) != (below.marked, below.wrappers) for o in self.stack[size:]):
            self._end_line()
        for closed in self.stack[size:]:
            self.open[closed.tag] -= 1
        del self.stack[size:]

    def _close(self, tags: set[str] | frozenset[str], until: set[str] | frozenset[str]) -> None:
        if any(self.open.get(t) for t in tags):
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].tag in tags:
                    return self._pop(k)
                if self.stack[k].tag in until:
                    return None
        return None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCK:
            if tag in _CLOSES_P:
                self._close({"p"}, BLOCK - {"p"})
            if tag in _CLOSES:
                self._close(*_CLOSES[tag])
            self._end_line()
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        top = self.stack[-1]
        values = dict(attrs)
        tokens = " ".join(values.get(k) or "" for k in ("class", "id", "role", "itemprop")).lower().split()
        named = [set(_WORDS.findall(t)) for t in tokens]
        found = set().union(*named)
        said = [n for n in named if not n.isdisjoint(DROPPED_WORDS) and n <= DROPPED_WORDS | NEUTRAL_WORDS]
        style = (values.get("style") or "").replace(" ", "").lower()
        unseen = "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in style
        by_readers = any(not n.isdisjoint(COMMENT_WORDS) for n in said)
        kept = tag in _KEPT_TAGS and not by_readers
        marked = top.marked or unseen or by_readers or (tag in DROPPED and tag != "form")
        wrappers = () if tag in ("article", "main") else top.wrappers
        if not marked and (tag == "form" or (said and not kept)):
            self.wrappers += 1
            wrappers = (*wrappers, self.wrappers)
        container = top.container
        names = tag in ("article", "main") or (tag in _NAMED and not found.isdisjoint(CONTAINER_WORDS))
        if names and not marked and not wrappers and not container:
            self.names += 1
            container = self.names
        if (marked, wrappers) != (top.marked, top.wrappers):
            self._end_line()
        heading = tag in _HEADINGS or (top.heading and tag not in BLOCK)
        self.stack.append(_Open(tag, marked, wrappers, container, heading))
        self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "script", "iframe"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            return
        if self.open.get(tag):
            inline = tag not in BLOCK and tag not in DROPPED
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].tag == tag:
                    return self._pop(k)
                if inline and self.stack[k].tag in BLOCK:
                    return None
        if tag == "p":
            self._end_line()
        return None

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if self.open.get("a"):
            self.linked += len(data)

    def updatepos(self, i: int, j: int) -> int:
        return j  # places in the page are not asked for

    def close(self) -> None:
        if self.rawdata.startswith("<!--"):  # a comment that never ends takes the rest of the page
            self.rawdata = ""
        super().close()
        self._pop(1)
        self._end_line()


def lines(html: str) -> list[Line]:
    parser = _Lines()
    parser.feed(html)
    parser.close()
    lift(parser.lines)
    return parser.lines


def lift(found: list[Line]) -> None:
    """Marks the lines of wrappers, but for those that hold nearly all of the page's text outside links.

    None does where an article or a named container has text of its own outside of wrappers.
    """
    size = [max(0, len(x.text) - x.linked) for x in found]
    total = sum(n for n, x in zip(size, found, strict=True) if not x.marked)
    held: dict[int, int] = {}
    for n, x in zip(size, found, strict=True):
        if not x.marked and x.wrappers:
            held[x.wrappers[-1]] = held.get(x.wrappers[-1], 0) + n
    apart = any(x.container and not x.marked and not x.wrappers for x in found)
    main = {w for w, n in held.items() if n > WRAPPER_SHARE * total and not apart}
    for x in found:  # what is around such a wrapper is lifted with it
        lifted = max((k for k, w in enumerate(x.wrappers) if w in main), default=-1)
        x.marked = x.marked or lifted + 1 < len(x.wrappers)


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian means over neighbours; the kernel is cut at the ends and made to sum to 1 there."""
    reach = max(1, round(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weights = np.convolve(np.ones(len(values)), kernel)[reach:-reach]
    return np.convolve(values, kernel)[reach:-reach] / weights


def select(found: list[Line]) -> list[str]:
    """Texts of the lines that belong to the page's content."""
    if all(line.marked for line in found):
        return []
    ratio = np.array([0.0 if x.marked else max(0, len(x.text) - x.linked) / max(1, x.tags) for x in found])
    smoothed = smooth(ratio)
    content = (smoothed >= min(smoothed.std(), smoothed.max())) & (ratio > 0)
    mass = np.where(content, smoothed * [len(x.text) for x in found], 0.0)
    names = np.array([x.container for x in found])
    edges = np.flatnonzero(np.diff(np.concatenate([[0], content, [0]])) | np.diff(names, prepend=0, append=0))
    sides = np.flatnonzero(np.diff(names, prepend=0, append=0)).tolist()
    spans = {int(names[a]): (a, b) for a, b in zip(sides[:-1], sides[1:], strict=True)}  # containers are in one piece
    held: dict[tuple[int, int], float] = {}  # masses of containers, or of regions outside of any, by their lines
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if content[a]:
            span = spans[int(names[a])] if names[a] else (a, b)
            held[span] = held.get(span, 0.0) + float(mass[a:b].sum())
    heaviest = max(held.values(), default=0.0)
    chosen: set[int] = set()
    for (a, b), own in held.items():
        if own >= REGION_SHARE * heaviest:
            chosen.update(range(a, b))
            name = names[a]
            while a > 0 and found[a - 1].heading and not found[a - 1].marked and found[a - 1].container in (0, name):
                a -= 1
                chosen.add(a)
    low, high = min(chosen, default=0), max(chosen, default=-1)
    return [x.text for k, x in enumerate(found) if not x.marked and (k in chosen or low <= k <= high)]


def main_text(html: str | None) -> str:
    return "\n".join(select(lines(html))) if html else ""


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in frames.slices(batches, "html"):
        found = pa.array([main_text(h) for h in batch.column("html").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), found], ["page_id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text (the main text) and n_chars of each page."""
    frames.ship(pages.sparkSession)
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    kinds = dict(rows.dtypes)
    found = rows.mapInArrow(_run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
