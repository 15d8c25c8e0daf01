"""Main text of HTML pages from streaming parser events.

The standard library's parser reports tags and text in page order; nothing is built but a
list of lines, one for each block of text, and the parent of each element. A line's
text-to-tag ratio is its characters over the tags met in it. What is known of tags weighs
the ratio: 0 in menus, footers, forms, comments and the like and for lists of links outside an
article, more inside an article. Words in a class or id weigh it to 0, too, unless the element
they stand on holds long prose, which outvotes them. Ratios are smoothed with a Gaussian over neighbouring lines. Lines whose own and
smoothed ratio are above a threshold (a share of the smoothed ratios' standard deviation)
cluster into regions, and the regions of most mass give the text: their lines of any positive
ratio, and such lines beside them in the same innermost element that holds the whole region
(short paragraphs at its ends), unless that element is the page itself.

Defined cases: null and empty html give an empty text; broken, nested and unclosed tags are
read as the parser reports them, in time linear in the page; pages of any length are read
whole; text in a script or style left open at the end is dropped; of equal ratios none comes
first, all lines of a region stay in page order; rows with equal or null page_id are each
extracted; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm.common import slices, table

SIGMA = 1.0
RADIUS = 2
THRESHOLD = 0.5  # of the standard deviation of the smoothed ratios
LONG_LINE, PROSE = 140, 280  # characters of a line of prose, and of such lines that outvote a hint
LEAST_MASS = 0.25  # of the largest region's mass
IN_ARTICLE = 4.0  # weight of a line inside an article
PAGE_DEPTH = 2  # of the body element, below html
SCHEMA = "page_id long, url string, text string, n_chars long"

SILENT = frozenset("script style noscript template svg head title iframe object canvas audio video select option datalist textarea button".split())
PAGE = frozenset("nav footer aside form menu dialog fieldset".split())
BLOCKS = frozenset("html body article main section div p ul ol li dl dt dd h1 h2 h3 h4 h5 h6 header hgroup footer nav aside form fieldset table caption thead tbody tfoot tr td th blockquote pre figure figcaption address details summary hr menu dialog center noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ALONE = frozenset("li dt dd tr td th".split())  # one that opens ends one left open
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words in a class or id that mark parts of the page beside the text.
HINTS = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner banners "
    "cookie cookies consent gdpr notice notices newsletter subscribe subscription signup popup popups modal overlay "
    "sidebar sidebars widget widgets related recommended recommendations share sharing social "
    "comment comments disqus respond reply replies "
    "footer masthead nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar login search".split()
)
COMMENTS = frozenset("comment comments disqus respond reply replies".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Line(NamedTuple):
    """A block's text, its ratio, its element's number, and the depth of the innermost
    element that holds both this line and the one before."""

    text: str
    ratio: float
    element: int
    shared: int
    hint: int  # the outermost element around it that class or id words mark, or -1


class Lines(HTMLParser):
    """Collects the lines of a page.

    Elements are numbered as they open. ``depth`` and ``parent`` give their place; whether a
    line is beside the text is inherited from element to element, so none is visited twice.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.parent, self.name = [0], [-1], [""]  # element 0 is the page
        self.beside, self.comment, self.article, self.hint = [False], [False], [False], [-1]
        self.stack = [0]
        self.places: dict[str, list[int]] = {}  # depths of the open elements of a name
        self.blocks = [0]  # depths of the open blocks
        self.articles = self.links = self.silent = 0
        self.lines: list[Line] = []
        self.tags = self.linked = self.size = 0
        self.pieces: list[str] = []
        self.home = 0

    def flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            e = self.home
            links = self.linked > 0.6 * self.size and not self.article[e]
            weight = 0.0 if self.beside[e] or links else IN_ARTICLE if self.article[e] else 1.0
            self.lines.append(Line(text, weight * len(text) / max(1, self.tags), e, self._shared(e), self.hint[e]))
        self.tags = 0 if text else min(self.tags, 4)
        self.pieces, self.linked, self.size = [], 0, 0

    def _shared(self, e: int) -> int:
        """Climbs from the last line's element and this one to where they meet; over a whole
        page that takes no more steps than there are elements."""
        if not self.lines:
            return 0
        a, b = self.lines[-1].element, e
        while a != b:
            if self.depth[a] >= self.depth[b]:
                a = self.parent[a]
            else:
                b = self.parent[b]
        return self.depth[a]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            if tag == "hr":
                self.flush()
            elif tag == "br":
                self._text(" ")
            self.tags += 1
            return
        if tag in BLOCKS:
            self.flush()
            for left_open in ("p", tag if tag in ALONE else "p"):
                if self.name[self.stack[self.blocks[-1]]] == left_open:
                    self._close(self.blocks[-1])
        self.tags += 1
        top = self.stack[-1]
        inside = self.article[top]
        off, comment, hinted = tag in PAGE or (tag == "header" and not inside), False, False
        for name, value in attrs:
            value = value or ""
            if name in ("class", "id"):
                if tag not in ("html", "body", "main"):
                    words = {w.lower() for w in _WORD.findall(value)}
                    comment |= bool(words & COMMENTS)
                    hinted |= bool(words & HINTS)
            elif name == "role":
                off |= value.strip().lower() in ROLES
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN.search(value)):
                off = True
        comment |= self.comment[top]
        off |= self.beside[top] or comment
        article = inside
        if not comment and (tag in ("article", "main") or (tag == "div" and ("role", "main") in attrs)):
            article = True
            # The first one cannot lie in a part beside the text: that was left open.
            off &= bool(self.articles) and not inside
            hinted &= bool(self.articles) and not inside
            self.articles += 1
        me = len(self.parent)
        self.parent.append(top)
        self.depth.append(self.depth[top] + 1)
        self.name.append(tag)
        self.beside.append(off)
        self.comment.append(comment)
        self.article.append(article)
        self.hint.append(self.hint[top] if self.hint[top] >= 0 and (self.articles > 1 or article == inside) else me if hinted else -1)
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append(me)
        self.silent += tag in SILENT
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        places = self.places.get(tag)
        if not places or (tag not in BLOCKS and places[-1] < self.blocks[-1]):
            return  # it closes nothing: an inline tag does not close a block
        self._close(places[-1])

    def _close(self, depth: int) -> None:
        while len(self.stack) > depth:
            name = self.name[self.stack.pop()]
            self.places[name].pop()
            if self.blocks[-1] == len(self.stack):
                self.blocks.pop()
            self.silent -= name in SILENT
            self.links -= name == "a"

    def handle_data(self, data: str) -> None:
        self._text(data, self.links > 0)

    def _text(self, data: str, linked: bool = False) -> None:
        if self.silent or not data or (not self.pieces and data.isspace()):
            return
        if not self.pieces:
            self.home = self.stack[-1]
        self.pieces.append(data)
        self.size += len(data)
        self.linked += linked * len(data)


def weighed(lines: list[Line]) -> list[Line]:
    """Lines of marked elements without long prose have ratio 0."""
    prose: dict[int, int] = {}
    for x in lines:
        if x.hint >= 0 and x.ratio > 0 and len(x.text) >= LONG_LINE:
            prose[x.hint] = prose.get(x.hint, 0) + len(x.text)
    return [x._replace(ratio=0.0) if x.hint >= 0 and prose.get(x.hint, 0) < PROSE else x for x in lines]


def smoothed(ratios: np.ndarray, sigma: float = SIGMA, radius: int = RADIUS) -> np.ndarray:
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    mass = np.convolve(np.ones(len(ratios)), weights, "full")[radius:-radius]
    return np.convolve(ratios, weights, "full")[radius:-radius] / mass


def clusters(ratios: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, int, float]]:
    """Runs of lines above the threshold, over lines of ratio above 0 between them: first,
    last, and the mass (the sum of the smoothed ratios of those above)."""
    s = smoothed(ratios)
    least = min(threshold * s.std(), 0.999 * s.max())
    strong = np.flatnonzero((s > least) & (ratios > min(least, 0.999 * ratios.max())))
    breaks = np.cumsum(ratios <= 0)
    found: list[tuple[int, int, float]] = []
    for i in strong.tolist():
        if found and breaks[i] == breaks[found[-1][1]]:
            found[-1] = (found[-1][0], i, found[-1][2] + float(s[i]))
        else:
            found.append((i, i, float(s[i])))
    return found


def regions(lines: list[Line], threshold: float = THRESHOLD, least_mass: float = LEAST_MASS) -> list[bool]:
    """Which lines are in the regions of most mass."""
    ratios, shared = np.array([x.ratio for x in lines]), [x.shared for x in lines]
    chosen = [False] * len(lines)
    if not ratios.any():
        return chosen
    found = clusters(ratios, threshold)
    most = max(mass for *_, mass in found)
    found = [(b, e) for b, e, mass in found if mass >= least_mass * most]
    first, last = found[0][0], found[-1][1]
    depth = min(shared[first + 1 : last + 1], default=None)
    if depth is None:  # one line: its own element's parent
        depth = max(shared[first], shared[first + 1] if first + 1 < len(lines) else 0)
    if depth > PAGE_DEPTH:  # the lines of the element that holds all of them
        while first > 0 and shared[first] >= depth:
            first -= 1
        while last + 1 < len(lines) and shared[last + 1] >= depth:
            last += 1
    for i in range(first, last + 1):
        chosen[i] = bool(ratios[i] > 0)
    return chosen


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    lines = weighed(parser.lines)
    return "\n".join(line.text for line, yes in zip(lines, regions(lines), strict=True) if yes)


def _extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = [main_text(h) for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, SCHEMA)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
