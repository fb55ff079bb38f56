"""Operator 2: main text of HTML pages by smoothed text-to-tag ratios.

The standard library's parser is fed each page and its events make lines: a line is the
text of one block, with how many tags it holds, the container that it lies in, and
whether that is of a kind that is never main text (menus, headers and footers of the
page, sidebars, scripts, styles). A
line's ratio is its characters by its tags, nothing for excluded lines; the ratios are
smoothed by a Gaussian and clustered in two by a threshold. The upper lines choose the
content region: the innermost container that holds ``share`` of their text. Where that lies in articles, the
region is all articles of the page; where it lies in a main part, that; else it grows
by headings above it, and lists and parts of it go whose text is links for the most part and of whose lines
under half are upper ones. All the region's lines that are not excluded are the text.

Forms, and elements whose class or id names what is never main text (notices, adverts, comments of readers, menus), are
marked, not excluded outright: a name counts by whole class tokens, and not where the token tells the
state or layout of a page (has-sidebar, nav-open). A mark goes if its element holds the page's main article (the
``main`` or ``article`` of most upper text, more than lies outside of all marks), or by its name alone if it holds a first heading and nearly all of the page's upper
text; the lines under the marks that are left are excluded.

Character references are decoded, white space inside a block becomes one space,
blocks are joined by line ends in page order. Null and empty pages give the
empty text. Broken markup never fails: open tags end with their container.
Repeated rows give equal rows; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.tables import emit

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("head script style noscript template iframe object svg canvas math audio video select button textarea title".split())
EXCLUDED = frozenset("nav footer aside menu dialog".split())
#: Elements that can be the content region, and those that say themselves what they are.
CONTAINERS = frozenset("html body main article section div td center details".split())
REGIONS = {"article": 3, "main": 2, "body": 1}
#: Parts of a region that can be lists of links.
GROUPS = CONTAINERS | frozenset("ul ol dl table".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class names and ids that mark what is never main text; the doubtful ones do so alone or beside words of layout.
SURE = re.compile(r"ads?|advert\w*|sponsor\w*|nav|navbar|navigation|menus?|breadcrumbs?|sidebar|footer|cookies?|consent|gdpr|popup|modal|newsletter|subscribe|comments?|disqus|pagination|pager|masthead|social")
SURE_PHRASES = ("site-header", "page-header", "skip-link", "print-only")
DOUBTFUL = re.compile(r"aside|banner|login|notices?|promo\w*|recommend\w*|related|replies|respond|share|sharing|signup|toc|widget")
LAYOUT = re.compile(r"area|articles?|bar|block|bottom|box|button|buttons|container|content|form|icons|inner|left|links|list|news|pages|posts|reading|right|section|site|stories|tools|top|topics|user|wrap|wrapper|\d+")
#: Words that tell that a name speaks of a page's state or layout, not of what the element is.
STATES = frozenset("has no not with without is are open opened close closed enabled disabled active inactive visible spacing on off ready loaded collapsed expanded less free offset margin padding layout template theme grid column columns col".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert".split())
#: An end tag also ends these when they are still open inside it; a start tag of the same kind ends an open one.
CLOSED_BY = {"p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"])}


def is_named(names: str) -> bool:
    """Whether one of some class names and ids marks what is never main text."""
    for token in names.split():
        words = [w for w in re.split(r"[^a-z0-9]+", token) if w]
        if STATES.isdisjoint(words):
            doubtful = [bool(DOUBTFUL.fullmatch(w)) for w in words]
            if any(map(SURE.fullmatch, words)) or any(x in "-".join(words) for x in SURE_PHRASES) or any(doubtful) and all(d or LAYOUT.fullmatch(w) for d, w in zip(doubtful, words, strict=True)):
                return True
    return False


class Open(NamedTuple):
    """An open element, and what holds for the text in it: numbers of the container, mark and group that it lies in (0: none)."""

    tag: str
    skipped: bool = False
    excluded: bool = False
    container: int = 0
    mark: int = 0
    group: int = 0
    linked: bool = False


class Line(NamedTuple):
    text: str
    tags: int
    excluded: bool
    container: int
    mark: int
    group: int
    heading: str  # its tag
    linked: int  # characters in links


class Lines(HTMLParser):
    """Turns a page's events into lines, and into containers, marks and groups, all numbered in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[Open] = []
        self.blocks: list[int] = []  # places of block elements in open
        self.counts: list[Counter] = [Counter()]  # open tags inside each open region
        self.lines: list[Line] = []
        self.kinds, self.parents, self.container_marks = [0], [0], [0]
        self.mark_parents, self.mark_names = [0], [False]  # a form's mark has no name
        self.group_parents = [0]
        self.parts: list[str] = []
        self.tags, self.linked = 0, 0

    def state(self) -> Open:
        return self.open[-1] if self.open else Open("")

    def end_line(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                now = self.state()
                block = self.open[self.blocks[-1]].tag if self.blocks else ""
                self.lines.append(Line(text, self.tags, now.excluded, now.container, now.mark, now.group, block if block in HEADINGS else "", min(self.linked, len(text))))
                self.tags = 0
            self.parts, self.linked = [], 0

    def push(self, element: Open) -> None:
        tag = element.tag
        self.counts[-1][tag] += 1
        if tag in REGIONS:
            self.counts.append(Counter())
        if tag in BLOCKS:
            self.blocks.append(len(self.open))
        self.open.append(element)

    def pop_to(self, depth: int) -> None:
        while len(self.open) > depth:
            tag = self.open.pop().tag
            if tag in REGIONS:
                self.counts.pop()
            self.counts[-1][tag] -= 1
        while self.blocks and self.blocks[-1] >= depth:
            self.blocks.pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
            while self.open and tag in CLOSED_BY.get(self.open[-1].tag, ()):
                self.pop_to(len(self.open) - 1)
            # an inline tag left open does not hold the next block's paragraph
            if self.blocks and tag in CLOSED_BY.get(self.open[self.blocks[-1]].tag, ()):
                self.pop_to(self.blocks[-1])
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        now = self.state()
        given = {k: (v or "").lower() for k, v in attrs}
        inside = len(self.counts) > 1 and any(c["article"] or c["main"] for c in self.counts)
        excluded = now.excluded or tag in EXCLUDED or (tag == "header" and not inside) or given.get("role", "") in ROLES or "hidden" in given or given.get("aria-hidden") == "true"
        mark, container, group = now.mark, now.container, now.group
        if not excluded and tag not in REGIONS:
            named = is_named(f"{given.get('class', '')} {given.get('id', '')}")
            if named or tag == "form" or given.get("role") == "form":
                self.mark_parents.append(mark)
                self.mark_names.append(named and tag != "form")
                mark = len(self.mark_parents) - 1
        if tag in CONTAINERS or given.get("role") == "main":
            self.parents.append(container)
            container = len(self.kinds)
            self.kinds.append(REGIONS.get(tag, 2 if given.get("role") == "main" else 0))
            self.container_marks.append(mark)
        if tag in GROUPS:
            self.group_parents.append(group)
            group = len(self.group_parents) - 1
        self.push(Open(tag, now.skipped or tag in SKIPPED, excluded, container, mark, group, now.linked or (tag == "a" and "href" in given)))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
        # an end tag ends nothing outside its region, unless it is a region's
        if (any(c[tag] for c in self.counts) if tag in REGIONS else self.counts[-1][tag]) > 0:
            at = len(self.open) - 1
            while self.open[at].tag != tag:
                at -= 1
            self.pop_to(at)

    def handle_data(self, data: str) -> None:
        now = self.state()
        if not now.skipped:
            self.parts.append(data)
            if now.linked:
                self.linked += len(data)


def gaussian(sigma: float) -> np.ndarray:
    reach = max(1, int(3 * sigma))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return weights / weights.sum()


def above(smooth: np.ndarray) -> np.ndarray:
    """Clustering in two: the threshold moves to the middle of the two means; True for the upper ones."""
    threshold = smooth.mean()
    for _ in range(20):
        high = smooth >= threshold
        if high.all() or not high.any():
            break
        moved = (smooth[high].mean() + smooth[~high].mean()) / 2
        if abs(moved - threshold) < 1e-9:
            break
        threshold = moved
    return smooth >= threshold


def smoothed(lines: list[Line], size: np.ndarray, sigma: float) -> np.ndarray:
    """Which lines are of the upper cluster of smoothed ratios."""
    ratio = size / np.maximum(np.array([x.tags for x in lines], float), 1)
    weights = gaussian(sigma)
    return above(np.convolve(ratio, weights)[len(weights) // 2 :][: len(lines)]) & (size > 0)


def up_to(parents: list[int], i: int) -> Iterator[int]:
    """``i`` and what it lies in, the innermost first, without 0."""
    while i:
        yield i
        i = parents[i]


def with_inner(parents: list[int], own: np.ndarray) -> np.ndarray:
    """Sums of each node and all that lies in it; parents come before their children."""
    out = own.astype(float)
    for i in range(len(parents) - 1, 0, -1):
        out[parents[i]] += out[i]
    return out


def lasts(parents: list[int]) -> np.ndarray:
    """The last number of what lies in each node."""
    last = np.arange(len(parents))
    for i in range(len(parents) - 1, 0, -1):
        last[parents[i]] = max(last[parents[i]], last[i])
    return last


def marked(parser: Lines, size: np.ndarray, chosen: np.ndarray, little: float = 0.05) -> np.ndarray:
    """Which lines lie under a mark, after those marks are taken back that hold the page's main part."""
    n, mark = len(parser.mark_parents), np.array([x.mark for x in parser.lines])
    if n == 1:
        return mark > 0
    container = np.array([x.container for x in parser.lines])
    weight, held, last = size * chosen, np.ones(n, bool), lasts(parser.parents)
    held[0] = False
    # the text of each region under no mark but its own; of nested ones the outer holds the inner's
    kinds, own_mark = np.array(parser.kinds), np.array(parser.container_marks)
    regions = np.flatnonzero(kinds >= 2)
    order = np.argsort(container, kind="stable")
    best, most = 0, 0.0
    for i in regions:
        a, b = np.searchsorted(container[order], [i, last[i] + 1])
        here = order[a:b]
        if (own := float(weight[here][mark[here] == own_mark[i]].sum())) > most:
            best, most = int(i), own
    if best and most > weight[mark == 0].sum():
        for m in up_to(parser.mark_parents, int(own_mark[best])):
            held[m] = False
    headings = np.array([x.heading == "h1" for x in parser.lines])
    inner, first = (with_inner(parser.mark_parents, np.bincount(mark, v, n)) for v in (weight, headings * 1.0))
    own = np.bincount(mark, weight, n)
    free = np.zeros(n, bool)  # neither held nor in a held mark
    free[0] = True
    for m in range(1, n):  # an outer mark comes before those in it
        if held[m] and parser.mark_names[m] and first[m] and inner[m] >= (1 - little) * weight.sum() and own[free].sum() < little * weight.sum():
            held[m] = False
        free[m] = not held[m] and free[parser.mark_parents[m]]
    return ~free[mark]


def region_of(parser: Lines, chosen: np.ndarray, size: np.ndarray, share: float) -> tuple[list[tuple[int, int]], bool]:
    """The content region as ranges of containers (first, last), and whether an article or main part says so too."""
    kinds, parents = np.array(parser.kinds), parser.parents
    container = np.array([x.container for x in parser.lines])
    weight, last = with_inner(parents, np.bincount(container, size * chosen, len(kinds))), lasts(parents)
    best = int(np.flatnonzero(weight >= share * weight[0])[-1])  # all that hold so much lie in one another
    above_it = [*up_to(parents, best), 0]
    if any(kinds[i] == 3 for i in above_it):
        own = np.bincount(container, size, len(kinds))
        return [(int(i), int(last[i])) for i in np.flatnonzero(kinds == 3) if own[i : last[i] + 1].any() and all(kinds[j] != 3 for j in up_to(parents, parents[i]))], True
    if mains := [i for i in above_it if kinds[i] == 2]:
        return [(mains[0], int(last[mains[0]]))], True
    heading = np.array([bool(x.heading) for x in parser.lines])
    for up in above_it[1:]:  # headings above the region belong to it
        added = (container >= up) & (container <= last[up]) & ~((container >= best) & (container <= last[best])) & (size > 0)
        if not heading[added].all():
            break
        best = up
    return [(best, int(last[best]))], False


def link_lists(parser: Lines, size: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Which lines lie in a group whose text is links for the most part and of whose lines under half are upper ones."""
    group, n = np.array([x.group for x in parser.lines]), len(parser.group_parents)
    totals = lambda v: with_inner(parser.group_parents, np.bincount(group, v, n))
    gone = (2 * totals(np.array([x.linked for x in parser.lines]) * (size > 0)) > totals(size)) & (2 * totals(chosen * 1.0) < totals((size > 0) * 1.0))
    gone[0] = False
    for i in range(1, n):
        gone[i] |= gone[parser.group_parents[i]]
    return gone[group]


def main_text(html: str | None, sigma: float = 1.0, share: float = 0.75) -> str:
    """The main text of one page."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    lines = parser.lines
    size = np.array([0 if x.excluded else len(x.text) for x in lines], float)
    if not size.any():
        return ""
    size[marked(parser, size, smoothed(lines, size, sigma))] = 0
    if not size.any():
        return ""
    chosen = smoothed(lines, size, sigma)
    chosen = chosen if chosen.any() else size > 0
    region, hinted = region_of(parser, chosen, size, share)
    kept = np.array([any(a <= x.container <= b for a, b in region) for x in lines]) & (size > 0)
    if not hinted:
        kept &= ~link_lists(parser, size * kept, chosen & kept)
    return "\n".join(x.text for x, k in zip(lines, kept, strict=True) if k)


OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [main_text(h) for h in part.column(2).to_pylist()]
                yield from emit([{"page_id": part.column(0), "url": part.column(1), "text": found, "n_chars": [len(t) for t in found]}], OUT)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
