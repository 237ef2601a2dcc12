"""HTML extraction: parser events, text-to-tag ratios, smoothing, thresholds.

Each page runs through the standard library's streaming parser. Its events
give lines (blocks of text) in page order, menus, adverts and footers included. Each
line has a text-to-tag ratio. Lines that share a container (an article, or else
the innermost section, list or table, or a part that names itself as something else)
are a region: within it, ratios are smoothed with a Gaussian, and its level is
their mean, weighted by text. The levels of all regions, weighted by text, are
split in two clusters, if these are APART, and regions of the upper one are content.

Tags and names confirm that choice. What stands inside menus, headers, footers,
sidebars, forms, adverts, notices or comment sections, by element or by a class,
id or role whose whole name says so, is not content even where it reads like it. A
lower region between two of content stays unless most of its text stands in
links. Where what a page marks as its article or main part holds at least half of
the text so chosen, regions outside of it are dropped, and lower ones beside the
chosen in the same marked part stay under the same condition.

A null or empty page has no lines and an empty text. Pages may be of any length
and depth. Repeated rows give repeated results. Ids may be null; they are
carried along. Only the id, url and html columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from strandline.llm.shared import bounded_batches

#: Elements whose content is never text of the page.
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video head title".split())
#: Elements that hold something other than the article; a header or footer of an article is told apart below.
ASIDE = frozenset("nav header footer aside form menu dialog select button textarea".split())
#: Words for such parts in class, id or role ...
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead topbar "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login "
    "comment comments disqus replies reply respond related recommended share sharing social widget "
    "search pagination pager toolbar complementary contentinfo".split()
)
#: ... and words that only place or hold them: a name of several words counts if all are of these two kinds.
LAYOUT_WORDS = frozenset(
    "site page main global top bottom left right upper lower primary secondary sub box block bar list area wrap wrapper container section "
    "inner outer holder slot unit links link buttons button icons icon form item items thread posts post articles stories user users reader readers the".split()
)
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end a block.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that mark the article itself, and those whose lines are a region.
MAIN = frozenset(("article", "main"))
CONTAINERS = frozenset("article main section div ul ol dl table blockquote details".split())
WORDS = re.compile(r"[a-z]+")
#: How many times the lower cluster's mean level the upper one's is at least.
APART = 2.0
BLANK = re.compile(r"\s+")


def names_aside(name: str) -> bool:
    """Whether a whole class, id or role names a part that is set aside."""
    words = WORDS.findall(name)
    return not ASIDE_WORDS.isdisjoint(words) and all(w in ASIDE_WORDS or w in LAYOUT_WORDS for w in words)


def marked_aside(tag: str, attrs: list[tuple[str, str | None]], in_main: bool = False) -> bool:
    if tag in ASIDE:
        return not (in_main and tag == "header")  # the header of an article or main part holds its title
    if tag in ("html", "body") or tag in MAIN:
        return False
    for name, value in attrs:
        if name in ("class", "id", "role") and value:
            if any(map(names_aside, value.lower().split())):
                return True
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            return True
    return False


@dataclass
class Line:
    text: str
    tags: int  # since the line before of its kind
    region: int
    mark: int  # number of the outermost article or main element around it, or 0
    linked: int  # characters inside links
    aside: bool = False  # whether elements or names say that it is something else


class Buffer:
    """Text and tags of the line that is being read."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.tags = self.linked = self.region = 0

    def line(self, mark: int, aside: bool) -> Line | None:
        text = BLANK.sub(" ", "".join(self.parts)).strip()
        found = Line(text, self.tags, self.region, mark, self.linked, aside) if text else None
        if found:
            self.tags = 0
        self.linked = 0
        self.parts.clear()
        return found


class Events(HTMLParser):
    """Collects the lines of a page. Set-aside parts have a buffer of their own, as they may stand inside a line."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool, bool, int]] = []  # tag, is silent, sets aside, marks the article, region
        self.counts: dict[str, int] = {}  # of open elements by tag
        self.silent = self.aside = self.main = self.marks = self.regions = 0
        self.own, self.other = Buffer(), Buffer()
        self.lines: list[Line] = []

    def end_block(self) -> None:
        for buffer, aside in ((self.own, False), (self.other, True)):
            if line := buffer.line(self.marks if self.main else 0, aside):
                self.lines.append(line)

    def count_tag(self) -> None:
        if not self.silent:
            (self.other if self.aside else self.own).tags += 1

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.end_block()
            if tag != "br" and self.counts.get("p"):
                self.end_paragraph()
            if tag == "body" and self.counts.get("head"):
                self.close_element("head")
        self.count_tag()
        if tag in VOID:
            return
        article = self.counts.get("article", 0)
        silent, main = tag in SILENT, tag in MAIN
        aside = not silent and marked_aside(tag, attrs, article + self.counts.get("main", 0) > 0)
        region = self.open[-1][4] if self.open else 0
        if tag == "article" or tag in CONTAINERS and not article or aside and not self.aside:
            self.regions += 1
            region = self.regions
        self.open.append((tag, silent, aside, main, region))
        self.counts[tag] = self.counts.get(tag, 0) + 1
        self.silent += silent
        self.aside += aside
        self.marks += main and not self.main
        self.main += main

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # HTML has no self-closing form of elements that have content

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.end_block()
        self.count_tag()
        if self.counts.get(tag):  # a stray end tag closes nothing
            self.close_element(tag)

    def close_element(self, tag):
        """Closes the innermost open element of this tag and all inside it."""
        while self.open:
            last, silent, aside, main, _ = self.open.pop()
            self.counts[last] -= 1
            self.silent -= silent
            self.aside -= aside
            self.main -= main
            if last == tag:
                return

    def end_paragraph(self):
        """A block's start ends an open paragraph, unless another block has begun inside it."""
        for last, *_ in reversed(self.open):
            if last == "p":
                return self.close_element("p")
            if last in BLOCKS:
                return

    def handle_data(self, data):
        if self.silent:
            return
        buffer = self.other if self.aside else self.own
        if not buffer.parts or data.strip():
            buffer.region = self.open[-1][4] if self.open else 0
        buffer.parts.append(data)
        if self.counts.get("a"):
            buffer.linked += len(data.strip())


def smoothed(ratio: np.ndarray, sigma: float) -> np.ndarray:
    """ratio under a Gaussian, its ends mirrored in effect by renormalising."""
    reach = int(3 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    cut = lambda x: np.convolve(x, kernel)[reach : reach + len(x)]
    return cut(ratio) / cut(np.ones(len(ratio)))


def two_means(x: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """The means of two clusters of weighted x, started at its ends."""
    low, high = float(x.min()), float(x.max())
    for _ in range(50):
        above = x > (low + high) / 2
        if not above.any() or above.all():
            break
        was, (low, high) = (low, high), (float(np.average(x[~above], weights=weight[~above])), float(np.average(x[above], weights=weight[above])))
        if was == (low, high):
            break
    return low, high


def regions_of(lines: list[Line]) -> np.ndarray:
    return np.unique([x.region for x in lines], return_inverse=True)[1]


def line_levels(lines: list[Line], sigma: float) -> np.ndarray:
    """Each line's text-to-tag ratio, smoothed over the lines of its region."""
    level, region = np.array([len(x.text) / max(1, x.tags) for x in lines]), regions_of(lines)
    order = np.argsort(region, kind="stable")
    for places in np.split(order, np.flatnonzero(np.diff(region[order])) + 1):
        level[places] = smoothed(level[places], sigma)
    return level


def upper_regions(region: np.ndarray, size: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Which regions are in the upper cluster; all if the clusters are not apart."""
    total = np.bincount(region, size)
    mean = np.bincount(region, size * level) / total
    low, high = two_means(mean, total)
    return mean > (low + high) / 2 if high >= APART * low else np.ones(len(mean), dtype=bool)


def chosen_lines(lines: list[Line], level: np.ndarray) -> np.ndarray:
    """Places of the lines in content regions, by the clusters of all lines and what tags and names say of them."""
    own = np.array([not x.aside for x in lines])
    if not own.any():
        return np.flatnonzero(own)
    region, size = regions_of(lines), np.array([len(x.text) for x in lines])
    total = np.bincount(region, size)
    high = upper_regions(region, size, level)
    if not (high[region] & own).any():  # all that reads like content is something else
        mean = np.bincount(region, size * level * own) / total
        high[mean.argmax()] = True
    linked = np.bincount(region, [x.linked for x in lines])
    ends = np.flatnonzero(high[region] & own)[[0, -1]]
    between = np.zeros(len(high), bool)
    between[region[ends[0] : ends[1] + 1]] = True
    loose = 2 * linked <= total
    chosen = (high | between & loose)[region] & own
    mark = np.array([x.mark for x in lines])
    if 2 * size[chosen & (mark > 0)].sum() >= size[chosen].sum():  # what is marked holds the content
        chosen = own & (mark > 0) & (chosen | np.isin(mark, mark[chosen]) & loose[region])
    return np.flatnonzero(chosen)


def content_blocks(html: str | None, sigma: float = 1.0) -> list[tuple[str, float]]:
    """(text, smoothed text-to-tag ratio) of each content line in page order."""
    if not html:
        return []
    events = Events()
    events.feed(html)
    events.close()
    events.end_block()
    if not events.lines:
        return []
    level = line_levels(events.lines, sigma)
    return [(events.lines[i].text, float(level[i])) for i in chosen_lines(events.lines, level)]


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sigma: float = 1.0) -> DataFrame:
    """id, url, text, n_chars, n_blocks, ratio (mean smoothed text-to-tag ratio of the content)."""
    bounded_batches(pages.sparkSession)
    fields = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    schema = f"`{id_col}` {fields[id_col]}, `{url_col}` {fields[url_col]}, text string, n_chars long, n_blocks int, ratio double"

    def extract(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [content_blocks(x, sigma) for x in part["_html"]]
            texts = ["\n".join(t for t, _ in f) for f in found]
            yield pd.DataFrame(
                {
                    id_col: part["_id"],
                    url_col: part["_url"],
                    "text": texts,
                    "n_chars": [len(t) for t in texts],
                    "n_blocks": [len(f) for f in found],
                    "ratio": [sum(r for _, r in f) / len(f) if f else 0.0 for f in found],
                }
            )

    return pages.selectExpr(f"`{id_col}` as _id", f"`{url_col}` as _url", f"`{html_col}` as _html").mapInPandas(extract, schema)
