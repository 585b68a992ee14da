"""Main text of HTML pages by text-to-tag ratios.

The standard library's streaming parser turns a page into lines: one per block,
with the number of characters of text and of tags, and the characters inside
links. A line's ratio is its text without links per tag, on a logarithmic scale (one
very long paragraph doesn't hide the short ones), times a weight for where the
line stands: little inside menus, page headers and footers, sidebars, notices,
adverts, forms and comment threads (by element, role, class or id), little
beside an article on a page that has one, 1 elsewhere. The ratios of all lines
of the page are smoothed with a Gaussian kernel. Lines whose smoothed ratio
reaches a share of the standard deviation cluster into regions; the lines of a
region that have a ratio of their own are content, and so is what stands
between two of them, unless it is mostly links or in such a container.

An element of running text that is marked as an advert or the like, or hidden,
carries no text. Classes and ids count as marks if each of their words does.

Text: character references are decoded, white space inside a block becomes one
space, blocks are trimmed and joined by one space in page order. Scripts,
styles, templates and markup carry no text.

Definitions for odd input. A null page is empty and gives ''. Broken markup is
read as the parser reads it: unclosed elements end with their container,
truncated references stay as they stand. Rows are read one by one; repeated
rows, null ids and urls change nothing; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trimmed

#: Kernel of the Gaussian smoothing: deviation in lines, and reach.
SIGMA, REACH = 1.0, 2
#: Share of the standard deviation of the smoothed ratios that a content line needs.
THRESHOLD = 0.25
#: Weighted ratio (logarithmic) that a line needs for itself: about a third of a character a tag, or half of the best on
#: a page that has less.
OWN = 0.3
#: Weights of lines in containers without content, and of lines beside an article.
OUTSIDE_WEIGHT, BESIDE_WEIGHT = 0.02, 0.05

BLOCKS = frozenset("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre
section summary table tbody td tfoot th thead tr ul""".split())
SILENT = frozenset("script style template noscript head title iframe object svg math canvas audio video select textarea button".split())
OUTSIDE = frozenset("nav footer aside form menu dialog".split())
INSIDE = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
#: Words of a class or id that mark a container as no content.
OUTSIDE_WORDS = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments
cookie cookies consent disqus footer footnav gdpr header login masthead menu modal nav navbar navigation newsletter notice
notices pagination pager popup promo promoted promotion related replies reply respond share sharing sidebar signup skip
social sponsor sponsored subscribe toolbar topbar widget widgets""".split())
#: Words that say where or how much, not what: "sidebar-left" is a sidebar, "ad-hoc" no advert.
PLACE_WORDS = frozenset("""left right top bottom upper lower main inner outer container wrapper wrap box list item items area block bar
section row panel links link text content post posts article articles page site global user blog body primary secondary""".split())
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_ENDS_ITSELF = {"p": frozenset(("p",)), "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")),
                "tr": frozenset(("tr", "td", "th")), "td": frozenset(("td", "th")), "th": frozenset(("td", "th")),
                "option": frozenset(("option",))}
_SCOPE = frozenset("ul ol dl table article main section div body".split())


def _outside(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> bool:
    """Whether an element holds no content. An article's own header does."""
    if tag in OUTSIDE or tag == "header" and not in_article:
        return True
    for name, value in attrs:
        if not value:
            continue
        if name == "role" and value.strip().lower() in OUTSIDE_ROLES:
            return True
        if name in ("class", "id") and tag not in INSIDE and tag not in ("html", "body"):
            marks = OUTSIDE_WORDS - {"header"} if in_article else OUTSIDE_WORDS
            for token in value.split():
                words = {w.lower() for w in _PART.findall(token)}
                if words & marks and words <= marks | PLACE_WORDS:
                    return True
        if name in ("hidden",) or name == "aria-hidden" and value.lower() == "true":
            return True
    return any(name == "hidden" for name, _ in attrs)


class _Lines(HTMLParser):
    """Collects (text, tags, link characters, outside, inside) per line."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, bool, bool]] = []
        self.open: list[tuple[str, bool, bool, bool]] = []  # tag, silent, outside, inside
        self.text: list[str] = []
        self.tags = 0
        self.links = 0
        self.in_link = 0

    def _state(self) -> tuple[str, bool, bool, bool]:
        return self.open[-1] if self.open else ("", False, False, False)

    def _break(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                _, _, outside, inside = self._state()
                self.lines.append((text, self.tags, self.links, outside, inside))
                self.tags = self.links = 0
            self.text = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._break()
        self.tags += 1
        ends = _ENDS_ITSELF.get(tag) or (_ENDS_ITSELF["p"] if tag in BLOCKS and tag != "br" else None)
        if ends:
            self._end_open(ends)
        if tag in VOID:
            return
        _, silent, outside, inside = self._state()
        marked = _outside(tag, attrs, inside)
        silent = silent or tag in SILENT or marked and tag not in BLOCKS or any(name == "hidden" for name, _ in attrs)
        self.open.append((tag, silent, outside or marked, inside or tag in INSIDE))
        if tag == "a":
            self.in_link += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._break()
        self.tags += 1

    def _end_open(self, ends: frozenset[str]) -> None:
        """Close an element that the new one ends, unless a container stands between."""
        for i in range(len(self.open) - 1, -1, -1):
            tag = self.open[i][0]
            if tag in ends:
                self._close(i)
                return
            if tag in _SCOPE:
                return

    def _close(self, i: int) -> None:
        self.in_link -= sum(t[0] == "a" for t in self.open[i:])
        del self.open[i:]

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._break()
        self.tags += 1
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self._close(i)
                return
            if tag not in _SCOPE and self.open[i][0] in _SCOPE:
                return

    def handle_data(self, data: str) -> None:
        if self._state()[1]:
            return
        self.text.append(data)
        if self.in_link:
            self.links += len(data.strip())

    def finish(self) -> list[tuple[str, int, int, bool, bool]]:
        self.close()
        self._break()
        return self.lines


_KERNEL = np.array([math.exp(-k * k / (2 * SIGMA * SIGMA)) for k in range(-REACH, REACH + 1)])
_KERNEL /= _KERNEL.sum()


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Gaussian smoothing; beyond the ends the kernel is cut and rescaled."""
    over = np.convolve(ratios, _KERNEL)[REACH:REACH + len(ratios)]
    weight = np.convolve(np.ones(len(ratios)), _KERNEL)[REACH:REACH + len(ratios)]
    return over / weight


def weights(lines: list[tuple[str, int, int, bool, bool]]) -> np.ndarray:
    """What a line's ratio counts, by the containers around it."""
    article = any(inside and not outside for _, _, _, outside, inside in lines)
    return np.array([OUTSIDE_WEIGHT if outside else BESIDE_WEIGHT if article and not inside else 1.0 for _, _, _, outside, inside in lines])


def select(lines: list[tuple[str, int, int, bool, bool]]) -> list[str]:
    """The content lines of a page, in order."""
    if not lines:
        return []
    weight = weights(lines)
    ratio = weight * np.log1p([max(len(text) - links, 0) / max(tags, 1) for text, tags, links, _, _ in lines])
    smooth = smoothed(ratio)
    region = smooth >= THRESHOLD * smooth.std()
    own = min(OWN, ratio[weight == 1.0].max(initial=2 * OWN if (weight < 1.0).all() else 0.0) / 2)
    content = region & (ratio >= own) & (ratio > 0)
    fill = np.array([w == 1.0 and 2 * links <= len(text) for w, (text, _, links, _, _) in zip(weight, lines, strict=True)])
    number = np.cumsum(~region)  # lines of one region share a number
    place = np.flatnonzero(content)
    for a, b in zip(place[:-1], place[1:], strict=True):
        if number[a] == number[b]:
            content[a + 1:b] = fill[a + 1:b]
    return [line[0] for line, c in zip(lines, content, strict=True) if c]


def main_text(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    return " ".join(select(parser.finish()))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, held, texts = 0, 0, []
        for i, page in enumerate(batch.column("html")):
            texts.append(main_text(page.as_py()))
            held += len(texts[-1])
            if held > 4 << 20 or i == batch.num_rows - 1:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id").slice(a, len(texts)), batch.column("url").slice(a, len(texts)), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
                a, held, texts = i + 1, 0, []


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(trimmed(_extract), "page_id long, url string, text string, n_chars long")
