"""Main text of HTML pages: parser events, text-to-tag ratio per line, smoothing, clustering.

The standard library's streaming parser turns a page into lines, one per block (paragraph, heading,
list item, cell, ...), each with its text, its number of tags, and the container it stands in. A
line's ratio is its text length over its tags, links counting against it; ratios are smoothed by a
Gaussian over neighbouring lines, and a threshold at the smoothed values' deviation clusters lines
into content and other. Containers with content lines are selected, and every line of a selected
container is kept, short ones too: nothing is dropped for its length; lists, quotations, tables and
code in a selected container go with it unless they are mostly links. An ``article`` or ``main``
element, where there is one, holds the candidates.

Never text: scripts, styles, forms, menus, headers, footers, sidebars, and elements whose class, id
or role names an advert, a notice, a menu, reader comments and the like.

A page is one row's work and pages are spread by Spark, so memory is bounded by the batch and the
longest page. Nulls and ties: a null or empty page, or one without main text, gives ''; broken
markup is read as far as the parser can; repeated rows and equal containers are each kept; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlens.llm.common import schema_with

# Element names and the words of class, id and role that mark what isn't main text.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol
optgroup option p pre search section summary table tbody td tfoot th thead title tr ul""".split())
#: Blocks that end with the next one, or often lack an end: they are lines, not containers.
LINES = frozenset("""p h1 h2 h3 h4 h5 h6 li dt dd tr td th hr option optgroup caption legend summary figcaption thead
tbody tfoot""".split())
NEVER = frozenset("""head title script style noscript template svg math iframe object canvas nav header footer aside
form menu dialog select textarea button search audio video""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset("article main".split())
HINTS = frozenset("""ad ads adbox adslot advert adverts advertisement advertising advertorial sponsor sponsored
sponsors promo promos promotion banner cookie cookies consent gdpr notice notices notification popup modal overlay
menu menus nav navbar navigation breadcrumb breadcrumbs sidebar sidebars widget widgets related recommended
recommendations share sharing social subscribe subscription newsletter signup login comment comments commentlist
disqus respond replies discussion footer masthead topbar toolbar pagination pager skip copyright contentinfo
complementary navigation search alert dialog""".split())
#: Those that also name a topic. Inside of an article, where they may be a section's name, they count only in a
#: name whose other words are marks or ``PARTNERS``, and alone only as a class or role, not as an id, a link's target.
TOPICS = frozenset("""discussion related recommended recommendations social share sharing search alert notice notices
notification promotion sponsor sponsors skip copyright navigation footer complementary dialog subscription login
replies banner""".split())
PARTNERS = frozenset("""posts post links link list lists box boxes button buttons bar icons icon form block module container
wrapper wrap stories articles items item section area panel message messages media""".split())
#: Containers that continue the text around them.
INNER = frozenset("ul ol dl dir blockquote pre table figure details center".split())
#: Only outside of an article, where it may also name a title's place.
OUTSIDE = frozenset("header site-header top".split())
NAME = re.compile(r"[a-z0-9]+|[A-Z][a-z0-9]*|[A-Z]+(?![a-z])")

SIGMA, REACH = 1.0, 2
KERNEL = np.exp(-np.arange(-REACH, REACH + 1) ** 2 / (2 * SIGMA ** 2))
KERNEL /= KERNEL.sum()


class Lines(HTMLParser):
    """Collects (text, tags, link characters, container, in main) per line of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []  # containers and what is never text, outermost first
        self.never = 0                          # open elements that are never text
        self.places = [0]                       # containers of the open elements
        self.mains: list[int] = []              # open article and main elements
        self.made = 0
        self.around: dict[int, tuple[int, str]] = {}  # the container and tag of each container
        self.parts: list[str] = []
        self.tags = self.linked = self.link = 0
        self.lines: list[tuple[str, int, int, int, int]] = []

    def line(self):
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append((text, self.tags, self.linked, self.places[-1], self.mains[-1] if self.mains else 0))
                self.tags = 0
            self.parts, self.linked = [], 0

    def unwanted(self, tag: str, attrs) -> bool:
        if tag in NEVER:
            return True
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                words = {w.lower() for w in NAME.findall(value)}
                if self.mains and not any(self.marks(n, name) for n in value.split()):
                    continue
                if words & HINTS and not (tag in ("html", "body", "main") or tag == "article" and not words & {"comment", "comments"}):
                    return True
                if words & OUTSIDE and not self.mains and tag not in ("html", "body", "main", "article"):
                    return True
            elif name == "hidden":
                return tag not in ("html", "body")
        return False

    @staticmethod
    def marks(name: str, attribute: str) -> bool:
        """Whether a class, id or role inside of an article marks something else than a topic."""
        words = [w.lower() for w in NAME.findall(name)]
        if any(w in HINTS and w not in TOPICS for w in words):
            return True
        if not any(w in TOPICS for w in words) or not all(w in TOPICS or w in PARTNERS for w in words):
            return False
        return len(words) > 1 or attribute == "role" or attribute == "class" and words[0] != "discussion"

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCKS:
            self.line()
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        if tag == "a":
            self.link += 1
        bad = self.unwanted(tag, attrs)
        if bad and tag in LINES:
            # A marked paragraph or item ends with the next block of its kind: see handle_data
            self.close_lines()
            self.open.append((tag, True))
            self.never += 1
        elif bad or tag in BLOCKS and tag not in LINES:
            self.close_lines()
            self.open.append((tag, bad))
            self.never += bad
            self.made += 1
            self.around[self.made] = self.places[-1], tag
            self.places.append(self.made)
            if tag in MAIN and not bad:
                self.mains.append(self.made)
        elif tag in LINES:
            self.close_lines()

    def close_lines(self):
        """A new block ends an open marked line."""
        while self.open and self.open[-1][0] in LINES:
            self.open.pop()
            self.never -= 1

    def handle_startendtag(self, tag, attrs):
        if tag == "br" or tag in BLOCKS:
            self.handle_starttag("br" if tag == "br" else "hr", [])

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS:
            self.line()
        if tag == "a" and self.link:
            self.link -= 1
        if any(t == tag for t, _ in self.open):
            while True:
                t, bad = self.open.pop()
                self.never -= bad
                if t not in LINES:
                    place = self.places.pop()
                    if self.mains and self.mains[-1] == place:
                        self.mains.pop()
                if t == tag:
                    break

    def handle_data(self, data):
        if not self.never:
            self.parts.append(data)
            if self.link:
                self.linked += len(data)


def content(lines: list[tuple[str, int, int, int, int]]) -> np.ndarray:
    """Which lines the smoothed text-to-tag ratios put into content clusters."""
    size = np.array([len(t) for t, *_ in lines], float)
    tags = np.array([n for _, n, *_ in lines], float)
    linked = np.array([c for _, _, c, *_ in lines], float)
    ratio = np.maximum(size - linked, 0) / np.maximum(tags, 1)
    smooth = np.convolve(np.pad(ratio, REACH, mode="edge"), KERNEL, mode="valid")
    return smooth >= min(smooth.std(), smooth.max())


def main_text(page: str | None) -> str:
    """The text of the selected containers' lines, one line each, in page order."""
    if not page:
        return ""
    parser = Lines()
    parser.feed(page)
    parser.close()
    parser.line()
    lines = [x for x in parser.lines if x[4]] or parser.lines
    if not lines:
        return ""
    good = content(lines)
    if lines[0][4]:
        chosen = {x[4] for x, g in zip(lines, good) if g}
        return "\n".join(x[0] for x in lines if x[4] in chosen)
    chosen = {x[3] for x, g in zip(lines, good) if g and x[2] <= len(x[0]) / 2}
    size, linked = Counter(), Counter()
    for text, _, links, place, _ in lines:
        size[place] += len(text)
        linked[place] += links
    for place in sorted(parser.around):  # outer containers come first
        outer, tag = parser.around[place]
        if tag in INNER and outer in chosen and 2 * linked[place] <= size[place]:
            chosen.add(place)
    return "\n".join(x[0] for x in lines if x[3] in chosen)


def extracted(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """The other columns with the main text and its length in code points (``n_chars``)."""
    others = [c for c in pages.columns if c not in (html_col, text_col, "n_chars")]

    def work(batches):
        for batch in batches:
            col = batch.column(html_col)
            texts = [main_text(x.as_py()) for x in col]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in others), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], [*others, text_col, "n_chars"])

    return (pages.select(*[F.col(f"`{c}`") for c in others], F.col(html_col))
            .mapInArrow(work, schema_with(pages, others, f"`{text_col}` string, n_chars bigint")))
