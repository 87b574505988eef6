"""Main text of web pages from parser events, text-to-tag ratios, smoothing and clustering.

The standard library's parser is fed in chunks. Its events make lines, one for each block, with their
text, number of tags, share of link text and innermost container; text in menus, scripts and the like is
left out at once. A form, or an element whose class or role hints at something else than the article, is
only doubtful: it is left out unless it turns out to be wrapped around the article. The ratio of text to
tags of each line is smoothed by a Gaussian and split into two clusters; the lines of the upper one are
content. The article is the container that holds most of the content, and all its lines belong to it,
short ones as well.

Containers point to the one around them and are numbered in page order, so sums over what they hold, and
what is inside of what, take one pass however deep they are nested.
"""

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wildtally.llm.tables import settings
from wildtally.llm.tokens import slices

CHUNK = 1 << 16
SIGMA = 1.0
# Share of the content that a container needs to be the article.
MOST, PART = 0.6, 0.25
# Share of the plain text that makes a doubtful element a wrapper of the page, and with a main heading inside.
WRAPPER, HEADED = 0.8, 0.5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
NEVER = frozenset("script style head noscript template nav footer aside button select textarea option iframe object svg canvas dialog menu audio video math".split())
CONTAINERS = frozenset("body article main section div td".split())
ARTICLES = ("article", "main")
# A new one closes an open one of the same kind.
ALONE = frozenset("p li dt dd tr td th option".split())
_HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "comment comments disqus respond replies reply discussion sidebar sidebars widget widgets menu nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar footer "
    "masthead topbar share sharing social related recommended newsletter subscribe subscription signup login search hidden skip".split()
)
# No wrapper by its text alone: readers may write more than the author.
_REMARKS = frozenset("comment comments disqus respond replies reply discussion".split())
# "has-sidebar" is no sidebar.
_BESIDES = frozenset("has have with no without hide show".split())
_HEADER_HINTS = frozenset("header site".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Lines(HTMLParser):
    """The blocks of a page: texts, tags, link characters, and innermost containers."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack = []  # (tag, whether its text is left out, container, whether inside a link)
        self.open = Counter()
        self.lines, self.parts, self.tags, self.linked = [], [], 0, 0
        # Of each container: its tag, the one around it, whether it is in an article, why it is doubtful.
        self.kinds, self.around, self.within, self.doubts = ["root"], [0], [False], [""]
        self.headings = []  # containers of main headings

    def _top(self):
        return self.stack[-1] if self.stack else ("", False, 0, False)

    def _end_line(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.tags, self.linked, self._top()[2]))
        elif self.lines and self.tags:
            # Tags without text weigh on the line before.
            last = self.lines[-1]
            self.lines[-1] = (last[0], last[1] + self.tags, *last[2:])
        self.parts, self.tags, self.linked = [], 0, 0

    def _left_out(self, tag, attrs, inside):
        """Whether an element is left out whatever it holds."""
        if tag in NEVER or tag == "header" and not inside:
            return True
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return True
            if name == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True
        return False

    def _doubt(self, tag, attrs, inside):
        """Why an element may not belong to the article: "remarks", "hint" or nothing."""
        if tag == "form":
            return "hint"
        if tag in ("html", "body", "article", "main", "header"):
            return ""
        for name, value in attrs:
            if not value:
                continue
            if name in ("class", "id"):
                listed = _SPLIT.split(_CAMEL.sub("-", value).lower())
                words = {w for before, w in zip(["", *listed], listed) if before not in _BESIDES}
                if words & _REMARKS:
                    return "remarks"
                if words & _HINTS or (words >= _HEADER_HINTS or "header" in words and words & {"page", "top", "main"}) and not inside:
                    return "hint"
            elif name == "role" and value.lower() in _ROLES:
                return "hint"
        return ""

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self._end_line()
            if tag in ALONE:
                self._close(tag, within=("ul", "ol", "dl", "table", "article", "main", "section", "div", "td", "body"))
        self.tags += 1
        if tag in VOID:
            return
        _, out, box, link = self._top()
        out = out or self._left_out(tag, attrs, self.within[box])
        if not out:
            doubt = self._doubt(tag, attrs, self.within[box])
            if doubt or tag in CONTAINERS:
                self.kinds.append(tag)
                self.around.append(box)
                self.within.append(self.within[box] or tag in ARTICLES)
                self.doubts.append(doubt)
                box = len(self.kinds) - 1
            if tag == "h1":
                self.headings.append(box)
        self.stack.append((tag, out, box, link or tag == "a"))
        self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        if tag not in INLINE:
            self._end_line()
        self.tags += 1

    def _cut(self, size):
        for tag, *_ in self.stack[size:]:
            self.open[tag] -= 1
        del self.stack[size:]

    def _close(self, tag, within=()):
        """Pop to the open ``tag``; not beyond one of ``within``."""
        if not self.open[tag]:
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self._end_line()
                self._cut(i)
                return
            if self.stack[i][0] in within:
                return

    def handle_endtag(self, tag):
        if tag in INLINE:
            self.tags += 1
            if not self.open[tag]:
                return
            # An inline end tag never closes a block around it.
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == tag:
                    self._cut(i)
                    return
                if self.stack[i][0] not in INLINE:
                    return
            return
        self._end_line()
        self.tags += 1
        if tag not in VOID:
            self._close(tag)

    def handle_data(self, data):
        if self.stack and self.stack[-1][1]:
            return
        self.parts.append(data)
        if self.stack and self.stack[-1][3]:
            self.linked += len(data)


def lines_of(html: str) -> Lines:
    parser = Lines()
    for at in range(0, len(html), CHUNK):
        parser.feed(html[at : at + CHUNK])
    parser.close()
    parser._end_line()
    return parser


def smoothed(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(3 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    total = np.convolve(np.ones(len(values)), kernel)[reach : reach + len(values)]
    return np.convolve(values, kernel)[reach : reach + len(values)] / total


def threshold(values: np.ndarray) -> float:
    """Between the means of two clusters of the values (on a log scale); none is above it if all are equal."""
    x = np.log1p(values)
    lo, hi = x.min(), x.max()
    for _ in range(20):
        upper = x > (lo + hi) / 2
        if not upper.any() or upper.all():
            break
        new = x[~upper].mean(), x[upper].mean()
        if new == (lo, hi):
            break
        lo, hi = new
    return float(np.expm1((lo + hi) / 2))


def _summed(parser: Lines, amounts: dict) -> list:
    """What each container holds, in itself and in those inside, of ``amounts`` by container."""
    held = [amounts.get(c, 0) for c in range(len(parser.kinds))]
    for c in range(len(held) - 1, 0, -1):
        held[parser.around[c]] += held[c]
    return held


def _belonging(parser: Lines) -> list[bool]:
    """Whether each container is outside all doubtful ones that are not wrapped around the article.

    A wrapper holds a good part of the plain text and all elements for articles, if there are any; or
    most of the text with the main heading; or nearly all text, unless it is named after remarks.
    """
    plain, articles = Counter(), Counter()
    for text, _, linked, box in parser.lines:
        plain[box] += max(0, len(text) - linked)
    for c, kind in enumerate(parser.kinds):
        articles[c] += kind in ARTICLES
    plain, articles, headings = _summed(parser, plain), _summed(parser, articles), _summed(parser, Counter(parser.headings))
    good = [True]
    for c in range(1, len(parser.kinds)):
        share = plain[c] / max(1, plain[0])
        if articles[0]:
            wrapper = articles[c] == articles[0] and share >= PART
        else:
            wrapper = share >= HEADED and headings[c] > 0 or share >= WRAPPER and parser.doubts[c] != "remarks"
        good.append(good[parser.around[c]] and (not parser.doubts[c] or wrapper))
    return good


def main_text(html: str) -> str:
    parser = lines_of(html)
    good = _belonging(parser)
    lines = [line for line in parser.lines if good[line[3]]]
    if not lines:
        return ""
    sizes = np.array([len(t) for t, *_ in lines], dtype=float)
    plain = sizes - np.minimum(sizes, [linked for _, _, linked, _ in lines])
    ratios = smoothed(plain / np.maximum(1, [tags for _, tags, _, _ in lines]))
    cut = threshold(ratios)
    content = ratios >= cut
    weight = np.where(content, plain, 0.0)
    if not weight.sum():
        weight = sizes
    held = Counter()
    for (*_, box), w in zip(lines, weight):
        held[box] += w
    held = _summed(parser, held)
    total = float(weight.sum())
    chosen = [kind in ARTICLES and w >= PART * total for kind, w in zip(parser.kinds, held)]
    whole = any(chosen)
    if not whole:
        # Containers are numbered in page order, an inner one after those around it.
        chosen[max(c for c, w in enumerate(held) if w >= MOST * total)] = True
    for c in range(1, len(chosen)):
        chosen[c] = chosen[c] or chosen[parser.around[c]]
    return " ".join(t for (t, _, linked, box), sure in zip(lines, content) if chosen[box] and (whole or sure or linked < 0.8 * len(t)))


_TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extracted(batches):
    for batch in slices(batches, "html"):
        texts = [main_text(html) if html else "" for html in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=_TEXTS)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages`` (page_id, url, html).

    A null or empty page, and one with nothing but menus, headers, footers and links, has an empty text; where an
    element that is named like a notice or a form holds all other text, that text is the page's. Markup that
    is broken off or not closed is read as far as it goes. Rows are read one by one: repeated rows, null
    ids and urls and further columns make no difference. An empty table gives no rows.
    """
    settings(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
