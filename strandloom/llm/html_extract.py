"""Main text of HTML pages from streamed standard-library parser events.

The parser's events are cut into lines at block elements.  Each line has a text-to-tag ratio, taken as a logarithm, to
which its place in the page adds a prior: above 0 in an article (or main, or a container named as content), below 0
outside of these if the page has one, far below 0 in menus, headers, footers, sidebars, notices, adverts, forms and
reader comments, known by element, role, class or id, and for lines of links alone outside containers.  The sums are
smoothed with a Gaussian along each section of the page, so that short paragraphs and the headline go with the text
around them, and clustered by a threshold, halfway between the means of the lines above and under it.  The runs of lines
above it are the content regions, and they alone are the text.  Scripts, styles and other text that isn't shown are no
lines.

Edge cases: null or empty HTML, or a page without text, gives an empty text.  Cut-off pages and unclosed elements are
read as far as they go.  Plain text without markup is one line and kept.  Repeated rows are extracted one by one, other
columns aren't touched, and an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("noscript nav header footer aside form iframe select button textarea object dialog menu".split())
#: Elements whose text isn't shown.
HIDDEN = frozenset("script style template svg canvas head title".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav noscript ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
KEPT = frozenset(("html", "body", "article", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
CLASSES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advert\w+|sponsor\w*|promo\w*|banners?|sidebars?|side|menus?|nav\w*|breadcrumbs?|masthead|footers?|cookies?\w*|consent|notices?|notification\w*|alerts?|popups?|modal|newsletter|subscribe\w*|signup|social|shar(?:e|ing)\w*|related|recommend\w*|comments?|commentlist|disqus|replies|responses|paginat\w+|pager|widgets?|toolbar|login)(?:$|[\s_-])",
    re.I,
)
#: Class tokens that make even an article no main text.
MINOR = frozenset("comment comments reply related promo ad advert sponsored teaser sidebar".split())
HEADS = re.compile(r"(?:^|[\s_-])(?:headers?|site-?head|topbar)(?:$|[\s_-])", re.I)
CONTENT = re.compile(r"(?:^|[\s_-])(?:content|main|post|entry|story|article(?:-?body)?|article-?text)(?:$|[\s_-])", re.I)

#: Gaussian weights of a line and those one to three lines away.
_KERNEL = np.exp(-0.5 * (np.arange(4) / 1.5) ** 2)
#: Priors of lines (logarithms, as the ratios): in an article or main, in a container named as content, beside the first,
#: beside the second, and where main text hardly ever is.
STRONG, NAMED, BESIDE_STRONG, BESIDE_NAMED, CHROME = 4.0, 3.0, -4.0, -4.0, -10.0
#: Bounds of the threshold: a line under the first is never content, one above the second always.
LEAST, MOST = 0.0, 3.0


class Line(NamedTuple):
    text: str
    tags: int
    container: int
    chrome: bool
    plain: bool  # some of its text is outside links


class _Open(NamedTuple):
    tag: str
    chrome: bool
    hidden: bool
    container: int


_PAGE = _Open("", False, False, 0)


class _Lines(HTMLParser):
    """Collects the lines of a page, and the kinds of its containers."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[_Open] = []
        self.parts: list[str] = []
        self.tags, self.links, self.plain = 0, 0, False
        self.kinds: list[str] = [""]  # of containers: "article", "main" or "named"

    def _top(self) -> _Open:
        return self.open[-1] if self.open else _PAGE

    def end_line(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append(Line(text, max(1, self.tags), self._top().container, self._top().chrome, self.plain))
            self.parts = []
        self.tags, self.plain = 0, False

    def _is_chrome(self, tag: str, attrs: list, inside: bool) -> bool:
        if tag in KEPT:
            return tag == "article" and any(name == "class" and value and MINOR & set(value.lower().split()) for name, value in attrs)
        if tag in SKIPPED and not (tag == "header" and inside):
            return True
        for name, value in attrs:
            if name in ("class", "id") and value and (CLASSES.search(value) or (HEADS.search(value) and not inside)):
                return True
            if (name == "role" and value in ROLES) or name == "hidden" or (name == "aria-hidden" and value == "true"):
                return True
        return False

    def _close(self, k: int) -> None:
        self.links -= sum(x.tag == "a" for x in self.open[k:])
        del self.open[k:]

    def _container(self, tag: str, attrs: list, inside: int) -> int:
        """The container that a block element opens, or the one it is in."""
        around = self.kinds[inside]
        if tag in ("article", "main") and around != "article":
            kind = tag
        elif not inside and tag in ("div", "section") and any(n in ("class", "id") and v and CONTENT.search(v) for n, v in attrs):
            kind = "named"
        else:
            return inside
        self.kinds.append(kind)
        return len(self.kinds) - 1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        block = tag in BLOCKS
        if block:
            self.end_line()
            if self.open and tag in ("body", "article", "main"):  # these close what they can't stand in
                for k, x in enumerate(self.open):
                    if (x.chrome or x.hidden) and x.tag in ("head", "nav", "header", "title"):
                        self._close(k)
                        break
            names = [x.tag for x in self.open[-4:]]
            for name, by in (("p", BLOCKS), ("li", ("li",)), ("option", ("option",))):
                if tag in by and name in names:
                    k = len(self.open) - 1 - names[::-1].index(name)
                    if name != "li" or not any(x.tag in ("ul", "ol") for x in self.open[k:]):
                        self._close(k)
                        break
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            return
        top = self._top()
        chrome = top.chrome or self._is_chrome(tag, attrs, self.kinds[top.container] in ("article", "main"))
        if chrome != top.chrome and not block:  # an inline element of another kind is a line of its own
            self.end_line()
        container = self._container(tag, attrs, top.container) if block and not chrome else top.container
        self.open.append(_Open(tag, chrome, top.hidden or tag in HIDDEN, container))
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.end_line()
        self.tags += 1
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].tag == tag:
                if self.open[k].chrome != (self.open[k - 1].chrome if k else False):
                    self.end_line()
                self._close(k)
                break
            if self.open[k].tag in KEPT:
                break

    def handle_data(self, data: str) -> None:
        if not self._top().hidden:
            self.parts.append(data)
            self.plain |= not self.links and not data.isspace()


def priors(lines: list[Line], kinds: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The prior of each line, and the number of the section it is in."""
    present = {kinds[x.container] for x in lines if not x.chrome}
    best = next((k for k in ("article", "main", "named") if k in present), "")
    prior, key = np.zeros(len(lines)), []
    for i, x in enumerate(lines):
        if x.chrome or (not x.plain and not x.container):
            prior[i] = CHROME
        elif best:
            within = kinds[x.container] == best
            prior[i] = (NAMED if within else BESIDE_NAMED) if best == "named" else STRONG if within else BESIDE_STRONG
        key.append((prior[i], x.container))
    return prior, np.cumsum([0] + [a != b for a, b in zip(key[1:], key, strict=False)]) if lines else np.empty(0, int)


def smoothed(values: np.ndarray, section: np.ndarray) -> np.ndarray:
    """Each value as the mean of those around it in its section, weighted by a Gaussian."""
    total, weight = values * _KERNEL[0], np.full(len(values), _KERNEL[0])
    for d, w in enumerate(_KERNEL[1:], 1):
        near = w * (section[d:] == section[:-d])
        total[d:] += near * values[:-d]
        total[:-d] += near * values[d:]
        weight[d:] += near
        weight[:-d] += near
    return total / weight


def threshold(values: np.ndarray) -> float:
    """Halfway between the means of the values above and under it, within LEAST and MOST."""
    order = np.sort(values).tolist()
    sums, n = list(accumulate(order, initial=0.0)), len(order)
    cut = sums[n] / n
    for _ in range(50):
        k = bisect_left(order, cut)
        new = ((sums[n] - sums[k]) / (n - k) + sums[k] / k) / 2 if 0 < k < n else order[0]
        if abs(new - cut) < 1e-6:
            break
        cut = new
    return min(max(cut, LEAST), MOST)


def content_lines(ratios: np.ndarray, prior: np.ndarray | float = 0.0, section: np.ndarray | None = None) -> np.ndarray:
    """Which lines are in a content region, by their text-to-tag ratios, priors and sections."""
    values = smoothed(np.log1p(ratios) + prior, np.zeros(len(ratios), int) if section is None else section)
    return values >= threshold(values)


def main_text(html: str | None) -> str:
    """The blocks of the main text, joined by one space."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    lines = parser.lines
    if not lines:
        return ""
    chosen = content_lines(np.array([len(x.text) / x.tags for x in lines], float), *priors(lines, parser.kinds))
    return " ".join(x.text for x, hit in zip(lines, chosen, strict=True) if hit)


def extract(html: Column) -> Column:
    """Column of main texts."""

    @F.pandas_udf("string")
    def texts(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for page in pages:
            yield pd.Series([main_text(x) for x in page], index=page.index, dtype=object)

    return texts(html)


def extract_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages without the HTML, with text and n_chars; input columns of these names are replaced."""
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in (html, "text", "n_chars")]
    out = pages.select(*kept, extract(F.col(f"`{html}`")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
