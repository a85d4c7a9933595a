"""Main text of web pages.

The standard library's parser streams events; from them a page becomes lines, one a block, each
with its characters, its number of tags and the element it stands in.  The text-to-tag ratio of the
lines is smoothed by a Gaussian and split in two by threshold clustering.  The containers of several
lines with text above the threshold, and lines within article and main elements, are content; their
smallest common container is the region, and every line of it is kept, short paragraphs included.  Menus, page headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments are told by element, role and
class, and never kept.  A class tells only as a whole: each part of its name is a word for boilerplate
or for a piece of a page (``share-links``, not ``share-price``); within article and main elements it
tells of containers alone, not of paragraphs and headings.

A null or empty html has the empty text, as has a page of boilerplate alone.  Elements that are
never closed end with the elements around them; broken declarations are comments up to the next ">".
Time and memory follow the length of a page, however its elements nest.  Repeated rows give repeated
results.  Other columns are kept, except those named as a result, which are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import map_frames, table, without

# Element and role names of HTML and ARIA.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
_NEVER = frozenset("head title script style noscript template nav aside footer form fieldset button select textarea iframe object canvas svg math menu dialog audio video".split())
_ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert alertdialog menu menubar toolbar status".split())
_BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay sidebar aside rail widget menu nav navbar navigation breadcrumb breadcrumbs pagination pager header masthead footer comment comments commentlist disqus reply replies share sharing social related recommended newsletter subscribe signup login search toolbar skip".split()
)
#: Words that name a piece of a page; with one of the words above they make a class of boilerplate.
_PIECES = frozenset(
    "area articles banner bar block body bottom box btn button buttons container content footer form global group head icons inner item items left link links list main nav outer page panel posts primary region right row secondary section site slot stories text title top unit wrap wrapper".split()
)
_TEXT_LEVEL = frozenset("a abbr address b blockquote cite code dd dfn dt em figcaption h1 h2 h3 h4 h5 h6 i kbd li mark p pre q s small span strong sub sup td th time tr u".split())
_CONTENT = frozenset("article main".split())
_OTHER_ARTICLES = frozenset("comment comments reply related recommended ad ads advert sponsored promo".split())
_WALLS = frozenset("article main body table".split())  # an end tag of an element around them does not end them
_HEADERS = frozenset("header masthead".split())
_HOLDERS = frozenset("html body div section td table tbody ul ol dl center blockquote".split())
_CLOSED_BY = {"p": _BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}, "head": {"body"}}
_TOKENS = re.compile(r"[^a-z0-9]+")


class _Lines(HTMLParser):
    """Collects (text, tags, element) of each block of a page; elements are numbered as they open."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, str, bool]] = []  # name, number, why never kept (or ""), within content
        self.open: dict[str, list[int]] = {}  # places in the stack by name, by "never" and by "wall"
        self.parent = [0]
        self.lines: list[tuple[str, int, int]] = []
        self.content: set[int] = set()
        self.holders: set[int] = set()
        self.parts: list[str] = []
        self.tags = 0

    def updatepos(self, i, j):
        return j  # line numbers are of no use here

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i)  # as browsers do

    def _end_line(self) -> None:
        if self.parts:
            if text := " ".join("".join(self.parts).split()):
                self.lines.append((text, self.tags, self.stack[-1][1] if self.stack else 0))
            self.parts = []
        self.tags = 0

    def _marked(self, tag: str, value: str, inside: bool) -> bool:
        """Whether a class or id names boilerplate."""
        if inside and (tag in _TEXT_LEVEL or tag == "header"):
            return False
        marks = _OTHER_ARTICLES if tag == "article" else _BOILERPLATE - _HEADERS if inside else _BOILERPLATE
        for name in value.split():
            words = [w for w in _TOKENS.split(name) if w and not w.isdigit()]
            if not marks.isdisjoint(words) and all(w in marks or w in _PIECES for w in words):
                return True
        return False

    def _never(self, tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> str:
        """"element" or "class" of boilerplate, or nothing."""
        if tag in _NEVER or tag == "header" and not inside:
            return "element"
        if tag in ("html", "body", "main"):
            return ""
        for name, value in attrs:
            value = (value or "").lower()
            if name in ("class", "id") and self._marked(tag, value, inside):
                return "class"
            if name == "role" and value in _ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                return "element"
        return ""

    def _places(self, tag: str, root: bool) -> list[str]:
        return [tag, *(["never"] if root else []), *(["wall"] if tag in _WALLS else [])]

    def _close(self, at: int) -> None:
        """End the elements from place ``at`` of the stack on."""
        while len(self.stack) > at:
            tag, _, never, _ = self.stack.pop()
            for k in self._places(tag, bool(self.open.get("never")) and self.open["never"][-1] == len(self.stack)):
                self.open[k].pop()

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCK:
            self._end_line()
            while self.stack and tag in _CLOSED_BY.get(self.stack[-1][0], ()):
                self._close(len(self.stack) - 1)
            if (tag == "body" or tag in _CONTENT) and self.open.get("never"):  # what was left open before does not cover it
                root = self.open["never"][0]
                name, number, never, _ = self.stack[root]
                if tag == "body" or name in ("head", "nav", "header", "menu") and not any(self.open.get(c) for c in _CONTENT):
                    self._close(root)
                elif never == "class" and not any(self.open.get(c) for c in _CONTENT):  # a class of the whole page
                    self.stack[root:] = [(n, i, "", w) for n, i, _, w in self.stack[root:]]
                    self.open["never"].clear()
        if tag == "br":
            self.parts.append(" ")
        self.tags += 1
        if tag not in _VOID:
            number = len(self.parent)
            top = self.stack[-1] if self.stack else ("", 0, "", False)
            self.parent.append(top[1])
            content = tag in _CONTENT or ("role", "main") in attrs
            never = top[2] or self._never(tag, attrs, top[3])
            for k in self._places(tag, bool(never) and not top[2]):
                self.open.setdefault(k, []).append(len(self.stack))
            self.stack.append((tag, number, never, top[3] or content))
            if content:
                self.content.add(number)
            if tag in _HOLDERS:
                self.holders.add(number)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # as browsers do: the slash ends only void elements

    def handle_endtag(self, tag):
        if tag in _BLOCK:
            self._end_line()
        self.tags += 1
        if at := self.open.get(tag):
            walls = self.open.get("wall")
            if tag in ("html", "body", "article", "main") or not walls or at[-1] >= walls[-1]:
                self._close(at[-1])

    def handle_data(self, data):
        if not (self.stack and self.stack[-1][2]):
            self.parts.append(data)


def ratios(lines: list[tuple[str, int, int]]) -> np.ndarray:
    """Text-to-tag ratio of each line."""
    return np.array([len(t) / max(tags, 1) for t, tags, _ in lines])


def smoothed(raw: np.ndarray, sigma: float) -> np.ndarray:
    """A Gaussian mean over ``sigma`` lines."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(raw, kernel)[reach : reach + len(raw)] / np.convolve(np.ones(len(raw)), kernel)[reach : reach + len(raw)]


def threshold(values: np.ndarray) -> float:
    """The middle between the centres of two clusters (two-means from both ends)."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        middle = (low + high) / 2
        above = values > middle
        if not above.any() or above.all():
            break
        new = float(values[~above].mean()), float(values[above].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """The main text of one page, blocks joined by one space.

    The region is the innermost container, of several lines or a content element (article, main), that holds
    all containers of several lines with text above the threshold and all lines of content elements.  Single
    lines around the container with the most such text, as adverts and imprints are, do not widen it.  Only
    boilerplate is dropped within it.
    """
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser._end_line()
    lines = parser.lines
    if not lines:
        return ""
    raw = ratios(lines)
    smooth = smoothed(raw, sigma)
    cut = threshold(smooth)
    above = smooth >= cut
    if (above & (raw >= cut)).any():
        above &= raw >= cut  # not the lines beside a region that it lifts
    within = [False] * len(parser.parent)  # an element's number is greater than that of the one around it
    for k in range(1, len(within)):
        within[k] = k in parser.content or within[parser.parent[k]]
    several, held = [0] * len(within), [0] * len(within)
    for _, _, at in lines:
        several[at] += 1
    for k in range(len(within) - 1, 0, -1):
        several[parser.parent[k]] += several[k]
    holds = [(k in parser.content or k in parser.holders) and several[k] > 1 for k in range(len(within))]
    home = [0] * len(within)  # the nearest container of several lines
    for k in range(1, len(within)):
        home[k] = k if holds[k] else home[parser.parent[k]]
    weight = [0] * len(within)
    for (t, _, at), over in zip(lines, above.tolist(), strict=True):
        weight[home[at]] += len(t) * over
    loose, k = set(), max(range(len(within)), key=lambda k: (weight[k], k))  # the container with the most text above
    while k:
        k = parser.parent[k]
        loose.add(k)
    for (_, _, at), over in zip(lines, above.tolist(), strict=True):
        held[at] += over and home[at] not in loose or within[at]
    for k in range(len(within) - 1, 0, -1):
        held[parser.parent[k]] += held[k]
    common = [k for k in range(1, len(within)) if held[k] == held[0] and (k in parser.content or holds[k])]
    if not common:
        return " ".join(t for t, _, _ in lines)
    region = [False] * len(within)
    for k in range(common[-1], len(within)):  # the last opened is the innermost
        region[k] = k == common[-1] or region[parser.parent[k]]
    return " ".join(t for t, _, at in lines if region[at])


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """Add the main text of every page as ``text`` and its code points as n_chars."""
    kept = without(pages, *(n for n in (text, "n_chars") if n != html))
    schema = T.StructType([*(f for f in kept.schema.fields if f.name != html), T.StructField(text, T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [main_text(h if isinstance(h, str) else None) for h in batch[html]]
            yield batch.assign(**{text: found, "n_chars": [len(t) for t in found]})[schema.names]

    return map_frames(kept, run, schema)


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", "n_chars")
