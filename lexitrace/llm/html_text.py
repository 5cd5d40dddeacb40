"""Main text of web pages by smoothed text-to-tag ratios.

The standard library's parser streams each page as events. Block-level tags end a
line; a line knows its text, its tags, and the outermost enclosing article or main
element. Lines inside menus, headers, footers, side bars, notices, adverts, forms,
scripts, styles or reader comments (by element, role, or a word of class or id) are
boilerplate. Words of a class can mislead: an element that only such words (or a form)
mark counts as content after all if it holds over half of the text, and, for words that
name a frame of the page, an article or main element. Words that tell a state (open, allowed,
free, no) make what they stand with no role. Elements and articles of comments go whatever
they hold, but for one whose name only contains such a word and which holds the page's only
articles and over half of its text. The text-to-tag ratios of the rest
are smoothed with a Gaussian and split by a threshold of half their standard deviation,
capped by their mean. Lines above it select the content region, which is taken whole: all
article elements if a line of any is selected; else the innermost section-like element
around all selected lines that has more than one line, or the page if there is none.

A page is read once in one pass; memory is in proportion to the page. Defined results: null or
empty html gives ''; broken markup is read as far as the parser recovers, an end tag
without a start and a marked section (``<![``, up to the next ``>``) are passed over;
repeated rows give equal rows; an empty table gives none. Only the named columns are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

#: Elements of HTML by what they do here.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style noscript template head title svg math iframe object select option textarea button datalist canvas audio video map".split())
FRAME = set("nav header footer aside form menu dialog fieldset search".split())
IMPLIED = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = set("article main body div section table ul ol dl blockquote td th li nav header footer aside form html".split())
ENDS_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Words of class, id or role that mark what isn't the article: reader
#: comments, frames of the page, and what may also be part of an article's own name.
COMMENTS = set("comment comments commentlist disqus replies reply respond".split())
FRAMES = set("ad ads adv advert adverts advertisement advertising breadcrumb breadcrumbs complementary consent contentinfo cookie cookies footer gdpr menu menubar modal nav navbar navigation outbrain pager pagination sidebar taboola".split())
PARTS = set("banner header masthead newsletter notice notices notification popup promo promoted promotion recommended related search share sharing skip social sponsor sponsored subscribe subscription teaser teasers toolbar".split())
#: Words that tell of a state, as in comments-open, no-comments or ad-free.
STATES = set("allowed closed disabled enabled free has hidden no non not off on open supported with without".split())
#: Words of a class: runs of letters, and what camel case makes of them.
NAME = re.compile(r"[A-Za-z]+")
CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: Elements that hold an article.
REGION = set("article main".split())
#: Elements that may hold the content; others (lists, tables, quotes) are part of it.
SECTION = REGION | set("html body div section center".split())

SIGMA = 1.0
SHARE_OF_DEVIATION = 0.5


class _Marked:
    """An element that counts as content only if it turns out so: what marks it, the marked
    element around it (a number, -1 for none), whether it lies in comments, holds an
    article or main element, and the length of its text."""

    __slots__ = ("kind", "around", "comments", "region", "held")

    def __init__(self, kind: str, around: int, comments: bool) -> None:
        self.kind, self.around, self.comments, self.region, self.held = kind, around, comments, False, 0


class _Lines(HTMLParser):
    """Lines of a page: (text, tags, article number or 0, number of the innermost marked
    element or -1); of each section-like element its first line and the one behind its
    last, inner elements before outer ones."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        self.sections: list[tuple[int, int]] = []
        self.marked: list[_Marked] = []
        self.stack: list[tuple[str, bool, int, int, int]] = []  # tag, boilerplate, article, first line, marked
        self.open: Counter[str] = Counter()
        self.text: list[str] = []
        self.tags = self.made = self.regions = 0  # regions: article and main elements outside comments

    def _top(self) -> tuple[str, bool, int, int, int]:
        return self.stack[-1] if self.stack else ("", False, 0, 0, -1)

    def _end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            _, _, article, _, marked = self._top()
            self.lines.append((text, self.tags, article, marked))
            self.tags = 0
        self.text = []

    def _pop_to(self, k: int) -> None:
        gone = self.stack[k:]
        if any(x[0] not in INLINE for x in gone):
            self._end_line()
        self.sections += [(x[3], len(self.lines)) for x in reversed(gone) if x[0] in SECTION and x[3] < len(self.lines)]
        self.open.subtract(x[0] for x in gone)
        del self.stack[k:]

    def _judge(self, tag: str, attrs: list[tuple[str, str | None]], article: int) -> tuple[bool, str | None]:
        """(boilerplate for sure, else what marks the element, or None)."""
        words: set[str] = set()
        whole: set[str] = set()
        for token in (t for k, v in attrs if k in ("class", "id", "role") and v for t in v.split()):
            runs = NAME.findall(token)
            own = {w.lower() for run in runs for w in (run, *CAMEL.findall(run))}
            if not own & STATES:
                words |= own
                whole.add(token.lower())
        if article:  # an article's own header holds its title
            words.discard("header")
        if tag in HIDDEN or tag in FRAME - {"form", "header"} or tag == "header" and not article:
            return True, None
        if tag in ("html", "body", "main"):
            return False, None
        if words & COMMENTS:
            return (True, None) if tag == "article" or whole & COMMENTS else (False, "comments")
        if tag == "article":
            return False, "part" if words & (FRAMES | PARTS) else None
        if tag == "form" or words & FRAMES:
            return False, "frame"
        return False, "part" if words & PARTS else None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        closes = IMPLIED.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
        if any(self.open[c] for c in closes):
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] in closes:
                    self._pop_to(k)
                    break
                if self.stack[k][0] in SCOPES:
                    break
        if tag not in INLINE:
            self._end_line()
        elif tag == "br":
            self.text.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        _, out, article, _, marked = self._top()
        self.made += 1
        if not out:
            out, kind = self._judge(tag, attrs, article)
            if tag in REGION and not out:
                if marked >= 0:
                    self.marked[marked].region = True
                self.regions += not (marked >= 0 and self.marked[marked].comments)
            if kind:
                inside = kind == "comments" or marked >= 0 and self.marked[marked].comments
                self.marked.append(_Marked(kind, marked, inside))
                marked = len(self.marked) - 1
        if tag in REGION and not article:
            article = self.made
        self.stack.append((tag, out, article, len(self.lines), marked))
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.open[tag]:
            self._pop_to(next(k for k in range(len(self.stack) - 1, -1, -1) if self.stack[k][0] == tag))
            return
        if tag not in INLINE:
            self._end_line()

    def handle_data(self, data: str) -> None:
        if not self._top()[1]:
            self.text.append(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else len(self.rawdata)

    def content(self) -> tuple[list[tuple[str, int, int]], list[tuple[int, int]]]:
        """Lines (text, tags, article) and sections without what marked elements hold,
        unless it is content after all. Tags of a line that goes count for the next."""
        for text, _, _, k in self.lines:
            if k >= 0:
                self.marked[k].held += len(text)
        for m in reversed(self.marked):  # inner elements come behind outer ones
            if m.around >= 0:
                self.marked[m.around].held += m.held
                self.marked[m.around].region |= m.region
        whole = sum(len(x[0]) for x in self.lines)
        content: list[bool] = []
        for m in self.marked:
            own = 2 * m.held > whole and (m.kind == "part" or m.region) and not (m.kind == "comments" and self.regions)
            content.append(own and (m.around < 0 or content[m.around]))
        out, before, spare = [], [0], 0
        for text, tags, article, marked in self.lines:
            if marked < 0 or content[marked]:
                out.append((text, tags + spare, article))
                spare = 0
            else:
                spare += tags
            before.append(len(out))
        return out, [(before[a], before[b]) for a, b in self.sections if before[a] < before[b]]


def smoothed(ratios: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing over neighbours, with weights that sum to one at the ends."""
    reach = max(1, math.ceil(2 * sigma))
    bell = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for k in range(len(ratios)):
        near = [(bell[d + reach], ratios[k + d]) for d in range(-reach, reach + 1) if 0 <= k + d < len(ratios)]
        out.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    return out


def content_blocks(html: str | None) -> list[str]:
    """The blocks of the main text, in page order."""
    if not html:
        return []
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser._end_line()
    parser._pop_to(0)
    lines, sections = parser.content()
    if not lines:
        return []
    ratio = smoothed([len(text) / max(1, tags) for text, tags, _ in lines])
    mean = sum(ratio) / len(ratio)
    deviation = math.sqrt(sum((r - mean) ** 2 for r in ratio) / len(ratio))
    cut = min(mean, SHARE_OF_DEVIATION * deviation)
    chosen = [r >= cut for r in ratio]
    if any(c and line[2] for line, c in zip(lines, chosen)):
        return [text for text, _, article in lines if article]
    if True not in chosen:
        return []
    low, high = chosen.index(True), len(chosen) - chosen[::-1].index(True)
    first, last = next(((a, b) for a, b in sections if a <= low and high <= b and b - a > 1), (0, len(lines)))
    return [text for text, _, _ in lines[first:last]]


@F.pandas_udf(T.StringType())
def main_text(html: pd.Series) -> pd.Series:
    return html.map(lambda x: "\n\n".join(content_blocks(x)), na_action=None)


def extract_main_text(pages: DataFrame, html: Column | None = None) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (code points) in place of ``html``."""
    body = F.coalesce(F.col("html") if html is None else html, F.lit(""))
    out = pages.select(*[c for c in ("page_id", "url") if c in pages.columns], main_text(body).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
