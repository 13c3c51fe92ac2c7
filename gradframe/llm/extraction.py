"""Main text of web pages from parser events and text-to-tag ratios.

The standard library's parser gives events; block tags cut the page into lines. A
line's ratio is its number of characters over its number of tags. The ratios are
smoothed with a Gaussian and split into two clusters by a threshold that starts at their
mean and moves to the middle of the clusters' means. Lines under menus, headers, footers, side
bars, adverts, forms, scripts and comments, told by tag, role or class, are no
candidates, unless an article lies in a part so named, or it wraps most of the page's text; weaker words in
names only lower the ratios. Articles and main parts are kept whole, but for parts in them with weak names and no line of
the upper cluster. Without them a region, the lines between two marked parts, is kept whole
if it has a line of the upper cluster, so short paragraphs and headings stay.

Depths of open elements are kept by tag, so the work is linear in the length of a page whatever
its nesting is.

Defined cases: null or empty html, or a page without candidates, gives the empty text;
a page whose candidate lines are all alike is kept whole; repeated rows give repeated results; pages
of any length are fed to the parser in pieces; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradframe.session import ship

# fixed values: tags that begin and end a line
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table "
    "tbody td tfoot th thead title tr ul".split()
)
# fixed values: tags without an end
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# fixed values: tags whose content is never main text
OUT = frozenset(
    "head nav footer aside form script style noscript template svg math button select option textarea iframe "
    "object canvas audio video menu dialog title".split()
)
# fixed values: words in class, id or role that mark such content
HINTS = frozenset(
    "ad ads adv advert advertisement advertising adsense banner sponsor sponsored promo promotion sidebar nav "
    "navbar navigation menu footer foot masthead topbar cookie cookies consent gdpr notification alert popup "
    "modal overlay newsletter subscribe signup login comment comments reply replies disqus share sharing social "
    "recommended breadcrumb breadcrumbs pagination pager toolbar skip contentinfo complementary".split()
)
COMMENTS = frozenset("comment comments disqus reply replies".split())
# fixed values: words that only lower the ratio of the lines inside
WEAK = frozenset("side related discussion notice widget search".split())
# fixed values: words that say in a compound that the part is there, missing or beside, and those that name the text
MODIFIERS = frozenset("has no not non with without hide show open closed enabled disabled on off".split())
LAYOUT = frozenset("content main layout wrap wrapper container".split())
LOWERED = 0.5
CLOSES_P = BLOCKS - {"title", "html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
SCOPES = frozenset("html body article main section div td th li blockquote table".split())
SHUT = frozenset(("aside", "footer"))
WRAPPED = 0.75  # of a page's text, in a part that is then taken for a wrapper whatever its name is
FEED = 1 << 16
SIGMA = 1.0
RADIUS = 3
_NAME = re.compile(r"[a-z]+")
_KERNEL = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)


class Mark:
    """A part whose names say that it is no text."""

    def __init__(self, outer: int, comments: bool):
        self.outer, self.comments = outer, comments  # number of the enclosing mark or -1; inside comments
        self.live, self.titled = True, False  # still out of the text; holds a heading


class Lines(HTMLParser):
    """Collects ``[text, tags, region, mark, ratio lowered, innermost tag]`` of every line."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[list] = []
        self.parts: list[str] = []
        self.tags = 0
        # tag, out of the text, number of the enclosing article, innermost mark, ratios lowered
        self.stack: list[tuple[str, bool, int, int, bool]] = []
        self.at: dict[str, list[int]] = {}  # depths of the open elements of each tag
        self.scopes: list[int] = []  # depths of those that a p does not reach beyond
        self.shut = 0  # open asides and footers that are out of the text
        self.marks: list[Mark] = []
        self.region = 0
        self.articles = 0
        self.lowered: set[int] = set()  # regions of named parts inside articles

    def _state(self) -> tuple[bool, int, int, bool]:
        return self.stack[-1][1:] if self.stack else (False, 0, -1, False)

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            _, article, mark, weak = self._state()
            tag = self.stack[-1][0] if self.stack else ""
            self.lines.append([text, max(1, self.tags), article or -self.region - 1, mark, weak, tag])
        self.parts, self.tags = [], 0

    def _push(self, tag: str, out: bool, article: int, mark: int, weak: bool) -> None:
        self.at.setdefault(tag, []).append(len(self.stack))
        if tag in SCOPES:
            self.scopes.append(len(self.stack))
        self.shut += out and tag in SHUT
        self.stack.append((tag, out, article, mark, weak))

    def _pop(self, depth: int) -> None:
        before = self._state()
        while len(self.stack) > depth:
            tag, out, *_ = self.stack.pop()
            self.at[tag].pop()
            if tag in SCOPES:
                self.scopes.pop()
            self.shut -= out and tag in SHUT
        after = self._state()
        if before[0] and not after[0] or before[2:] != after[2:]:
            self.region += 1  # a part that is no text, or is marked, ended

    def candidates(self) -> list[list]:
        """The lines that lie in no marked part."""
        sizes = [0] * len(self.marks)
        paragraphs = [0] * len(self.marks)
        for text, _, _, mark, _, tag in self.lines:
            if mark >= 0:
                sizes[mark] += len(text)
                paragraphs[mark] += tag == "p"
        for m in range(len(self.marks) - 1, -1, -1):  # inner marks have the higher numbers
            outer = self.marks[m].outer
            if outer >= 0:
                sizes[outer] += sizes[m]
                paragraphs[outer] += paragraphs[m]
        whole = sum(len(line[0]) for line in self.lines)
        out: list[bool] = []
        for mark, size, count in zip(self.marks, sizes, paragraphs):
            wraps = not mark.comments and mark.titled and count > 1 and size > WRAPPED * whole
            out.append(mark.live and not wraps or mark.outer >= 0 and out[mark.outer])
        return [line for line in self.lines if line[3] < 0 or not out[line[3]]]

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in BLOCKS:
            self._flush()
            if tag in CLOSES_P:
                opened = self.at.get("p")
                if opened and (not self.scopes or opened[-1] > self.scopes[-1]):
                    self._pop(opened[-1])
            if tag == "h1" or tag == "h2":
                self._titled()
        elif tag == "br":
            self.parts.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        out, article, mark, weak = self._state()
        own_out = self._out(tag, attrs, article)
        strong, lowers, comments = (False, False, False) if own_out else self._marked(tag, attrs)
        if tag in ("article", "main") and not own_out and not strong:
            if out and not self.shut:
                out = False  # an unclosed part before the article does not swallow it
            if mark < 0 or not self.marks[mark].comments:
                outer = mark
                while outer >= 0 and self.marks[outer].live:
                    self.marks[outer].live = False  # what holds an article is no sidebar
                    outer = self.marks[outer].outer
            if not article:
                self.articles += 1
                article = self.articles
        if own_out and not out or strong or lowers:
            self.region += 1
        if strong:
            self.marks.append(Mark(mark, comments or mark >= 0 and self.marks[mark].comments))
            mark = len(self.marks) - 1
        if (strong or lowers) and article:
            self.articles += 1
            article = self.articles  # a region of its own
            if lowers:
                self.lowered.add(article)
        self._push(tag, out or own_out, article, mark, weak or lowers)

    def _titled(self) -> None:
        """A heading lies in all marked parts that are open."""
        mark = self._state()[2]
        while mark >= 0 and not self.marks[mark].titled:
            self.marks[mark].titled = True
            mark = self.marks[mark].outer

    def _out(self, tag: str, attrs, article: int) -> bool:
        """Whether an element's tag or attributes take it out of the text."""
        if tag in OUT or tag == "header" and not article:
            return True
        if self._plain(tag):
            return False
        return any(k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and "display:none" in v.replace(" ", "") for k, v in attrs)

    @staticmethod
    def _plain(tag: str) -> bool:
        return tag in ("html", "body", "main") or tag[0] == "h" and tag[1:].isdigit()

    def _marked(self, tag: str, attrs) -> tuple[bool, bool, bool]:
        """Whether names mark an element as no text, lower its ratios, and speak of comments."""
        strong = lowers = comments = False
        if not self._plain(tag):
            for name in (n for k, v in attrs if k in ("class", "id", "role") and v for n in v.lower().split()):
                words = set(_NAME.findall(name))
                if words & MODIFIERS:
                    continue
                if words & HINTS and not words & LAYOUT:
                    strong, comments = True, comments or bool(words & COMMENTS)
                elif words & (HINTS | WEAK):
                    lowers = True
        if tag == "article":
            return comments, False, comments
        return strong, lowers and not strong, comments

    def handle_startendtag(self, tag: str, attrs) -> None:
        if tag in BLOCKS:
            self._flush()
        elif tag == "br":
            self.parts.append(" ")
        self.tags += 1

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._flush()
        self.tags += 1
        opened = self.at.get(tag)
        if opened:
            self._pop(opened[-1])

    def handle_data(self, data: str) -> None:
        if not self._state()[0]:
            self.parts.append(data)


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Gaussian smoothing; at the ends the kernel's rest is scaled up."""
    weight = np.convolve(np.ones(len(ratios)), _KERNEL, "same") if len(ratios) >= len(_KERNEL) else None
    if weight is None:
        padded = np.pad(ratios, RADIUS)
        ones = np.pad(np.ones(len(ratios)), RADIUS)
        return np.convolve(padded, _KERNEL, "valid") / np.convolve(ones, _KERNEL, "valid")
    return np.convolve(ratios, _KERNEL, "same") / weight


def threshold(values: np.ndarray) -> float:
    """Border of two clusters: the middle of the means on its sides."""
    border = values.mean()
    for _ in range(50):
        low, high = values[values < border], values[values >= border]
        if not len(low) or not len(high):
            break
        moved = (low.mean() + high.mean()) / 2
        if moved == border:
            break
        border = moved
    return float(border)


def main_text(html: str | None) -> str:
    """Main text of a page, its blocks one per line."""
    parser = Lines()
    for at in range(0, len(html or ""), FEED):
        parser.feed(html[at : at + FEED])
    parser.close()
    parser._flush()
    lines = parser.candidates()
    if not lines:
        return ""
    ratios = smoothed(np.array([len(text) / tags for text, tags, *_ in lines]))
    ratios = ratios * np.where([line[4] for line in lines], LOWERED, 1.0)
    border = threshold(ratios)
    regions = {line[2] for line, ratio in zip(lines, ratios) if ratio >= border}
    articles = {line[2] for line in lines if line[2] > 0}
    if articles:  # all of the articles, parts with weak names by their ratios; nothing beside them
        regions = articles - (parser.lowered - regions)
    return "\n".join(line[0] for line in lines if line[2] in regions)


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    ship(pages.sparkSession)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html.as_py()) for html in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"]
            )

    own = pages.select(pages["page_id"].cast("bigint"), pages["url"].cast("string"), pages["html"].cast("string"))
    found = own.mapInArrow(extract, "page_id bigint, url string, text string")
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
