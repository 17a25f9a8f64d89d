"""Main text of web pages from parser events: text-to-tag ratios of lines, smoothed and clustered into regions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose text is never part of an article.
SILENT = frozenset("head title script style noscript template iframe object svg canvas button select textarea input label fieldset option datalist".split())
#: Elements that mark page furniture; header does so outside of articles only.
FURNITURE = frozenset("nav footer aside dialog menu form header".split())
MAIN = frozenset("article main".split())
#: Elements that can be content regions.
REGIONS = MAIN | frozenset("body section div td form center".split())
#: Elements that their own kind, or a block in the case of p, closes.
CLOSED_BY = {"p": BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
SCOPE = frozenset("article aside body div footer form header html li main nav section table td ul ol dl blockquote".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Fixed words of class, id and role that mark furniture.
MARKS = frozenset(
    "ad ads adbox adslot advert advertisement adverts banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies dialog disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices paywall popup promo promoted promotion related recommended respond replies search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
#: Those of them that mark talk about an article, which may be longer than the article.
TALK = frozenset("comment comments commentlist disqus replies respond".split())
#: Those that also name parts of articles: alone they say nothing of what an article holds, unless it is mostly links.
AMBIGUOUS = frozenset("dialog header masthead menu nav navbar navigation notice notices replies search toolbar".split())
#: Words that go with a mark in the name of a piece of furniture; any other word beside it makes the name ambiguous.
PLAIN = frozenset("area bar block bottom box button buttons container content form group holder inner item items large left link links list main mobile module outer panel primary right section secondary side site slot small text title top unit wide wrap wrapper".split())
#: Words beside which header names the head of an article, not that of a site.
OF_ARTICLE = frozenset("article content entry page post story title".split())
_TOKEN = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
#: Deviation of the smoothing in lines, and the ratio of cluster means below which they count as two.
SIGMA, APART = 1.5, 0.4
#: Lines of links in a row that make a list of links.
LINK_LIST = 3
#: How much text in article and main elements, and text that marks call furniture, weighs in.
MAIN_WEIGHT, FURNITURE_WEIGHT = 2.0, 0.25
#: Shares of the weight of content lines from which on an article or main element, or another one, is the region.
MAIN_SHARE, REGION_SHARE = 0.75, 0.9


@dataclass
class Line:
    """A block of text. parts are (mark, data, linked); container is the innermost element of REGIONS around it; level that of a heading, or 0."""

    parts: list[tuple[int, str, bool]]
    tags: int
    container: int
    level: int

    def text(self, out: list[bool]) -> str:
        """The text without parts under marks that are out; white space is single."""
        return " ".join("".join(data for mark, data, _ in self.parts if not out[mark]).split())

    def chars(self, linked: bool) -> int:
        return sum(len(data.strip()) for _, data, link in self.parts if link == linked)


@dataclass
class Mark:
    """An element that its name, class, id or role marks as furniture; whether it is that is known at the page's end."""

    parent: int
    talk: bool = False
    head: bool = False
    element: bool = False
    container: int = 0
    chars: int = 0
    ambiguous: bool = False
    linked: int = 0


@dataclass
class Container:
    """An element of REGIONS; mark is the innermost mark at or above it, main the innermost article or main at or above it."""

    parent: int
    tag: str
    mark: int
    main: int


@dataclass
class Open:
    tag: str
    out: bool
    container: int
    mark: int
    linked: bool
    level: int
    closed: bool = False


class Lines(HTMLParser):
    """Turns parser events into block lines, and keeps the tree of containers and of marks.

    The positions of open elements are kept by name, so that each event takes constant time on average however
    deep and however badly nested the markup is.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open = [Open("", False, 0, 0, False, 0)]
        self.at: dict[str, list[int]] = {}
        self.scopes: list[int] = []
        self.marks = [Mark(0)]
        self.containers = [Container(0, "", 0, 0)]
        self.lines: list[Line] = []
        self._parts: list[tuple[int, str, bool]] = []
        self._tags = 0

    def _flush(self) -> None:
        if any(data and not data.isspace() for _, data, _ in self._parts):
            top = self.open[-1]
            self.lines.append(Line(self._parts, self._tags, top.container, top.level))
        self._parts, self._tags = [], 0

    def _pop(self, to: int) -> None:
        """Closes the open elements from position `to` on, and what was closed out of turn below it."""
        while len(self.open) > to or self.open[-1].closed:
            e = self.open.pop()
            if not e.closed:
                self.at[e.tag].pop()
            if self.scopes and self.scopes[-1] == len(self.open):
                self.scopes.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._tags += 1
        if tag in BLOCK:
            self._flush()
            closes = max((self.at[name][-1] for name, by in CLOSED_BY.items() if tag in by and self.at.get(name)), default=0)
            if closes and closes >= (self.scopes[-1] if self.scopes else 0):
                self._pop(closes)
        if tag == "br":
            self._parts.append((0, " ", False))
        if tag in VOID:
            return
        up = self.open[-1]
        out = up.out or tag in SILENT or (bool(attrs) and self._hidden(attrs))
        mark, container, main = up.mark, up.container, self.containers[up.container].main
        words = self._words(tag, attrs) if attrs and not out and tag not in ("html", "body", "main") else frozenset()
        if not out and (words or (tag in FURNITURE and not (tag == "header" and main))):
            self.marks.append(Mark(mark, not words.isdisjoint(TALK), tag == "header" or words == {"header"}, tag in FURNITURE and tag != "form", container, 0, tag not in FURNITURE and self._ambiguous(words, attrs)))
            mark = len(self.marks) - 1
        if tag in REGIONS:
            self.containers.append(Container(container, tag, mark, len(self.containers) if tag in MAIN and not out and not words else main))
            container = len(self.containers) - 1
        self.at.setdefault(tag, []).append(len(self.open))
        if tag in SCOPE:
            self.scopes.append(len(self.open))
        self.open.append(Open(tag, out, container, mark, up.linked or tag == "a", int(tag[1]) if tag in HEADINGS else up.level))

    @staticmethod
    def _words(tag: str, attrs: list[tuple[str, str | None]]) -> frozenset[str]:
        """The words of MARKS that apply to the element."""
        found: set[str] = set()
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                for one in value.split():
                    tokens = [t.lower() for t in _TOKEN.findall(one)]
                    hit = MARKS.intersection(tokens)
                    if tag == "article":
                        # Only a comment's own name makes an article one; articles carry many words about comments.
                        hit = hit & {"comment"} if tokens[:1] == ["comment"] else frozenset()
                    elif hit == {"header"} and (tag in HEADINGS or not OF_ARTICLE.isdisjoint(tokens)):
                        hit = frozenset()
                    found |= hit
        return frozenset(found)

    @staticmethod
    def _ambiguous(words: frozenset[str], attrs: list[tuple[str, str | None]]) -> bool:
        """Whether each name that gave a mark may as well name part of an article."""
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                for one in value.split():
                    tokens = {t.lower() for t in _TOKEN.findall(one)}
                    if (tokens & words) - AMBIGUOUS and tokens <= MARKS | PLAIN:
                        return False
        return True

    @staticmethod
    def _hidden(attrs: list[tuple[str, str | None]]) -> bool:
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and value and "display:none" in value.replace(" ", "")):
                return True
        return False

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self._tags += 1
        if tag == "br":
            self._parts.append((0, " ", False))
        if not self.at.get(tag):
            return
        at = self.at[tag][-1]
        if tag in BLOCK:
            self._flush()
            self._pop(at)
        elif not self.scopes or self.scopes[-1] < at:
            # An inline element closes across others, which stay open.
            self.at[tag].pop()
            self.open[at].closed = True
            self._pop(len(self.open))

    def handle_data(self, data: str) -> None:
        top = self.open[-1]
        if not top.out:
            self._parts.append((top.mark, data, top.linked))

    def read(self, html: str) -> "Lines":
        self.feed(html)
        self.close()
        self._flush()
        return self


def doubtful(page: Lines) -> list[bool]:
    """For each mark whether it may be furniture. It isn't, with all marks above it, where it holds a main element or, if no article
    stands outside of all marks, the longest article or most of the page's text that isn't links. Talk and elements such as
    nav never are content by their length. An ambiguous name inside of an article or main element isn't either, unless most of what it holds is links.
    """
    marks, containers = page.marks, page.containers
    plain, by_container = 0, [0] * len(containers)
    for line in page.lines:
        for mark, data, linked in line.parts:
            n = 0 if linked else len(data.strip())
            plain += n
            marks[mark].chars += n
            marks[mark].linked += len(data.strip()) - n
            by_container[line.container] += n
    for m in reversed(marks[1:]):
        marks[m.parent].chars += m.chars
        marks[m.parent].linked += m.linked
    for i in range(len(containers) - 1, 0, -1):
        by_container[containers[i].parent] += by_container[i]
    may = [False] + [not (m.ambiguous and containers[m.container].main and m.linked <= m.chars) for m in marks[1:]]

    def talks(mark: int) -> bool:
        while mark and not marks[mark].talk:
            mark = marks[mark].parent
        return mark > 0

    mains = [i for i, c in enumerate(containers) if c.main == i and i and by_container[i]]
    sound = [containers[i].mark for i in mains if containers[i].tag == "main"]
    if all(containers[i].mark for i in mains):
        sound += [i for i, m in enumerate(marks) if i and not (m.talk or m.head or m.element) and 2 * m.chars > plain]
        articles = [i for i in mains if not talks(containers[i].mark)]
        sound += [containers[max(articles, key=lambda i: (by_container[i], -i))].mark] if articles else []
    for mark in sound:
        while mark and may[mark]:
            may[mark] = False
            mark = marks[mark].parent
    # What a doubtful mark holds is as doubtful.
    for i in range(1, len(marks)):
        may[i] = may[i] or may[marks[i].parent]
    return may


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines; weights that fall off the ends are left out of the mean."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    centre = slice(reach, reach + len(ratios))
    return np.convolve(ratios, kernel)[centre] / np.convolve(np.ones(len(ratios)), kernel)[centre]


def _content(values: np.ndarray) -> np.ndarray:
    """Which values are above the border between two clusters (two means from the extremes); all, if the two are not far apart."""
    low, high = values.min(), values.max()
    for _ in range(20):
        upper = values > (low + high) / 2
        if not upper.any() or upper.all():
            break
        low, high = values[~upper].mean(), values[upper].mean()
    return values >= (low + high) / 2 if low < APART * high else np.ones(len(values), bool)


def _region(page: Lines, weights: list[float]) -> int:
    """The container that holds the content: the innermost article, else main element, else the innermost other one with its share of the weight."""
    inside = [0.0] * len(page.containers)
    for line, w in zip(page.lines, weights, strict=True):
        inside[line.container] += w
    for i in range(len(inside) - 1, 0, -1):
        inside[page.containers[i].parent] += inside[i]
    total = inside[0]
    by_share = [i for i, c in enumerate(page.containers) if i and inside[i] >= (MAIN_SHARE if c.main == i else REGION_SHARE) * total > 0]
    mains = [i for i in by_share if page.containers[i].main == i]
    # Containers that hold most of the weight lie within each other, and inner ones come later.
    return max((i for i in mains if page.containers[i].tag == "article"), default=0) or max(mains, default=0) or max(by_share, default=0)


def main_text(html: str | None) -> str:
    """The main text of a page: blocks in page order, joined by a newline.

    Ratios of text to tags, of which articles count more and marked furniture less, are smoothed over lines and parted into two
    clusters. The lines of the upper one choose the region: the innermost element that holds most of their text. Of an
    article or main element all blocks count; of others those from the first content line to the last, with headings before
    them, neighbours in the same element and lines whose own ratio is as high beside them. Lists of links and furniture inside the region go; marks
    on the region or around it mean nothing.

    Null and empty pages, and pages without text, give an empty text. Malformed markup is read as the parser
    reads it: elements that are never closed end with their parent.
    """
    page = Lines().read(html or "")
    lines, containers, marks = page.lines, page.containers, page.marks
    if not lines:
        return ""
    may = doubtful(page)
    share = [FURNITURE_WEIGHT if x else 1.0 for x in may]
    boost = [MAIN_WEIGHT if containers[x.container].main else 1.0 for x in lines]
    lengths = [b * sum(len(data) * share[mark] for mark, data, _ in x.parts) for x, b in zip(lines, boost, strict=True)]
    ratios = np.array([n / max(1, x.tags) for n, x in zip(lengths, lines, strict=True)], float)
    smooth = smoothed(ratios)
    upper = _content(smooth)
    # Of the upper cluster by itself, and not only by what stands beside it.
    alone = upper & (ratios >= APART * smooth[upper].min())
    chars = [b * sum(len(data.strip()) * share[mark] for mark, data, linked in x.parts if not linked) for x, b in zip(lines, boost, strict=True)]
    holds = {x.container for x, c in zip(lines, upper, strict=True) if c}
    titles = [i for i, x in enumerate(lines) if x.level == 1]
    linked = [2 * x.chars(True) > x.chars(True) + x.chars(False) for x in lines]
    plain = [x.text(may) != "" for x in lines]
    # By the lines of the upper cluster; where those are all furniture by all other lines; else by all.
    for counted in (upper, plain, [True] * len(lines)):
        region = _region(page, [n if c else 0.0 for n, c in zip(chars, counted, strict=True)])
        out = list(may)
        mark = containers[region].mark
        while mark:
            out[mark] = False
            mark = marks[mark].parent
        for i, m in enumerate(marks):
            if m.head and m.container in holds and containers[m.container].tag not in ("", "body") and titles and all(i == p[0] for x in titles for p in lines[x].parts):
                out[i] = False  # the head of an element that holds content, with the page's title
            out[i] = out[i] or out[m.parent]
        inside = [False] * len(containers)
        for i, c in enumerate(containers):
            inside[i] = i == region or (i > 0 and inside[c.parent])
        texts = [x.text(out) for x in lines]
        mine = [bool(t) and inside[x.container] for x, t in zip(lines, texts, strict=True)]
        at = [i for i, c in enumerate(counted) if c and mine[i] and not linked[i]]
        if at:
            break
    if region and containers[region].main == region:
        return "\n".join(t for t, m in zip(texts, mine, strict=True) if m)
    at = at or [i for i, m in enumerate(mine) if m]
    if not at:
        return ""
    first, last = at[0], at[-1]
    around = {lines[i].container for i in at}
    beside = lambda i: (mine[i] and lines[i].container in around) or (bool(texts[i]) and bool(alone[i]))
    while first and (lines[first - 1].level or not linked[first - 1]) and (not texts[first - 1] or lines[first - 1].level or beside(first - 1)):
        first -= 1
    while last + 1 < len(lines) and not linked[last + 1] and beside(last + 1):
        last += 1
    kept, row = [], []
    for i in range(first, last + 1):
        if texts[i] and linked[i]:
            row.append(texts[i])
            continue
        # One line or two that are links are part of what is told; more are a list of links.
        kept += row if len(row) < LINK_LIST else []
        row = []
        kept += [texts[i]] if texts[i] else []
    return "\n".join(kept + (row if len(row) < LINK_LIST else []))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages (page_id, url, html); see main_text.

    n_chars counts code points. Repeated rows each get a row, an empty table gives an empty one, further columns
    are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t.encode("utf-8", "replace").decode() for t in texts], pa.string())], ["page_id", "url", "text"])

    kinds = dict(pages.dtypes)
    out = pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
