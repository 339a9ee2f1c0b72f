"""Main text of web pages, by text-to-tag ratios of a streaming parse.

The standard library's parser streams events; a page becomes a list of lines (the text
between two block boundaries), each with the characters and tags it had. The ratio of
the two is smoothed with a Gaussian over neighbouring lines, and a two-means threshold
splits lines into content and the rest. The region is the articles of the page if it
marks some, with the main element around them if that has content of its own, else the
deepest container that holds all content lines. All lines of the region are the text, but
for elements that are boilerplate by name or role, those that a class or id marks and
that also look like it (links, or no line of prose), and blocks of links.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import slices, texts_of

SIGMA = 1.5
#: Elements that can be the region of a page that marks none.
CONTAINERS = frozenset("html body div section td center article main".split())
#: Elements whose lines are judged together if they are links; such lines outside of a list are judged by container.
BLOCKS = CONTAINERS | frozenset("ul ol dl table".split())
#: Share of link text from which a line, and from which an element, counts as links.
LINK_LINE, LINK_ELEMENT = 0.8, 0.5
#: A marked element without a line of so many characters beside its links is boilerplate.
PROSE = 80

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
#: Elements that are never article text.
BOILERPLATE = frozenset(
    "head title script style noscript template nav header footer aside form button select option textarea "
    "iframe object embed svg canvas audio video dialog menu".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Words of a class or id (split at anything but letters and at capitals) that mark boilerplate.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar header masthead footer cookie cookies consent gdpr notice "
    "notices banner popup modal overlay newsletter subscribe subscription signup login share sharing social related "
    "recommended widget pagination pager".split()
)
#: Readers' comments are prose and never article text.
COMMENTS = frozenset("comment comments disqus".split())
#: "has-sidebar" is no sidebar.
NOT_ITSELF = frozenset("has with without no".split())
MAIN = frozenset(("article", "main"))
#: Start tags that end an open element of the same kind; a new block ends a paragraph.
ENDS_ITSELF = frozenset("p li dt dd option tr td th thead tbody tfoot".split())
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section table ul".split()
)
_WORDS = re.compile("[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _is_boilerplate(tag: str, attributes: dict[str, str | None]) -> bool:
    if tag in BOILERPLATE or (attributes.get("role") or "").lower() in ROLES:
        return True
    if "hidden" in attributes or (attributes.get("aria-hidden") or "").lower() == "true":
        return True
    if _HIDDEN.search(attributes.get("style") or ""):
        return True
    return _named(COMMENTS, tag, attributes)


def _named(marks: frozenset[str], tag: str, attributes: dict[str, str | None]) -> bool:
    """Whether the class or id has one of the words."""
    if tag in ("body", "html", "main"):
        return False
    words = [w.lower() for w in _WORDS.findall(f"{attributes.get('class') or ''} {attributes.get('id') or ''}")]
    return any(w in marks and before not in NOT_ITSELF for before, w in zip(["", *words], words))


class _Lines(HTMLParser):
    """Collects (text, tags, link characters, boilerplate, path) of each line of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, bool, tuple[int, ...]]] = []
        self.kinds: dict[int, str] = {}  # tags of the elements on paths
        self.marked: dict[int, str] = {}  # article and main elements by number
        self.suspect: set[int] = set()  # elements that a class or id marks
        self._stack: list[tuple[str, int, bool]] = []  # tag, number, boilerplate here or above
        self._next = 0
        self._parts: list[str] = []
        self._tags = self._linked = self._open_links = 0

    def _flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self._parts)).strip()
        if text:
            bad = bool(self._stack) and self._stack[-1][2]
            path = tuple(n for tag, n, _ in self._stack if tag not in INLINE or n in self.suspect)
            self.lines.append((text, self._tags, self._linked, bad, path))
        if text or self._parts:
            self._tags = self._linked = 0
        self._parts = []

    def _pop_to(self, at: int) -> None:
        if any(
            tag not in INLINE or n in self.suspect or bad != (k > 0 and self._stack[k - 1][2])
            for k, (tag, n, bad) in enumerate(self._stack[at:], at)
        ):
            self._flush()
        for tag, _, _ in self._stack[at:]:
            self._open_links -= tag == "a"
        del self._stack[at:]

    def _last(self, tag: str, until: frozenset[str] = frozenset()) -> int:
        for k in range(len(self._stack) - 1, -1, -1):
            if self._stack[k][0] == tag:
                return k
            if self._stack[k][0] in until:
                break
        return -1

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in ENDS_PARAGRAPH and (at := self._last("p", frozenset(("table", "td", "button")))) >= 0:
            self._pop_to(at)
        if tag in ENDS_ITSELF and tag != "p" and (at := self._last(tag, frozenset(("ul", "ol", "dl", "table", "select")))) >= 0:
            self._pop_to(at)
        if tag not in INLINE:
            self._flush()
        self._tags += 1
        if tag in VOID:
            return
        above = bool(self._stack) and self._stack[-1][2]
        bad = above or _is_boilerplate(tag, dict(attrs))
        suspect = not bad and _named(MARKS, tag, dict(attrs))
        if (bad and not above) or suspect:
            self._flush()
        self._next += 1
        self.kinds[self._next] = tag
        if suspect:
            self.suspect.add(self._next)
        if tag in MAIN and not bad:
            self.marked[self._next] = tag
        self._open_links += tag == "a"
        self._stack.append((tag, self._next, bad))

    def handle_startendtag(self, tag: str, attrs) -> None:
        # a slash closes void elements only; others stay open, as in browsers
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self._tags += 1
        at = self._last(tag)
        if at >= 0:
            self._pop_to(at)
        elif tag not in INLINE:
            self._flush()

    def handle_data(self, data: str) -> None:
        if self._stack and self._stack[-1][0] in ("script", "style"):
            return
        self._parts.append(data)
        if self._open_links:
            self._linked += len(data)

    def close(self) -> None:
        super().close()
        self._flush()


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian average over neighbours, normalised at both ends."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    total = np.convolve(ratios, kernel)[reach : reach + len(ratios)]
    return total / np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]


def two_means_threshold(values: np.ndarray) -> float:
    """Midpoint between the two centres of a one-dimensional two-means clustering."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        middle = (low + high) / 2
        upper = values > middle
        if not upper.any() or upper.all():
            break
        new = float(values[~upper].mean()), float(values[upper].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def _looks_like_boilerplate(lines: list[tuple], rich: list[bool], elements: set[int]) -> set[int]:
    """Those of the ``elements`` that are mostly links or hold no rich line."""
    size, links, prose = dict.fromkeys(elements, 0), dict.fromkeys(elements, 0), set()
    for (text, _, linked, bad, path), is_rich in zip(lines, rich):
        for n in elements.intersection(path) if not bad else ():
            size[n] += len(text)
            links[n] += linked
            if is_rich and len(text) - linked >= PROSE:
                prose.add(n)
    return {n for n in elements if n not in prose or links[n] >= LINK_ELEMENT * size[n]}


def main_text(html: str) -> str:
    parser = _Lines()
    parser.feed(html)
    parser.close()
    lines, kinds = parser.lines, parser.kinds
    if not any(not bad for *_, bad, _ in lines):
        return ""
    ratios = np.array([len(text) / max(tags, 1) for text, tags, *_ in lines])
    smooth = smoothed(ratios)
    threshold = two_means_threshold(smooth)
    # one huge line must not hide ordinary prose
    prose = min(threshold, float(np.expm1(two_means_threshold(np.log1p(smooth)))))
    content = ((smooth >= threshold) | ((smooth >= prose) & (ratios >= prose))).tolist()
    dropped = _looks_like_boilerplate(lines, (ratios >= prose).tolist(), parser.suspect) if parser.suspect else set()
    if dropped:
        lines = [(text, tags, linked, bad or not dropped.isdisjoint(path), path) for text, tags, linked, bad, path in lines]
    weight = [len(text) - linked if not bad else 0 for text, _, linked, bad, _ in lines]
    heads = [any(kinds[n] == "h1" for n in path[-1:]) for *_, path in lines]
    voting = [
        w > 0 and (c or head) and line[2] < LINK_ELEMENT * len(line[0])
        for w, c, head, line in zip(weight, content, heads, lines)
    ]
    if parser.suspect:
        # text that a class or id marks moves the region only if it is most of the content
        clear = [v and parser.suspect.isdisjoint(line[4]) for v, line in zip(voting, lines)]
        if 2 * sum(w for w, c in zip(weight, clear) if c) >= sum(w for w, v in zip(weight, voting) if v):
            voting = clear
    if not any(voting):
        voting = [w > 0 for w in weight] if any(weight) else [not line[3] for line in lines]
    # a marked region without a vote may still be a short article
    marked = [n for n in parser.marked if any(not bad and n in path for *_, bad, path in lines)]
    if marked:
        regions = _marked_regions(lines, weight, voting, marked, parser.marked)
        articles = {n for n in regions if parser.marked[n] == "article"} or regions
    else:
        common = set.intersection(*(set(path) for (*_, path), v in zip(lines, voting) if v)) if any(voting) else set()
        regions, articles = {max((n for n in common if kinds[n] in CONTAINERS), default=0)}, set()

    def block(path: tuple[int, ...]) -> int:
        return next((n for n in reversed(path) if kinds[n] in BLOCKS), 0)

    held = {block(path) for (*_, path), v in zip(lines, voting) if v}
    kept = [
        text
        for (text, _, linked, bad, path), c in zip(lines, content)
        if not bad
        and (0 in regions or not regions.isdisjoint(path))
        and (c or linked < LINK_LINE * len(text) or not articles.isdisjoint(path) or block(path) in held)
    ]
    return " ".join(kept)


def _marked_regions(lines: list[tuple], weight: list[int], voting: list[bool], marked: list[int], kinds: dict[int, str]) -> set[int]:
    """The article with most votes, all others that are not links, and main elements with content outside of them."""
    held, size, links = (dict.fromkeys(marked, 0) for _ in range(3))
    for (text, _, linked, bad, path), w, v in zip(lines, weight, voting):
        for n in held.keys() & set(path) if not bad else ():
            held[n] += w if v else 0
            size[n] += len(text)
            links[n] += linked
    articles = [n for n in marked if kinds[n] == "article"]
    if not articles:
        return set(marked)
    best = max(articles, key=lambda n: (held[n], -n))
    regions = {n for n in articles if n == best or links[n] < LINK_ELEMENT * size[n]}
    outside = [set(path) for (*_, path), v in zip(lines, voting) if v and regions.isdisjoint(path)]
    return regions | {n for n in marked if kinds[n] == "main" and any(n in path for path in outside)}


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep``, ``text`` and ``n_chars`` (its code points) of every row of ``pages``.

    A null or empty page, or one without article text, gives an empty text. Pages are
    read whole; broken markup is read as far as it goes. Repeated rows stay repeated,
    other columns of ``pages`` are left aside, an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(h) for h in texts_of(batch, "html").to_pylist()]
            sizes = [len(t) for t in texts]
            kept = [batch.column(f"keep{i}") for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], [*keep, "text", "n_chars"])

    narrow = pages.select(*[F.col(c).alias(f"keep{i}") for i, c in enumerate(keep)], F.col(html).alias("html"))
    head = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep]
    return narrow.mapInArrow(run, ", ".join([*head, "text string", "n_chars bigint"]))
