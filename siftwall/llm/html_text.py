"""Main text of web pages by line-block distribution.

Markup is stripped to *lines*, one per block of the page. A line weighs its characters
outside links; blocks that the page itself marks as something other than the article
(menus, footers, forms, adverts, reader comments) are stripped with the markup. Weights are
summed over sliding windows of lines: where the sum surges the text begins, where it dives
it ends, and what lies between is kept, light lines included.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filled, text_blocks

#: Lines in a window.
WINDOW = 3
#: Characters a window needs for a surge where no element marks the article; less if the
#: page's fullest window has less than SHARE times as many.
SURGE, SHARE = 80, 4

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Elements whose content is not markup.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never belong to the article's text.
_WALLS = frozenset(
    "nav header footer aside form button select datalist dialog menu template noscript "
    "object svg canvas audio video map head".split()
)
_WALL_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split()
)
#: Elements that hold lines of their own, and those among them that hold other blocks.
_DIVISIONS = frozenset(
    "html body div section article main center table thead tbody tfoot tr td th ul ol dl blockquote "
    "figure details fieldset header footer aside nav form dialog address hgroup menu".split()
)
_BLOCKS = _DIVISIONS | frozenset(
    "p h1 h2 h3 h4 h5 h6 li dt dd pre caption figcaption summary legend hr option".split()
)
_HEADINGS = ("h1", "h2", "h3")
_CLOSED_BY_SELF = frozenset("li dt dd tr td th option".split())
#: Names of classes and ids of blocks that are not the article.
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar masthead header footer cookie cookies "
    "consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share "
    "sharing social related recommended pagination pager toolbar copyright widget".split()
)
_COMMENT_NAMES = frozenset("comment comments respond disqus reply replies".split())
_NOT_NAMES = frozenset("no has with without".split())
_TITLE_NAMES = frozenset("article post entry story content".split())


def _named(value: str) -> str:
    """What the names of a class or id attribute say: ``""``, ``wall`` or ``comment``."""
    found = ""
    for name in value.split():
        parts = [p.lower() for p in _PARTS.findall(name)]
        if not parts or _NOT_NAMES & set(parts):
            continue
        if _COMMENT_NAMES & set(parts):
            return "comment"
        ends = {name.lower(), parts[0], parts[-1]} & _NAMES
        if ends and not (ends == {"header"} and _TITLE_NAMES & set(parts)):
            found = "wall"
    return found


def _wall(tag: str, attributes: str, inside: bool) -> str:
    """Why an element is not part of the article: ``""``, ``tag``, ``wall`` or ``comment``.

    ``inside`` tells that an article or main element is open.
    """
    if tag in ("html", "body"):
        return ""
    if tag in _WALLS and not (tag == "header" and inside):
        return "tag"
    if not attributes or attributes.isspace():
        return ""
    kind = ""
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            said = _named(value)
            if said == "comment":
                return said
            if tag not in ("article", "main"):
                kind = said or kind
        elif key == "role" and value.lower() in _WALL_ROLES:
            return "tag"
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return "tag"
        elif key == "style" and "display:none" in value.replace(" ", "").lower():
            return "tag"
    return kind


class _Lines:
    """Lines of one page: text, weight, container, the article and main around, if a heading."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, int, int, int, int, bool]] = []
        self.parents = [0]
        self.whole = {0}  # the elements that hold the page as a whole
        self.articles: Counter[int] = Counter()  # main element -> articles in it
        self.stack: list[tuple] = []
        self.open: Counter[str] = Counter()
        self.walls = self.links = 0
        self.container = self.article = self.main = 0
        self.pieces: list[str] = []
        self.linked = 0

    def text(self, raw: str) -> None:
        if raw and not self.walls:
            piece = html.unescape(raw)
            self.pieces.append(piece)
            if self.links:
                self.linked += len("".join(piece.split()))

    def flush(self) -> None:
        if self.pieces:
            words = "".join(self.pieces).split()
            if words:
                weight = sum(map(len, words)) - self.linked
                title = any(self.open[h] for h in _HEADINGS)
                place = (self.container, self.article, self.main)
                self.rows.append((" ".join(words), max(0, weight), *place, title))
            self.pieces = []
        self.linked = 0

    def start(self, tag: str, attributes: str) -> None:
        block = tag in _BLOCKS
        if block:
            if self.open["p"] and tag != "option":
                self.end("p")
            elif tag in _CLOSED_BY_SELF and self.stack and self.stack[-1][0] == tag:
                self.end(tag)
            self.flush()
        elif tag == "br":
            self.text(" ")
        if tag in _VOID:
            return
        state = (tag, self.walls, self.links, self.container, self.article, self.main)
        why = _wall(tag, attributes, bool(self.article or self.main))
        if tag == "article" and self.article:
            why = why or "comment"  # an article in an article is a remark on it
        if why:
            # what only its name speaks against may still hold the article
            self.walls = max(self.walls, 1 if why == "wall" else 2)
        if tag in ("article", "main") and self.walls < 2:
            self.walls = 0
        if tag == "a":
            self.links += 1
        if tag in _DIVISIONS:
            self.parents.append(self.container)
            self.container = len(self.parents) - 1
            if tag in ("html", "body"):
                self.whole.add(self.container)
            elif tag == "article" and not self.walls:
                self.article = self.container
                self.articles[self.main] += 1
            elif tag == "main" and not self.walls:
                self.main = self.container
        self.stack.append(state)
        self.open[tag] += 1

    def end(self, tag: str) -> None:
        if tag in _BLOCKS:
            self.flush()
        if not self.open[tag]:
            return
        while True:
            name, walls, links, container, article, main = self.stack.pop()
            self.open[name] -= 1
            if name in _BLOCKS:
                self.flush()
            self.walls, self.links = walls, links
            self.container, self.article, self.main = container, article, main
            if name == tag:
                return


def _lines(page: str) -> _Lines:
    out = _Lines()
    at = 0
    while True:
        m = _TAG.search(page, at)
        out.text(page[at : m.start()] if m else page[at:])
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            out.end(tag)
            continue
        out.start(tag, m[3])
        if tag in _RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = close.end() if close else len(page)
            out.end(tag)
    while out.stack:
        out.end(out.stack[-1][0])
    out.flush()
    return out


def _runs(weights: list[int], least: int) -> list[tuple[int, int]]:
    """Lines from each surge to the dive after it, as ``[first, last]``.

    A surge is where the sum of a window reaches ``least``; the dive is where it no longer
    does. Weightless lines at either end are left out.
    """
    sums = [0]
    for w in weights:
        sums.append(sums[-1] + w)
    n, found, first = len(weights), [], None
    for i in range(n + 1):
        full = i < n and sums[min(n, i + WINDOW)] - sums[i] >= least
        if full and first is None:
            first = i
        elif not full and first is not None:
            a, b = first, i - 1
            while a < b and not weights[a]:
                a += 1
            while b > a and not weights[b]:
                b -= 1
            found.append((a, b))
            first = None
    return found


def _home(rows: list[tuple], parents: list[int], first: int, last: int) -> tuple[int, list[bool]]:
    """The deepest element with three fifths of a run's weight; per element, if it lies in it."""
    own = [0] * len(parents)
    for r in rows[first : last + 1]:
        own[r[2]] += r[1]
    for k in range(len(parents) - 1, 0, -1):
        own[parents[k]] += own[k]
    best = max(k for k in range(len(parents)) if 5 * own[k] >= 3 * own[0])
    inside = [False] * len(parents)
    for k in range(best, len(parents)):
        inside[k] = k == best or inside[parents[k]]
    return best, inside


def main_text(page: str | None) -> str:
    """The article of a page, one line per block; empty if there is none.

    Where the page has an article or main element, only lines inside the heaviest one count
    and any weight is a surge. Elsewhere the heaviest run between surge and dive is taken
    and widened to lines of the element that holds most of it and to titles right above.
    Work is linear in the page.
    """
    if not page:
        return ""
    lines = _lines(page)
    rows = lines.rows
    marked: Counter[int] = Counter()
    for r in rows:
        # a main element with one article is that article and what stands around it
        marked[r[4] if r[4] and lines.articles[r[4]] <= 1 else r[3] or r[4]] += r[1]
    marked.pop(0, None)
    if marked:
        best = max(marked, key=lambda k: (marked[k], -k))
        rows = [r for r in rows if best in (r[3], r[4])]
        runs = _runs([r[1] for r in rows], 1)
        if not runs:
            return ""
        # up to titles and paragraphs that are links as a whole, next to others of the text
        homes = {r[2] for r in rows[runs[0][0] : runs[-1][1] + 1] if r[1]}
        places = [i for i, r in enumerate(rows) if r[2] in homes]
        return "\n".join(r[0] for r in rows[places[0] : places[-1] + 1])
    weights = [r[1] for r in rows]
    most = max((sum(weights[i : i + WINDOW]) for i in range(len(weights))), default=0)
    runs = _runs(weights, max(1, min(SURGE, most // SHARE))) if most else []
    if not runs:
        return ""
    first, last = max(runs, key=lambda r: sum(weights[r[0] : r[1] + 1]))
    home, inside = _home(rows, lines.parents, first, last)
    while not inside[rows[first][2]]:
        first += 1
    while not inside[rows[last][2]]:
        last -= 1
    if home not in lines.whole:  # such an element tells nothing about the article's edges
        while first > 0 and inside[rows[first - 1][2]]:
            first -= 1
        while last + 1 < len(rows) and inside[rows[last + 1][2]]:
            last += 1
    while first > 0 and rows[first - 1][5]:
        first -= 1
    return "\n".join(r[0] for r in rows[first : last + 1])


def extract_pages(pages: DataFrame, key: str = "page_id", page: str = "html") -> DataFrame:
    """The main text of every row: ``id, url, text, n_chars``.

    Every row gives one row, repeated and null ids included; other columns are ignored, a
    table without ``url`` gives null ones. A null or empty page has an empty text; so has one
    without any text outside links and boilerplate. Of equally heavy articles the first is
    taken. Whole pages are read, however long, 16 MB at a time; nothing is shuffled. An
    empty table gives an empty one.
    """
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(key).alias("id"), url.alias("url"), F.col(page).cast("string").alias("page"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, "page"):
            texts = [main_text(p.as_py()) for p in filled(batch.column("page"))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                ["id", "url", "text", "n_chars"],
            )

    return rows.mapInArrow(run, f"id {kind}, url string, text string, n_chars long")
