"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block of the page. A line weighs
the characters outside its links, and nothing within menus, headers, footers,
sidebars, notices, adverts, forms and comments; of these, wrappers that hold
the article or most of the page's unlinked text stay. Sums of the weights over a
sliding window of lines make the distribution; a region of main text begins
where it surges over a threshold and ends where it dives to nothing. The
container of a region is kept whole, and so are article and main elements.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .columns import require
from .memory import released

# Element names of HTML by what they mean here.
RAW = frozenset("script style noscript template iframe svg math object textarea select canvas audio video title head".split())
#: Of RAW, those whose content is not markup: they end at their own end tag only.
OPAQUE = frozenset("script style textarea title iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody "
    "td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Paragraph-like elements: their end tags may be missing, so they hold nothing open.
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th option caption summary legend figcaption pre address hr thead tbody tfoot".split())
BOILERPLATE = frozenset("nav aside footer form dialog menu search button fieldset".split())
#: Words of class, id and role attributes that name what is not the article.
HINTS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs masthead topbar footer sidebar aside rail widget widgets ad ads adv "
    "advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice "
    "notices notification alert popup modal overlay newsletter subscribe subscription signup login social share sharing related "
    "recommended recommendations comment comments commentlist respond disqus discussion replies form search searchbox pagination "
    "pager copyright contentinfo complementary dialog toolbar".split()
)
#: Of HINTS, those of text that is never the page's own, however much of it there is.
FOREIGN = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted cookie cookies consent gdpr "
    "related recommended recommendations comment comments commentlist respond disqus discussion replies".split()
)
#: Words that say where or how many; a class of these and HINTS alone is one of HINTS, any other is not.
NEUTRAL = frozenset(
    "site page main global post article top bottom left right primary secondary inner outer wrap wrapper container box block area "
    "section list item items posts articles stories bar button buttons link links text body title slot unit row col column".split()
)
#: Elements that often wrap a whole page.
WRAPPERS = frozenset("form fieldset".split())
#: Elements whose own lines belong together, also through lists, quotes and figures in them.
CONTAINERS = frozenset("article body center dialog div html main section".split())
HEADER_HINTS = frozenset("header".split())
MAIN_HINTS = frozenset("main".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>")
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=\s|/|=|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
_WORD = re.compile(r"[a-z]+")



@cache
def _end_of(name: str) -> re.Pattern[str]:
    """The end tag of an element of RAW, by its whole name."""
    return re.compile(rf"</{name}(?![a-z0-9:-])", re.I)


#: How an element is left out: as a wrapper that gives way to the page's text, by its meaning, or hidden.
WRAPPER, MEANT, HIDDEN = 1, 2, 3


@dataclass
class Line:
    text: str
    weight: int
    article: bool
    main: bool
    out: int = 0  # the left-out wrapper that holds it
    box: int = 0  # the container that holds it
    table: bool = False  # through a table


class _Scanner:
    """Turns a page into lines. Linear in its length."""

    def __init__(self, page: str):
        self.page = page
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.linked: list[str] = []  # the text within links
        self.links = 0  # open <a>
        self.outer = [0]  # the wrapper around each left-out wrapper
        self.boxes = 0
        # name, left out (a wrapper's number, -MEANT or -HIDDEN), article, main, container, within a table of it
        self.open: list[tuple[str, int, bool, bool, int, bool]] = [("", 0, False, False, 0, False)]

    def flush(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            self.parts.clear()
            _, out, article, main, box, table = self.open[-1]
            if text and out >= 0:
                linked = " ".join(html.unescape("".join(self.linked)).split())
                self.lines.append(Line(text, max(0, len(text) - len(linked)), article, main, out, box, table))
        self.linked.clear()

    def text(self, piece: str) -> None:
        if piece and self.open[-1][1] >= 0:
            self.parts.append(piece)
            if self.links:
                self.linked.append(piece)

    def start(self, name: str, attributes: str) -> None:
        if name == "br":
            self.text(" ")
            return
        if name == "a":
            self.links = 1
            self.linked.append(" ")
        if name in VOID or name in LEAF:
            if name in BLOCK:
                self.flush()
                self.links = 0
            if name in LEAF and (out := self.left_out(name, attributes)):
                self.push(name, out, attributes)
            return
        if name in BLOCK or name in BOILERPLATE:
            self.flush()
            self.links = 0
            self.push(name, self.left_out(name, attributes), attributes)
        elif attributes and (out := self.left_out(name, attributes)):
            self.push(name, out, attributes)

    def push(self, name: str, out: int, attributes: str) -> None:
        _, was_out, article, main, box, table = self.open[-1]
        if name != "a" and out:
            self.flush()
        if out == WRAPPER and name != "a" and was_out >= 0:
            self.outer.append(was_out)
            now = len(self.outer) - 1
        elif out:
            now = min(was_out, -MEANT if out == WRAPPER else -out)
        elif name == "main" and was_out != -HIDDEN or name == "article" and was_out > 0:
            now = 0  # the article reopens what wraps it
        else:
            now = was_out
        words = self.words(attributes)
        if name in CONTAINERS:
            self.boxes += 1
            box, table = self.boxes, False
        main = main or name == "main" or bool(words & MAIN_HINTS)
        self.open.append((name, now, article or name == "article", main, box, table or name == "table"))

    @staticmethod
    def words(attributes: str) -> frozenset[str]:
        if "=" not in attributes:
            return frozenset()
        return frozenset(w for m in _NAMES.finditer(attributes) for w in _WORD.findall(m[1].lower()))

    @staticmethod
    def hints(attributes: str) -> set[str]:
        """Words of HINTS and HEADER_HINTS from class, id and role tokens that say nothing else."""
        found: set[str] = set()
        if "=" in attributes:
            for m in _NAMES.finditer(attributes):
                for token in m[1].lower().strip("\"'").split():
                    words = set(_WORD.findall(token))
                    named = words & (HINTS | HEADER_HINTS)
                    if named and words <= named | NEUTRAL:
                        found |= named
        return found

    def left_out(self, name: str, attributes: str) -> int:
        if name in ("body", "html", "main"):
            return 0
        if attributes and name not in BOILERPLATE and name != "article" and _HIDDEN.search(attributes):
            return HIDDEN
        if name in BOILERPLATE and name not in WRAPPERS:
            return MEANT
        inside = self.open[-1][2]
        if name == "header" and not inside:
            return MEANT
        words = self.hints(attributes) if attributes else set()
        if name == "article":
            return MEANT if words & frozenset(("comment", "comments", "ad", "ads", "advert", "related", "sponsored")) else 0
        if inside:
            words -= HEADER_HINTS
        if words & FOREIGN:
            return MEANT
        return WRAPPER if words or name in WRAPPERS else 0

    def end(self, name: str) -> None:
        if name == "a":
            self.links = 0
        if name in BLOCK or name in BOILERPLATE:
            self.flush()
            self.links = 0
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == name:
                self.flush()
                del self.open[i:]
                return
            if name in LEAF or name not in BLOCK and name not in BOILERPLATE:
                if self.open[i][0] in BLOCK:
                    return  # an inline or paragraph end tag closes nothing beyond its block

    def run(self) -> list[Line]:
        page, at, size = self.page, 0, len(self.page)
        last = page.rfind(">")  # what comes after it holds no tag
        unclosed: set[str] = set()  # elements without an end tag from here on
        while at < size:
            lt = page.find("<", at)
            if lt < 0 or lt > last and not page.startswith(("<!", "<?"), lt):
                self.text(page[at:])
                break
            self.text(page[at:lt])
            if page.startswith("<!--", lt):
                close = page.find("-->", lt + 4)
                at = size if close < 0 else close + 3
                continue
            if page.startswith(("<!", "<?"), lt):
                close = page.find(">", lt)
                at = size if close < 0 else close + 1
                continue
            tag = _TAG.match(page, lt) or _LOOSE.match(page, lt)
            if not tag:
                self.text("<")
                at = lt + 1
                continue
            at = tag.end()
            name = tag[2].lower()
            if tag[1]:
                self.end(name)
            elif name in RAW and not tag[3].endswith("/"):
                self.flush()
                close = None if name in unclosed else _end_of(name).search(page, at)
                if close is None:
                    unclosed.add(name)
                    # An open <head> and the like must not swallow the page; opaque content does.
                    at = size if name in OPAQUE else at
                else:
                    past = page.find(">", close.end())
                    at = size if past < 0 else past + 1
            else:
                self.start(name, tag[3])
        self.flush()
        return self.settled()

    def settled(self) -> list[Line]:
        """The lines without left-out wrappers, but for those that hold most of the page's unlinked text."""
        held = [0] * len(self.outer)
        for x in self.lines:
            held[x.out] += x.weight
        total = sum(held)
        opened = [k == 0 for k in range(len(held))]
        for k in range(len(held) - 1, 0, -1):  # inner wrappers first
            if 2 * held[k] > total:
                opened[k] = True
                held[self.outer[k]] += held[k]
        return [x for x in self.lines if opened[x.out]]


def main_lines(lines: list[Line], window: int = 3, surge: int = 60) -> list[Line]:
    """The lines of the article or main element, else those between surges and dives of the windowed weights.

    A container whose own lines reach the surge within a region is kept whole,
    with its linked and short lines.
    """
    weights = [x.weight for x in lines]
    for inside in ([x.article for x in lines], [x.main for x in lines]):
        if any(w for w, i in zip(weights, inside, strict=True) if i):
            return [x for x, i in zip(lines, inside, strict=True) if i]
    n = len(weights)
    sums = [0] * (n + window)
    for i in range(n - 1, -1, -1):
        sums[i] = sums[i + 1] + weights[i] - (weights[i + window] if i + window < n else 0)
    threshold = min(surge, max(sums, default=0))
    kept = [False] * n
    i = 0
    while i < n:
        if weights[i] and sums[i] >= threshold > 0:  # surge
            end = i
            while end < n and sums[end]:  # dive
                end += 1
            # Back to the region's first line: lines of weight right above it belong to it.
            k = i
            while k and weights[k - 1]:
                k -= 1
            kept[k:end] = [True] * (end - k)
            i = end
        else:
            i += 1
    own = Counter[int]()
    for x, taken in zip(lines, kept, strict=True):
        if taken and not x.table:
            own[x.box] += x.weight
    return [x for x, taken in zip(lines, kept, strict=True) if taken or own[x.box] >= threshold > 0]


def extract(page: str | None, window: int = 3, surge: int = 60) -> str:
    return "\n".join(x.text for x in main_lines(_Scanner(page or "").run(), window, surge))


def extract_pages(pages: DataFrame, html_column: str = "html", window: int = 3, surge: int = 60) -> DataFrame:
    """``pages`` with the main text of each instead of its markup.

    Returns the columns of ``pages`` but ``html_column``, and ``text`` (blocks
    in page order, joined by one newline; white space within a block is one
    space; character references decoded) and ``n_chars`` (long, its code
    points); columns of the input by those names are replaced. Null, empty and
    textless pages have an empty text. Every row gives one row, an empty table
    an empty one. A line break tag is white space within its block.
    """
    require(pages, html_column)
    keep = [c for c in pages.columns if c not in (html_column, "text", "n_chars")]
    schema = T.StructType(
        [*[pages.schema[c] for c in keep], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py(), window, surge) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*keep, "text", "n_chars"],
            )

    return pages.select(*[f"`{c}`" for c in keep], html_column).mapInArrow(released(run), schema)
