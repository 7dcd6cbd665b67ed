"""Main-text extraction from HTML.

The standard library's streaming parser emits events; between the edges of
block elements they form lines.  Each line has a number of characters and of
tags, and its text-to-tag ratio is smoothed along the page with a Gaussian
kernel.  Two-means clustering of the smoothed ratios gives the threshold: the
lines above it are content and mark the regions they stand in.  A region is
the article around a line, or else the nearest sectioning element (all of
``main`` for a section of it).  All lines in it and in regions inside it
belong to the result, so short paragraphs, quotes and tables between long ones
stay, and nothing else does; but the body of the page takes in its own lines
alone.  An article without content lines is no part of it.  Two or more lines
in a row that are links alone are a list of links and go, with a heading
before them.

Elements that can't be content are left out before: menus, headers outside an
article, footers, sidebars, forms, scripts and styles by name; notices,
adverts, comment threads and the like by the words in their class, id and
role.

Each page is handled alone; there is no shuffle.  Null, empty and text-free
pages give the empty string.  Repeated rows give repeated results; ties of the
two clusters do not arise, as the threshold lies between their means.  Other
columns are not read, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, quoted, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose edges end a line.
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p
pre section select summary table tbody td tfoot th thead title tr ul""".split())
#: Elements that are never content, and those that form a region.
NEVER = frozenset("""aside audio button canvas datalist dialog footer form head iframe input label map menu nav noscript object
option script select style svg template textarea title video""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
REGION = frozenset("article body div html main section table td blockquote".split())
HOLDERS = frozenset("header ul ol p span figure details".split())
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|breadcrumbs?|comments?|commentlist|consent|cookies?|disqus|footer|gdpr|masthead|menu|modal|nav|navbar|"
    r"navigation|newsletter|notice|notification|pagination|pager|paywall|popup|promo\w*|recommend\w*|related|replies|reply|respond|share|sharing|sidebar|"
    r"site-header|page-header|skip-link|social|sponsor\w*|subscribe|toolbar|widget|complementary|contentinfo|search|alert|overlay|outbrain|taboola)(?:$|[\s_-])"
)
KERNEL = [math.exp(-d * d / 2) for d in range(-2, 3)]
_WHITE = re.compile(r"\s+")


class Lines(HTMLParser):
    """Lines of a page: text, tags, and the region around it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int, bool]] = []  # tag, left out, region, inside an article or main
        self.lines: list[tuple[str, int, int, bool, bool]] = []  # text, tags, region, all links, heading
        self.heading = False
        self.parts: list[str] = []
        self.tags = 0
        self.regions = 0
        self.articles: set[int] = set()
        self.parent: dict[int, int] = {}  # region around each region
        self.kind: dict[int, str] = {0: ""}
        self.open: dict[str, int] = {}  # elements on the stack by name
        self.linked = 0  # characters of the line inside links
        self.links = 0  # open links

    @property
    def top(self) -> tuple[str, bool, int, bool]:
        return self.stack[-1] if self.stack else ("", False, 0, False)

    def _end_line(self) -> None:
        if self.parts:
            text = _WHITE.sub(" ", "".join(self.parts)).strip()
            if text:
                self.lines.append((text, self.tags, self.top[2], 5 * self.linked >= 4 * len(text), self.heading))
                self.tags = 0
            self.parts.clear()
        self.linked = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self._end_line()
            if self.stack and self.stack[-1][0] in ("p", "head"):  # closed by what can't stand inside
                if self.stack[-1][0] == "p" or tag == "body":
                    self.open[self.stack.pop()[0]] -= 1
            self.heading = tag in HEADINGS
        self.tags += 1
        if tag == "a":
            self.links = 1
        if tag == "br" and self.parts:
            self.parts.append(" ")
        if tag in VOID or (tag not in REGION and tag not in NEVER and tag not in HOLDERS):
            return
        _, out, region, inside = self.top
        if not out:
            out = tag in NEVER or (tag == "header" and not inside)
            if not out and tag not in ("html", "body"):
                marks = " ".join(v for k, v in attrs if v and k in ("class", "id", "role")).lower()
                out = bool(marks) and (bool(MARKED.search(marks)) or (not inside and "header" in marks.split()))
            if not out and any(k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and v and "display:none" in v.replace(" ", "")) for k, v in attrs):
                out = tag not in ("html", "body")
        if tag in ("p", "span") and (self.top[1] or not out):  # they matter only where they begin what is left out
            return
        if tag == "article" or tag in REGION and region not in self.articles:
            self.regions += 1
            region = self.regions
            self.parent[region], self.kind[region] = self.top[2], tag
            if tag == "article":
                self.articles.add(region)
        self.open[tag] = self.open.get(tag, 0) + 1
        self.stack.append((tag, out, region, inside or tag in ("article", "main")))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self._end_line()
            self.heading = False
        self.tags += 1
        if tag == "a":
            self.links = 0
        if not self.open.get(tag):  # nothing to close: no look through the stack
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                for name, *_ in self.stack[i:]:
                    self.open[name] -= 1
                del self.stack[i:]
                return
            if tag in ("p", "span") and self.stack[i][0] in REGION:
                return

    def handle_data(self, data: str) -> None:
        if not self.top[1]:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())

    def close(self) -> None:
        super().close()
        self._end_line()


def threshold(values: list[float]) -> float:
    """The middle between two clusters of numbers (two means, from the extremes)."""
    low, high = min(values), max(values)
    for _ in range(50):
        cut = (low + high) / 2
        a, b = [v for v in values if v < cut], [v for v in values if v >= cut]
        if not a or not b:
            break
        new = sum(a) / len(a), sum(b) / len(b)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def smoothed(values: list[float]) -> list[float]:
    """Gaussian smoothing; at the edges the kernel is cut and weighted anew."""
    out, half = [], len(KERNEL) // 2
    for i in range(len(values)):
        a, z = max(0, i - half), min(len(values), i + half + 1)
        w = KERNEL[a - i + half : z - i + half]
        out.append(sum(x * y for x, y in zip(w, values[a:z], strict=True)) / sum(w))
    return out


def blocks(html: str) -> list[str]:
    """The main text's blocks in page order."""
    p = Lines()
    p.feed(html)
    p.close()
    if not p.lines:
        return []
    ratio = smoothed([len(text) / max(1, tags) for text, tags, *_ in p.lines])
    cut = threshold(ratio)
    chosen = {_widened(p, line[2]) for line, r in zip(p.lines, ratio, strict=True) if r >= cut}
    kept: dict[int, bool] = {}

    def inside(region: int) -> bool:
        """Whether the region or one around it is chosen; the page's own body takes in nothing but its lines."""
        path = []
        while region not in kept and region:
            path.append(region)
            if region in chosen:
                kept[region] = True
                break
            up = p.parent[region]
            region = up if p.kind[up] not in ("", "html", "body") else 0
        found = kept.get(region, region in chosen) if region or not path else False
        for r in path:
            kept[r] = found
        return found

    lines = [line for line in p.lines if inside(line[2])]
    return _without_lists(lines)


def _widened(p: Lines, region: int) -> int:
    """A section of ``main`` stands for all of it; any other region for itself."""
    up = p.parent.get(region, 0)
    return up if p.kind.get(region) == "section" and p.kind.get(up) == "main" else region


def _without_lists(lines: list[tuple[str, int, int, bool, bool]]) -> list[str]:
    """Texts without runs of two or more lines that are links alone, and without the heading right before such a run."""
    out: list[str] = []
    i = 0
    while i < len(lines):
        j = i
        while j < len(lines) and lines[j][3] and not lines[j][4]:
            j += 1
        if j - i >= 2:
            if out and i and lines[i - 1][4]:
                out.pop()
            i = j
            continue
        out.append(lines[i][0])
        i += 1
    return out


def extract(html: str | None) -> str:
    return "\n\n".join(blocks(html)) if html else ""


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Key, url, text, n_chars (code points)."""
    source = pages.select(F.col(quoted(key)), F.col(quoted(url)), F.col(quoted(html)).cast("string").alias("h"))
    schema = T.StructType([*source.schema.fields[:2], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for b in batches:
            texts = [extract(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema.names)

    return bounded(source).mapInArrow(run, schema)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


QUERIES = {"op7_html_extraction": op7_html_extraction}
ORACLES: dict[str, str] = {}
