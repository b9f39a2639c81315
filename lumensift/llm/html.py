"""Main text of web pages by differencing with the page of the nearest URL.

A page becomes lines, one a block of its markup. Within each host, pages are
sorted by URL path; the neighbour with the longer common path is a page's pair.
The two pages' lines are aligned by a longest common subsequence and the shared
lines, which come from the site and not from the article, are deleted. Where a page without marks has
no line that its pair lacks, the pair is a copy (or a longer version), not a template, and the other neighbour is
taken instead.

Markup goes into the alignment:

* What HTML itself sets apart (``nav``, page headers, ``footer``, ``aside``, forms, scripts,
  styles, hidden elements, roles such as ``navigation``) and what a class or id calls a menu, footer, sidebar,
  advert, cookie notice or reader comment is no line. Of an article's own header, headings, paragraphs, lists and other blocks are
  lines; bylines, dates and text beside blocks aren't. An article within an article is a comment.
* Inside ``article`` or ``main`` only names of adverts, sharing and reader comments do so, and any other name is no more than a suggestion:
  a ``div`` of class ``social`` may be a paragraph on social questions. ``menu`` and ``dialog`` are the article's there.
* Elements whose class or id only suggests a part of the site (``related``, ``notice``,
  ``banner`` ...) are aligned by their name instead of their text: where the pair has such an
  element in the same place, it is the site's and goes; where it hasn't, it is the article's and stays. So are, on pages without marks, list items that
  are nothing but a link: menus differ in their words and agree in their form.
* Lines are units of the innermost ``div``, ``section`` or table cell around them. Articles of one host do
  share lines (quotations, passages, near copies), so a unit with more text of its own than shared text
  keeps its shared lines, but for those with which the page and its neighbours on both sides begin (before a heading) or end; from all other units shared lines are deleted.
* Where a page marks its article (``article``, ``main``), the lines inside stay however many a neighbour shares,
  and only suggestively named elements (teasers of other stories too) are decided by alignment. A page whose article has none of these is decided without a pair.

Scale: only hashes of lines are sorted, by range over (host, path, id), so a
host of any size spreads over many tasks; what meets at the borders of ranges is
two rows a range. Alignments take memory in proportion to the lines of two pages, not to their product.

Defined results: null html is an empty text; null urls have an empty host and
path; equal urls are ordered by id; repeated rows pair with each other as copies,
which deletes nothing; pages without a neighbour lose the suggestively named elements (but for those that only a name inside the article tells) and no other line; cut-off markup ends
with the page; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.durable import written

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)>|<[!?][^>]*>|<[/!?a-zA-Z][^<>]*\Z""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden|itemprop)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

#: Elements whose content is no markup and no text.
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "canvas"}

#: Elements that are never part of an article.
_APART = {"nav", "footer", "aside", "form", "head", "button", "select"}

#: Elements that are so outside of articles only.
_APART_OUTSIDE = {"dialog", "menu"}

_BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul video audio".split()
)

#: Elements whose lines are a unit.
_UNITS = {"div", "section", "article", "main", "td", "th"}

_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

#: Elements without content.
_EMPTY = {"br", "img", "input", "hr", "meta", "link", "wbr", "source", "col", "area", "base", "embed", "track", "param"}

# Words that set an element apart when they are a whole class name or id, or stand before "-list", "-box" and the like.
_STRONG = re.compile(
    r"(?:ads?|advert|adverts|advertisement|advertising|sponsored|cookies?|cookie-consent|cookie-notice|consent|gdpr|newsletter|paywall|popup|modal|sidebar|comments?|commentlist|disqus|replies|nav|navbar|navigation|menu|breadcrumbs?|footer|masthead|topbar|pagination|pager|sharing|social|site-header|page-header|site-footer|page-footer|site-nav|sr-only)"
    r"(?:-(?:list|box|bar|area|section|container|wrapper|block|unit|slot|form|banner|links))?",
    re.I,
)

# Of these, the ones that set an element apart inside an article too, and those of a byline in its header.
_READERS = re.compile(r"(?:ads?|advert|adverts|advertisement|advertising|sponsored|comments?|commentlist|disqus|sharing)(?:-(?:list|box|bar|area|section|container|wrapper|block|unit|slot|form|banner|links))?", re.I)
_BYLINE = re.compile(r"(?:by-?line|authors?|date|dateline|published|posted(?:-on)?|timestamp|(?:post|entry|article)-(?:meta|date|author)|meta)", re.I)

# Words that suggest a part of the site, as any part of a class name or id; differencing decides.
_WEAK = re.compile(r"(?:^|[_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|notice|alert|overlay|subscribe|signup|side|widget\w*|related|recommend\w*|share|teaser|toolbar|skip|print-only)(?:$|[_-])", re.I)

_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar", "toolbar"}

APART, SITE, MAYBE = "apart", "site", "maybe"


def _named(tag: str, attributes: str, inside: bool, header: bool) -> tuple[str, str]:
    """APART, SITE or MAYBE (differencing decides; without a neighbour, SITE goes and MAYBE stays) or blank, and the name that says so; inside: an article or main."""
    if tag in _APART or not inside and tag in _APART_OUTSIDE or header and tag in ("time", "address"):
        return APART, tag
    found = ("", "")
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return found
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        value, name = a or b or c, name.lower()
        if name in ("class", "id"):
            for token in value.split():
                if _STRONG.fullmatch(token):
                    if not inside or _READERS.fullmatch(token):
                        return APART, token
                    found = found if found[0] == SITE else (MAYBE, f"{tag}.{token.lower()}")
                elif header and _BYLINE.fullmatch(token):
                    return APART, token
                elif _WEAK.search(token):
                    found = SITE, f"{tag}.{token.lower()}"
        if name == "role" and value.lower() in _ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return APART, name
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return APART, name
    return found


@dataclass
class Line:
    text: str
    unit: int  # the element around it
    site: str  # the name of a suggestively named element around it
    sure: bool  # that name suggests it without a neighbour too
    article: bool
    main: bool
    heading: bool


def _all_lines(page: str) -> list[Line]:
    """The lines of a page that markup doesn't set apart."""
    lines: list[Line] = []
    text: list[str] = []
    links, plain = 0, False  # open links, and whether the line has text outside of them
    units: list[tuple[str, int]] = []  # open elements of _UNITS and their numbers
    sites: list[list] = []  # open suggestively named elements: tag, name, how often the tag is open inside
    count, article, mains = 0, False, 0
    apart, depth = "", 0  # the element that sets its content apart, and how often it is open
    headers, block = 0, ""  # open headers of an article, and the block that its text is in

    def end() -> None:
        nonlocal plain
        line = " ".join(references.unescape("".join(text)).split())
        text.clear()
        if line and (not headers or block not in ("", "header")):
            site = sites[-1][1] if sites else "li.a" if block == "li" and not plain and not article and not mains else ""
            lines.append(Line(line, units[-1][1] if units else 0, site, bool(sites) and sites[-1][3], article, mains > 0, block in _HEADINGS))
        plain = False

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        begin = m.start() if m else size
        if begin > at and not apart:
            text.append(page[at:begin])
            plain = plain or not links and not page[at:begin].isspace()
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag, closing, alone = m[2].lower(), bool(m[1]), m[3].endswith("/") or m[2].lower() in _EMPTY
        if tag in _RAW:
            if not closing and not alone:
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
                at = close.end() if close else size
            continue
        if apart:
            if tag == apart:
                depth += -1 if closing else not alone
                if not depth:
                    apart = ""
                continue
            if tag not in ("article", "main") or closing or article or mains:
                continue
            apart, depth = "", 0  # it was never closed
        kind, name = ("", "") if closing or alone or tag in ("html", "body") else _named(tag, m[3], article or mains > 0, headers > 0)
        if kind == APART or not closing and (tag == "header" and not article and not mains or tag == "article" and article):
            end()
            apart, depth = tag, 1
            continue
        if tag == "a":
            links = max(0, links + (-1 if closing else 1))
        if tag == "br":
            text.append(" ")
        elif tag in _BLOCKS:
            end()
            block = "" if closing else tag
        if tag == "header":
            headers = max(0, headers + (-1 if closing else 1))
        if closing:
            if sites and sites[-1][0] == tag:
                sites[-1][2] -= 1
                if not sites[-1][2]:
                    sites.pop()
            if tag in _UNITS and any(t == tag for t, _ in units):
                while units.pop()[0] != tag:
                    pass
            if tag == "article":
                article, headers = False, 0
            elif tag == "main":
                mains = max(0, mains - 1)
        elif not alone:
            if sites and sites[-1][0] == tag:
                sites[-1][2] += 1
            elif kind and not sites:
                sites.append([tag, name, 1, kind == SITE])
            if tag in _UNITS:
                count += 1
                units.append((tag, count))
            if tag == "article":
                article = True
            elif tag == "main":
                mains += 1
    end()
    return lines


def page_lines(page: str) -> tuple[list[Line], bool]:
    """The lines that can be the article's, and whether markup marks the article."""
    lines = _all_lines(page)
    inside = [x for x in lines if x.article or x.main]
    return (inside, True) if inside else (lines, False)


def shared_lines(a: list[int], b: list[int]) -> list[bool]:
    """Which of a's lines are in a longest common subsequence with b.

    Equal ends are cut off first. What is left is split in halves of a, at the place in b where bit-parallel rows from
    both sides add up to most, until rows of all lines are small enough to go back along them.
    """
    out = [False] * len(a)

    def solve(i: int, n: int, j: int, m: int) -> None:
        while i < n and j < m and a[i] == b[j]:
            out[i] = True
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            out[n - 1] = True
            n, m = n - 1, m - 1
        if i == n or j == m:
            return
        if (n - i) * (m - j) <= DIRECT or n - i == 1:
            for x, s in enumerate(_direct(a[i:n], b[j:m])):
                out[i + x] = out[i + x] or s
            return
        half = (i + n) // 2
        total = _row(a[i:half], b[j:m]) + _row(a[half:n][::-1], b[j:m][::-1])[::-1]
        cut = j + int(total.argmax())
        solve(i, half, j, cut)
        solve(half, n, cut, m)

    solve(0, len(a), 0, len(b))
    return out


#: Lines times lines whose rows are held at once.
DIRECT = 1 << 22


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """After each line of a, a number whose bit j is 0 where the common length grows at line j of b."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        if x in places:
            places[x].append(j)
        else:
            places[x] = [j]
    wanted = set(a)
    masks = {x: sum(1 << j for j in js) if len(js) < 64 else int.from_bytes(_bits(js, len(b)), "little") for x, js in places.items() if x in wanted}
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _bits(at: list[int], size: int) -> bytes:
    flags = np.zeros(size, bool)
    flags[at] = True
    return np.packbits(flags, bitorder="little").tobytes()


def _row(a: list[int], b: list[int]) -> np.ndarray:
    """The common lengths of a with each beginning of b."""
    v = (1 << len(b)) - 1
    for v in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(-(-len(b) // 8), "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def _direct(a: list[int], b: list[int]) -> list[bool]:
    rows = list(_rows(a, b))

    def length(i: int, j: int) -> int:
        return 0 if i < 0 or j < 0 else (~rows[i] & ((1 << (j + 1)) - 1)).bit_count()

    out = [False] * len(a)
    i, j = len(a) - 1, len(b) - 1
    while i >= 0 and j >= 0:
        if a[i] == b[j]:
            out[i] = True
            i, j = i - 1, j - 1
        elif length(i - 1, j) >= length(i, j - 1):
            i -= 1
        else:
            j -= 1
    return out


def parsed(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """row, key, url, host, path, decided, lines, and of each line hash, unit and sort (0, and -1 for headings: its unit decides, 1: stays, 2 and 3: a suggestively named element, which goes or stays without a neighbour) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                decided, lines, hashes, units, sorts = [], [], [], [], []
                for page in part.column(5).to_pylist():
                    own, marked = page_lines(page or "")
                    decided.append(marked and not any(x.site for x in own))
                    lines.append([x.text for x in own])
                    hashes.append([xxhash.xxh3_64_intdigest(f"<{x.site}>" if x.site else x.text) - (1 << 63) for x in own])
                    units.append([x.unit for x in own])
                    sorts.append([(2 if x.sure else 3) if x.site else 1 if marked else -x.heading for x in own])
                made = [pa.array(decided), pa.array(lines, pa.list_(pa.string())), pa.array(hashes, pa.list_(pa.int64())), pa.array(units, pa.list_(pa.int32())), pa.array(sorts, pa.list_(pa.int8()))]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(5)), *made], ["row", "key", "url", "host", "path", "decided", "lines", "hashes", "units", "sorts"])

    address = F.coalesce(F.col(url), F.lit(""))
    host = F.lower(F.regexp_extract(address, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(address, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    kind = pages.schema[key].dataType.simpleString()
    plain = pages.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(url).alias("url"), host.alias("host"), path.alias("path"), F.col(html).alias("html"))
    return plain.mapInArrow(run, f"row long, key {kind}, url string, host string, path string, decided boolean, lines array<string>, hashes array<long>, units array<int>, sorts array<tinyint>")


def neighbours(table: DataFrame) -> DataFrame:
    """row, host, path, hashes, units, sorts and sizes (of lines) of the pages that aren't decided, and before and after: host, path and hashes of the pages next to them in order of (host, path, key)."""
    order = ["host", "path", "key", "row"]
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    open_ = lambda c: F.when(~F.col("decided"), F.col(c)).alias(c)
    keys = table.select(*order, "decided", "hashes", open_("units"), open_("sorts"), F.when(~F.col("decided"), F.transform("lines", F.length)).alias("sizes"))
    dealt = written(keys.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()))
    page = F.struct("host", "path", "hashes")
    near = Window.partitionBy("range").orderBy(*order)
    inner = dealt.select("range", *order, "decided", "hashes", "units", "sorts", "sizes", F.lag(page).over(near).alias("before"), F.lead(page).over(near).alias("after"))
    # the first and last page of each range, in order of ranges
    ends = dealt.groupBy("range").agg(F.min_by(page, F.struct(*order)).alias("first"), F.max_by(page, F.struct(*order)).alias("last"))
    ranges = Window.orderBy("range")
    borders = ends.select("range", F.lag("last").over(ranges).alias("last_before"), F.lead("first").over(ranges).alias("first_after"))
    met = inner.where(~F.col("decided")).join(borders, "range")
    return met.select("row", "host", "path", "hashes", "units", "sorts", "sizes", F.coalesce("before", "last_before").alias("before"), F.coalesce("after", "first_after").alias("after"))


def _prefix(a: str | list[int], b: str | list[int]) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def kept_mask(page: dict) -> list[bool]:
    """Which lines of a page (as neighbours returns it) stay after differencing with the nearest page of the host that is no copy."""
    own, sorts, units, sizes = page["hashes"], page["sorts"], page["units"], page["sizes"]
    near = [p for p in (page["before"], page["after"]) if p is not None and p["host"] == page["host"]]
    if not near:
        return [s != 2 for s in sorts]
    found = []  # shared lines, common lines at the beginning and at the end, nearest first
    for other in sorted(near, key=lambda p: -_prefix(p["path"], page["path"])):
        theirs = list(other["hashes"])
        if not all(shared := shared_lines(own, theirs)) or min(sorts, default=1) > 0:
            found.append((shared, _prefix(own, theirs), _prefix(own[::-1], theirs[::-1])))
    shared, begun, ended = (found[0][0], *(min(f[k] for f in found) for k in (1, 2))) if found else ([False] * len(own), 0, 0)
    text: dict[int, int] = {}  # characters of each unit, less shared ones twice
    for s, u, sort, n in zip(shared, units, sorts, sizes):
        if sort <= 0:
            text[u] = text.get(u, 0) + (-n if s else n)
    begun = min(begun, sorts.index(-1) if -1 in sorts else begun)
    inner = lambda i, u: u > 0 and text[u] > 0 and begun <= i < len(own) - ended
    named = {(u, h) for s, u, sort, h in zip(shared, units, sorts, own) if s and sort >= 2}  # a menu goes whole, however many lines the neighbour's has
    return [(u, own[i]) not in named if sort >= 2 else sort == 1 or not s or inner(i, u) for i, (s, u, sort) in enumerate(zip(shared, units, sorts))]


def main_texts(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text and n_chars of every page."""
    table = written(parsed(pages, key, url, html))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            masks = [kept_mask(r) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(masks, pa.list_(pa.bool_()))], ["row", "keep"])

    keep = neighbours(table).mapInArrow(run, "row long, keep array<boolean>")
    open_ = table.where(~F.col("decided")).join(keep, "row").select("key", "url", F.transform(F.filter(F.arrays_zip("lines", "keep"), lambda x: x["keep"]), lambda x: x["lines"]).alias("lines"))
    every = table.where("decided").select("key", "url", "lines").unionByName(open_)
    text = F.array_join("lines", "\n")
    return every.select(F.col("key").alias(key), F.col("url").alias(url), text.alias("text"), F.length(text).cast("long").alias("n_chars"))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
