"""Main text of web pages: structure first, then nearest-URL page differencing.

A page is cut into blocks of text. Blocks inside scripts, styles, forms, navigation, footers, asides and elements whose class
or id says advert, cookie notice, comments and the like are left out. If the page marks its article (article, main), its
candidates are the article's blocks, else all others. Every page is differenced with its nearest pages, marked ones with marked ones: the different pages of a host are numbered
by URL path (a range sort, so that a host of any size spreads over tasks; numbers go on from one range to the next), each is joined with the page before and the
page after it, their blocks are aligned by longest common subsequence, and candidates in a common subsequence go.

Within a marked article a common block may be a passage that neighbouring articles share, which belongs to both. There a block in a common subsequence
goes only if it is the host's template: on more than half of its different marked pages, of which there are `EVIDENCE` or more. Where that would take more than half of an article's
characters, the page is one of many near copies and keeps them all. Blocks are compared by 64-bit hashes.

Pages of a host with equal blocks are one page there, at the smallest of their paths, and have the same text. NULL html gives an empty text; a NULL or odd URL
is a host of its own; repeated rows are extracted one by one; pages of any length are read whole; an empty table gives no rows. Other columns, whatever their names, are ignored.
How the table is split changes nothing.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import let, written

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "audio", "video"}
SKIP = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "fieldset", "header"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar"}
WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal", "overlay",
    "newsletter", "subscribe", "subscription", "signup", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "comment", "comments", "disqus", "share", "sharing", "social",
    "related", "recommended", "recommendations", "widget", "pagination", "pager", "masthead", "header", "login", "skip",
}


def _boilerplate(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in SKIP:
        return not (tag == "header" and in_article)
    for name, *values in _ATTR.findall(attrs) if attrs else ():
        value = "".join(values).lower()
        name = name.lower()
        if name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            found = WORDS.intersection(re.split(r"[\s_-]+", value))
            if found and not (in_article and found == {"header"}):
                return True
        if name in ("class", "id") and tag == "article" and WORDS.intersection(re.split(r"[\s_-]+", value)) & {"comment", "comments", "related", "ad", "promo"}:
            return True
    return False


def blocks_of(page: str | None) -> tuple[list[str], bool]:
    """The blocks that may be main text, in order, and whether the page marks its article (then only its blocks are given)."""
    page = page or ""
    inside: list[str] = []
    outside: list[str] = []
    text: list[str] = []
    article = 0
    marked = False
    skip, depth, at = "", 0, 0

    def close() -> None:
        if text:
            block = " ".join(html.unescape("".join(text)).split())
            if block:
                (inside if article else outside).append(block)
            text.clear()

    last: dict[str, int] = {}

    def closed_after(tag: str, at: int) -> bool:
        """Whether the tag is closed further on; its last closing is looked up once a page."""
        if tag not in last:
            last[tag] = lower.rfind(f"</{tag}")
        return last[tag] >= at

    lower = page.lower() if len(page.lower()) == len(page) else page
    end = len(page)
    while at < end:
        m = _TAG.search(page, at)
        if not skip:
            piece = page[at : m.start() if m else end]
            if piece:
                text.append(piece)
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA[") and not skip:
                text.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        closing = bool(m[1])
        if skip:
            if tag == skip:
                depth += -1 if closing else (0 if m[3].endswith("/") else 1)
                if depth == 0:
                    skip = ""
            elif closing and tag in ("article", "main", "body") and not closed_after(skip, at):
                skip = ""  # the left-out element was never closed
                if tag != "body":
                    close()
                    article = max(0, article - 1)
                continue
            if skip and tag in RAW and not closing:
                at = _after_raw(page, at, tag)
            continue
        if closing:
            if tag in BLOCK:
                close()
            elif tag in ("td", "th"):
                text.append(" ")
            if tag in ("article", "main"):
                article = max(0, article - 1)
            continue
        if tag in RAW:
            if tag in ("audio", "video", "object", "canvas") or not m[3].endswith("/"):
                at = _after_raw(page, at, tag)
            continue
        if tag not in VOID and not m[3].endswith("/") and _boilerplate(tag, m[3], article > 0):
            close()
            skip, depth = tag, 1
            continue
        if tag in BLOCK:
            close()
        elif tag in ("br", "td", "th"):
            text.append(" ")
        if tag in ("article", "main"):
            article += 1
            marked = True
    close()
    return (inside, True) if marked and inside else (outside, False)


def _after_raw(page: str, at: int, tag: str) -> int:
    m = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
    return m.end() if m else len(page)


#: Different marked pages that a host must have before a block is called its template.
EVIDENCE = 10
#: Bits of the table of a longest common subsequence that are held at once.
TABLE = 1 << 28


def _row(a: list[str], b: list[str]) -> list[int]:
    """Lengths of the longest common subsequences of a with each beginning of b."""
    v = _rows(a, b, keep=False)[-1]
    out, n = [0], 0
    for j in range(len(b)):
        n += 1 - (v >> j & 1)
        out.append(n)
    return out


def _rows(a: list[str], b: list[str], keep: bool = True) -> list[int]:
    """The table's rows as bit sets: a step costs one addition."""
    where: dict[str, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows = [full]
    for x in a:
        v, m = rows[-1], where.get(x, 0)
        u = v & m
        v = ((v + u) | (v - u)) & full
        rows.append(v) if keep else rows.__setitem__(0, v)
    return rows


def common(a: list[str], b: list[str]) -> set[int]:
    """The places in a of a longest common subsequence with b."""
    both = set(a) & set(b)
    at, a, b = [i for i, x in enumerate(a) if x in both], [x for x in a if x in both], [x for x in b if x in both]
    return {at[i] for i in _common(a, b)}


def _common(a: list[str], b: list[str]) -> set[int]:
    if not a or not b:
        return set()
    if len(a) > 1 and len(a) * len(b) > TABLE:
        # the halves of a, each with its part of b: memory for one row at a time
        half = len(a) // 2
        left, right = _row(a[:half], b), _row(a[half:][::-1], b[::-1])
        cut = max(range(len(b) + 1), key=lambda j: left[j] + right[len(b) - j])
        return _common(a[:half], b[:cut]) | {half + i for i in _common(a[half:], b[cut:])}
    rows = _rows(a, b)

    def length(i: int, j: int) -> int:
        """Of the longest common subsequence of a[:i] and b[:j]: the zero bits below j in row i."""
        return j - (rows[i] & ((1 << j) - 1)).bit_count()

    out, i, j = set(), len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.add(i)
        elif length(i - 1, j) >= length(i, j - 1):
            i -= 1
        else:
            j -= 1
    return out


def _key(block: str) -> int:
    return int.from_bytes(hashlib.blake2b(block.encode(), digest_size=8).digest(), "big", signed=True)


def _parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The candidate blocks of every page and whether it marks its article."""
    names = ["host", "path", "page_id", "url", "marked", "blocks", "keys", "digest"]
    for b in batches:
        pages = [blocks_of(page.as_py()) for page in b.column(4)]
        digests = [hashlib.blake2b("\n\n".join(blocks).encode(), digest_size=16).digest() for blocks, _ in pages]
        own = [pa.array([m for _, m in pages], pa.bool_()), pa.array([x for x, _ in pages], pa.list_(pa.string())), pa.array([[_key(x) for x in blocks] for blocks, _ in pages], pa.list_(pa.int64())), pa.array(digests, pa.binary())]
        yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), *own], names)


def _difference(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places of each page's blocks that are in a common subsequence with a neighbour."""
    for b in batches:
        gone = [sorted(set().union(*(common(own, x) for x in near if x is not None))) for own, *near in zip(*(b.column(k).to_pylist() for k in (3, 4, 5)), strict=True)]
        yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(gone, pa.list_(pa.int32()))], ["host", "marked", "digest", "keys", "gone"])


def different(parsed: DataFrame) -> DataFrame:
    """host, marked, digest, path, keys: a host's different pages."""
    return parsed.where(F.size("keys") > 0).groupBy("host", "marked", "digest").agg(F.min("path").alias("path"), F.first("keys").alias("keys"))


def numbered(pages: DataFrame) -> DataFrame:
    """host, marked, digest, keys, n: the different pages, marked ones apart, numbered in the order of host and path without gaps."""
    # sorted once and stored: the numbers within a range are its rows' places
    order = ["host", "marked", "path", "digest"]
    placed = pages.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(placed.select("host", "marked", "digest", "keys", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place")), "pages")
    # one row a range: a window over as many rows as there are tasks
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("part").agg(F.count("*").alias("rows")).select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    return placed.join(F.broadcast(offsets), "part").select("host", "marked", "digest", "keys", (F.col("offset") + F.col("place")).alias("n"))


def templates(pages: DataFrame) -> DataFrame:
    """host, template: the blocks on more than half of a host's different marked pages, fewer than twice those of a page on average."""
    marked = pages.where("marked")
    hosts = marked.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= EVIDENCE)
    on = marked.select("host", F.explode(F.array_distinct("keys")).alias("key")).groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") > EVIDENCE // 2)
    return on.join(hosts, "host").where(F.col("n") * 2 > F.col("pages")).groupBy("host").agg(F.collect_list("key").alias("template"))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url and text for every page."""
    address = F.coalesce(F.col(url), F.lit(""))
    host = F.lower(F.regexp_extract(address, "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)", 1))
    path = F.regexp_extract(address, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    rows = pages.select(host.alias("host"), path.alias("path"), F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))
    kind = pages.schema[key].dataType.simpleString()
    parsed = written(rows.mapInArrow(_parse, f"host string, path string, page_id {kind}, url string, marked boolean, blocks array<string>, keys array<long>, digest binary"), "parsed")
    near = numbered(different(parsed))
    side = lambda d, name: near.select((F.col("n") + d).alias("n"), F.col("host").alias(f"{name}_host"), F.col("marked").alias(f"{name}_marked"), F.col("keys").alias(name))
    both = near.join(side(1, "before"), "n", "left").join(side(-1, "after"), "n", "left")
    same = lambda name: F.when((F.col(f"{name}_host") == F.col("host")) & (F.col(f"{name}_marked") == F.col("marked")), F.col(name)).alias(name)
    gone = both.select("host", "marked", "digest", "keys", same("before"), same("after")).mapInArrow(_difference, "host string, marked boolean, digest binary, keys array<long>, gone array<int>")
    # stored, so that their sizes decide how they are joined: pages that lose nothing are not shuffled for the few that do
    shared = gone.where(F.size("gone") > 0).join(written(templates(near), "templates"), "host", "left")
    own = F.filter("gone", lambda i: ~F.col("marked") | F.coalesce(F.array_contains("template", F.get("keys", i)), F.lit(False)))
    lost = written(shared.select("host", "marked", "digest", own.alias("gone")).where(F.size("gone") > 0), "lost")
    stay = F.filter("blocks", lambda x, i: ~F.array_contains("gone", i))
    text = F.when(F.col("gone").isNull(), F.array_join("blocks", "\n\n")).otherwise(let(F.array_join(stay, "\n\n"), lambda x: F.when(F.col("marked") & (F.length(x) * 2 < F.length(F.array_join("blocks", "\n\n"))), F.array_join("blocks", "\n\n")).otherwise(x)))
    out = parsed.select("host", "marked", "digest", "page_id", "url", "blocks").join(lost, ["host", "marked", "digest"], "left").select("page_id", "url", text.alias("text"))
    return out.withColumnRenamed("page_id", key).withColumnRenamed("url", url)
