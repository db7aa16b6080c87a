"""Main text of HTML pages by nearest-URL page differencing.

Pages are sorted by URL path within each host, and each is paired with the neighbour whose path
shares the longest start with its own. What both pages have is the site's and goes; the rest is the page's:

1. The two pages' text lines (one a block) are aligned by a longest common subsequence, and shared lines go.
   Lines inside the article that the markup names (`article`, or else `main` and the like) are protected: copies of
   an article under two URLs would delete each other.
2. Menus, adverts and footers often differ from page to page, so their places are compared too: a line that is not
   protected goes if it stands in a slot of the site (HTML's elements for navigation, footers, forms and so on, an
   element with a name like `ad` or `cookie-notice`, or outside the named article) that its pair has as well. A slot with
   such a name goes inside an article too, but only if the pair has it.
3. Where there is no such evidence (no pair, or one without the slot), markup breaks the tie: HTML's own elements
   and lines outside the named article go, and slots with such a name only if there is no pair at all.

A page without a named article that shares all its lines with its pair is a copy, and keeps them.

Partitioning: by host, and hosts above a share of all pages are split into ranges of (path, page_id). The
first and the last page of a range are copied to its neighbours, so every page meets the pages next to it
in its host, wherever the ranges are cut. One exchange carries the pages; a task holds three at a time.
Reading a page takes time in proportion to its length, whatever is left open in it.

Edge cases: a null or empty page has an empty text; a page alone in its host has no pair; pages of
one path are neighbours by page_id. Null ids and URLs are kept. A quote that is never closed ends with its
tag. An empty table gives no rows. Extra columns are not carried.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain
from os.path import commonprefix
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import urls

LARGE_SHARE, LARGE_ROWS, SAMPLES = 20_000, 500, 8
MAX_BITS = 1 << 29

# HTML's elements that break lines, that hold no text, and that end a paragraph's parent.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes template".split())
JUNK = frozenset("nav header footer aside form menu button select object canvas svg audio video dialog head search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
JUNK_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
MAIN_IDS = frozenset("article-body articlebody article-content post-content post-body entry-content story-body main-content".split())
# Words that name a site's slots, alone or several of them together, and the parts that may join them.
_NAMES = "ad ads advert adverts advertisement advertisements adsense sponsor sponsored sponsors promo promos promotion promotions banner banners nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars footer masthead topbar cookie cookies consent gdpr notice notices popup popups modal overlay newsletter subscribe subscription share sharing social related recommended recommendations comment comments commentlist respond disqus reply replies widget widgets toolbar pagination pager login signup copyright disclaimer paywall".split()
_PARTS = "site page global main top bottom left right header footer box bar area block list links link button buttons container wrapper section panel slot unit post posts article articles content item items icons form side inner outer primary secondary".split()
_NAMED = re.compile(rf"(?=(?:[a-z]+[-_])*?(?:{'|'.join(_NAMES)})(?:[-_]|\Z))(?:{'|'.join(sorted(_NAMES + _PARTS, key=len, reverse=True))})(?:[-_](?:{'|'.join(sorted(_NAMES + _PARTS, key=len, reverse=True))}|[0-9]+))*", re.I)
_PAGE_PART = re.compile(r"(?:(?:site|page|global|main|top)[-_]?)(?:header|footer)|header|side[-_]bar", re.I)
_OPEN = re.compile(r"<(?:(!--)|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_REST = re.compile(r"[^>\"']*+")
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_CLOSES = {k: re.compile(rf"</{k}\s*>", re.I) for k in RAW}


class Line(NamedTuple):
    """A block of text: where it stands (`article`, `main`, `site` in an element of the site's, `named` in a slot with a name, or nothing) and the slot."""

    text: str
    kind: str
    slot: str


class _Open(NamedTuple):
    """An open element: what holds inside it, its slot, the kind around the site's part it is in, and whether that is only a header."""

    tag: str
    kind: str
    slot: str
    around: str
    header: bool


def _kind(tag: str, raw: str) -> tuple[str, str]:
    """What an element says of the text in it, and its slot."""
    if tag in JUNK:
        return "site", tag
    if tag in ("html", "body") or not raw.strip(" /"):
        return ("article" if tag == "article" else "main" if tag == "main" else ""), tag
    found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return "site", f"{tag} hidden"
    role = found.get("role", "").lower()
    if role in JUNK_ROLES:
        return "site", f"{tag} {role}"
    names = f"{found.get('class', '')} {found.get('id', '')}".split()
    slot = " ".join((tag, *names))
    if tag not in ("main", "article") and any(_NAMED.fullmatch(x) or _PAGE_PART.fullmatch(x) for x in names):
        return "named", slot
    if tag == "article" or "articlebody" in found.get("itemprop", "").lower() or any(x.lower() in MAIN_IDS for x in names):
        return "article", slot
    return "main" if tag == "main" or role in ("main", "article") else "", slot


def _tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """Where the tag ends whose attributes begin at `at`; `last` has each quote's last place, so no search for a missing one is made twice."""
    while at < len(page):
        at = _REST.match(page, at).end()
        if at >= len(page) or page[at] == ">":
            break
        end = page.find(page[at], at + 1) if at < last[page[at]] else page.find(">", at) - 1
        if end < at:
            return len(page)
        at = end + 1
    return at


def lines(page: str | None) -> list[Line]:
    """The blocks of text in page order."""
    page = page or ""
    out: list[Line] = []
    stack = [_Open("", "", "", "", False)]
    opened: dict[str, int] = defaultdict(int)
    words: list[str] = []
    last = {q: page.rfind(q) for q in "\"'"}
    at = 0

    def flush() -> None:
        if words:
            text = " ".join("".join(words).split())
            words.clear()
            if text:
                out.append(Line(text, stack[-1].kind, stack[-1].slot))

    def pop() -> str:
        tag = stack.pop().tag
        opened[tag] -= 1
        return tag

    while at < len(page):
        token = _OPEN.search(page, at)
        text = page[at : token.start()] if token else page[at:]
        if text:
            words.append(html.unescape(text) if "&" in text else text)
        if not token:
            break
        if token[3] is None:
            end = page.find("-->" if token[1] else ">", token.end())
            at = len(page) if end < 0 else end + (3 if token[1] else 1)
            continue
        end = _tag_end(page, token.end(), last)
        tag, raw, at = token[3].lower(), page[token.end() : end], end + 1
        if tag == "br":
            words.append(" ")
        if token[2]:
            if opened[tag]:
                if tag in BLOCKS or stack[-1].kind != stack[-2].kind:
                    flush()
                while pop() != tag:
                    pass
            elif tag in BLOCKS:
                flush()
            continue
        if tag in RAW:
            close = _CLOSES[tag].search(page, at)
            at = close.end() if close else len(page)
            continue
        if tag in BLOCKS:
            flush()
            while stack[-1].tag == "p":
                pop()
        elif tag in ("td", "th"):
            words.append(" ")
        if tag in VOID or raw.endswith("/") and tag not in BLOCKS:
            continue
        on = stack[-1]
        kind, slot = _kind(tag, raw)
        if on.kind == "site":
            # An article's heading stays, though its header goes.
            inside = tag in HEADINGS and on.around == "article" and on.header
            new = _Open(tag, "article", slot, "", False) if inside else _Open(tag, "site", on.slot, on.around, on.header and tag in ("header", "hgroup", "div", "p"))
        elif on.kind == "named" and kind != "site":
            new = _Open(tag, "named", on.slot, on.around, False)
        elif not kind or kind == "main" and on.kind == "article":
            new = _Open(tag, on.kind, slot, "", False)
        else:
            new = _Open(tag, kind, slot, on.around if on.kind == "named" else on.kind, tag in ("header", "hgroup"))
        if new.kind != on.kind:
            flush()
        stack.append(new)
        opened[tag] += 1
    flush()
    return out


def _row(a: list, b: list) -> list[int]:
    """Bit vectors of the longest common subsequence's table, one for each element of b; a zero bit is a step."""
    match: dict = {}
    for i, x in enumerate(a):
        match[x] = match.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v, rows = full, []
    for y in b:
        u = v & match.get(y, 0)
        v = (v + u | v - u) & full
        rows.append(v)
    return rows


def common_lines(a: list, b: list) -> list[int]:
    """The places in a of one longest common subsequence of a and b, exactly; bounded memory by halving b."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    ends = [*range(lo)], [*range(len(a) - hi, len(a))]
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if not a or not b:
        return ends[0] + ends[1]
    if len(a) * len(b) > MAX_BITS and len(b) > 1:
        half = len(b) // 2
        up, down = _steps(a, b[:half]), _steps(a[::-1], b[half:][::-1])[::-1]
        cut = max(range(len(a) + 1), key=lambda i: up[i] + down[i])
        middle = common_lines(a[:cut], b[:half]) + [cut + i for i in common_lines(a[cut:], b[half:])]
    else:
        rows, middle, i, j = _row(a, b), [], len(a) - 1, len(b) - 1
        while i >= 0 and j >= 0:
            if a[i] == b[j]:
                middle.append(i)
                i, j = i - 1, j - 1
            elif rows[j] >> i & 1:
                i -= 1
            else:
                j -= 1
        middle.reverse()
    return ends[0] + [lo + i for i in middle] + ends[1]


def _steps(a: list, b: list) -> list[int]:
    """Lengths of the longest common subsequence of each start of a with b."""
    match: dict = {}
    for i, x in enumerate(a):
        match[x] = match.get(x, 0) | 1 << i
    full = v = (1 << len(a)) - 1
    for y in b:
        u = v & match.get(y, 0)
        v = (v + u | v - u) & full
    out = [0]
    for i in range(len(a)):
        out.append(out[-1] + (not v >> i & 1))
    return out


class Text(NamedTuple):
    """A page's text, and how many lines went because its pair has them, has their slot, or by markup alone."""

    text: str
    shared: int
    slots: int
    markup: int


def main_text(page: list[Line], pair: list[Line] | None) -> Text:
    """The lines that are the page's own."""
    named = next((k for k in ("article", "main") if any(x.kind == k for x in page)), "")
    protected = {"article", "main"} if named == "main" else {named} - {""}
    theirs = {x.slot for x in pair or () if x.kind in ("site", "named")}
    outside = {x.slot for x in pair or () if x.kind not in ("article", "main")}
    shared = set(common_lines([x.text for x in page], [x.text for x in pair])) if pair else set()
    kept, copies, gone = [], [], [0, 0, 0]
    for i, x in enumerate(page):
        if x.kind in protected:
            kept.append(x.text)
        elif i in shared:
            gone[0] += 1
            if not named and x.kind != "site":
                copies.append(x.text)
        elif x.slot in theirs and x.kind in ("site", "named") or named and x.slot in outside:
            gone[1] += 1
        elif x.kind == "site" or named and x.kind != "named" or x.kind == "named" and not pair:
            gone[2] += 1
        else:
            kept.append(x.text)
    return Text("\n".join(kept or copies), *gone)


def _key(path: str | None, page_id: int | None) -> tuple:
    """Orders as Spark does: by bytes, nulls first."""
    return path is not None, (path or "").encode(), page_id is not None, page_id or 0


def _with_parts(df: DataFrame) -> DataFrame:
    """df with part, the page's range of its host, and copy: whether the row is a copy for the part beside its own."""
    session, keys = df.sparkSession, df.select("host", "path", "page_id")
    large = max(LARGE_ROWS, df.count() // LARGE_SHARE)
    hot = keys.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") > large).select(F.col("host").alias("hot"))  # LARGE_SHARE rows at most
    keys = keys.join(F.broadcast(hot), F.col("host").eqNullSafe(F.col("hot"))).drop("hot")
    sampled, cuts = defaultdict(set), {}
    for host, path, page_id in keys.where(F.pmod(F.xxhash64("path", "page_id"), F.lit(large)) < SAMPLES).collect():  # about SAMPLES a part
        sampled[host].add(_key(path, page_id))
    for host, found in sampled.items():
        cuts[host] = sorted(found)[SAMPLES::SAMPLES]
    if not any(cuts.values()):
        return df.withColumn("part", F.lit(0)).withColumn("copy", F.lit(False))
    shared = session.sparkContext.broadcast(cuts)

    @F.udf("int", useArrow=True)
    def part(host: str | None, path: str | None, page_id: int | None) -> int:
        found = shared.value.get(host)
        return bisect_right(found, _key(path, page_id)) if found else 0

    ends, copies = defaultdict(list), defaultdict(list)
    at = F.struct("path", "page_id")
    for r in keys.groupBy("host", part("host", "path", "page_id").alias("part")).agg(F.min(at).alias("low"), F.max(at).alias("high")).collect():
        ends[r["host"]].append((r["part"], _key(*r["low"]), _key(*r["high"])))
    for host, found in ends.items():
        found.sort()
        for (one, _, high), (other, low, _) in zip(found, found[1:]):
            copies[host, high].append(other)
            copies[host, low].append(one)
    edges = session.sparkContext.broadcast(dict(copies))

    @F.udf("array<int>", useArrow=True)
    def parts(host: str | None, path: str | None, page_id: int | None) -> list[int]:
        found = shared.value.get(host)
        if not found:
            return [0]
        key = _key(path, page_id)
        return [bisect_right(found, key), *edges.value.get((host, key), ())]

    placed = df.select("*", F.posexplode(parts("host", "path", "page_id")).alias("copy", "part"))
    return placed.withColumn("copy", F.col("copy") > 0)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, pair_id and the lines that went (shared_lines, slot_lines, markup_lines) of every row of pages."""
    df = _with_parts(pages.select("page_id", "url", urls.host(F.col("url")).alias("host"), urls.path(F.col("url")).alias("path"), "html"))
    df = df.select("page_id", "url", "host", "part", "path", "copy", "html").repartition("host", "part").sortWithinPartitions("host", "part", "path", "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "text", "n_chars", "pair_id", "shared_lines", "slot_lines", "markup_lines"]
        types = (pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 5)

        def read() -> Iterator[tuple]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 64):
                    for page_id, url, host, part, path, copy, page in zip(*(c.to_pylist() for c in batch.slice(lo, 64).columns), strict=True):
                        yield page_id, url, (host, part), path, lines(page), copy

        def nearest(one: tuple, *others: tuple | None) -> tuple | None:
            same = [x for x in others if x and x[2] == one[2]]
            return max(same, key=lambda x: len(commonprefix([x[3], one[3]])), default=None)

        def result(before: tuple | None, one: tuple, after: tuple | None) -> tuple:
            pair = nearest(one, before, after)
            text, *gone = main_text(one[4], pair and pair[4])
            return one[0], one[1], text, len(text), pair and pair[0], *gone

        out, size, before, one = [], 0, None, None
        for after in chain(read(), (None,)):
            if one is not None and not one[5]:
                out.append(result(before, one, after))
                size += len(out[-1][2])
                if size > 4_000_000 or len(out) >= 2_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                    out, size = [], 0
            before, one = one, after
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return df.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint, pair_id bigint, shared_lines bigint, slot_lines bigint, markup_lines bigint")
