"""Extraction from HTML: a profile in column expressions, and a parsed one as an Arrow function."""

from __future__ import annotations

import html
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from .classify import internal_link

ENTITIES = {"&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&quot;": '"', "&#39;": "'", "&lt;": "<", "&gt;": ">", "&amp;": "&"}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


def unescape(text: Column) -> Column:
    for code, plain in ENTITIES.items():
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def plain(markup: Column) -> Column:
    """Markup as text: scripts, styles and comments dropped, tags as spaces, white space collapsed."""
    bare = F.regexp_replace(markup, r"(?is)<(script|style|noscript)\b.*?</(script|style|noscript)\s*>|<!--.*?-->", " ")
    return T.collapse(unescape(F.regexp_replace(bare, "<[^>]*>", " ")))


def _element(markup: Column, tag: str) -> Column:
    return F.regexp_extract(markup, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)


def title(markup: Column) -> Column:
    """`<title>`, else `og:title`, else the first h1."""
    og = F.regexp_extract(markup, r"""(?is)<meta[^>]*property=["']og:title["'][^>]*content=["']([^"']*)["']""", 1)
    return F.coalesce(*(F.nullif(plain(x), F.lit("")) for x in (_element(markup, "title"), og, _element(markup, "h1"))), F.lit(""))


def heading_title(markup: Column) -> Column:
    """The first h1, else `<title>`."""
    return F.coalesce(F.nullif(plain(_element(markup, "h1")), F.lit("")), plain(_element(markup, "title")))


def meta_description(markup: Column) -> Column:
    one = lambda kind, name: F.nullif(T.collapse(unescape(F.regexp_extract(markup, rf"""(?is)<meta[^>]*{kind}=["']{name}["'][^>]*content=["']([^"']*)["']""", 1))), F.lit(""))
    return F.coalesce(one("name", "description"), one("property", "og:description"), one("name", "twitter:description"), F.lit(""))


def headings(markup: Column) -> Column:
    """map of h1..h6 to their texts; levels without a heading are absent."""
    lists = [F.filter(F.transform(F.regexp_extract_all(markup, F.lit(rf"(?is)<{h}\b[^>]*>(.*?)</{h}\s*>"), F.lit(1)), plain), lambda t: t != "") for h in HEADINGS]
    return F.map_filter(F.map_from_arrays(F.array(*map(F.lit, HEADINGS)), F.array(*lists)), lambda _, v: F.size(v) > 0)


def main_text(markup: Column) -> Column:
    """Text of `<main>`, else `<article>`, else the body, without navigation, header, footer and forms."""
    bare = F.regexp_replace(markup, r"(?is)<(script|style|nav|header|footer|aside|form|noscript)\b.*?</(script|style|nav|header|footer|aside|form|noscript)\s*>", " ")
    def text(b: Column) -> Column:
        inner = F.when(b.rlike(r"(?i)<main\b"), _element(b, "main")).when(b.rlike(r"(?i)<article\b"), _element(b, "article")).otherwise(F.lit(""))
        return U.let(plain(inner), lambda t: F.when(t != "", t).otherwise(plain(F.regexp_extract(b, r"(?is)<body\b[^>]*>(.*?)(</body\s*>|$)", 1))))

    return U.let(bare, text)


def links(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, url, pos, href and dst: the absolute URL of each link in page order."""
    base = F.explode(F.array(U.parts(U.joinable_base(F.col("url"))))).alias("__base")  # once a page
    found = pages.select(key, "url", "html", base).select(key, "url", "__base", F.posexplode(F.regexp_extract_all("html", F.lit(r"""(?is)<a\b[^>]*?\bhref=["']([^"']*)["']"""), F.lit(1))).alias("pos", "href"))
    # A generator keeps the long expression from being inlined wherever dst is read.
    return found.select("*", F.explode(F.array(U.normalize_in(F.col("href"), F.col("__base")))).alias("dst")).drop("__base")


def standard_links(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, url, pos, dst and internal: each page's links, once each without its fragment, in order of first use. Junk schemes do not count."""
    base = F.explode(F.array(U.parts(U.joinable_base(F.col("url"))))).alias("__base")
    hrefs = F.regexp_extract_all("html", F.lit(r"""(?is)<a\b[^>]*?\bhref=["']([^"']*)["']"""), F.lit(1))
    hrefs = F.filter(F.transform(hrefs, lambda h: U.strip(unescape(h))), lambda h: (h != "") & ~h.rlike("^(javascript:|mailto:|tel:|#)"))
    urls = pages.select(key, "url", "html", base).select(key, "url", F.array_distinct(F.transform(hrefs, lambda h: F.regexp_replace(U.resolve_in(h, F.col("__base")), "(?s)#.*$", ""))).alias("dsts"))
    return urls.select(key, "url", F.posexplode("dsts").alias("pos", "dst")).withColumn("internal", internal_link(F.col("dst"), F.col("url")))


def rejections(links: DataFrame, accepted: Column, junk: Column, key: str = "page_id") -> DataFrame:
    """Per page, how many links (key, url, pos, href, dst) go by the first reason that holds, and how many stay."""
    reason = F.when(F.col("href").rlike(U.JUNK_RE), "nonhttp").when(F.col("dst").isNull(), "normalize").when(U.netloc(F.col("dst")) != U.domain(F.col("url")), "external").when(junk, "junk").when(~accepted, "scope")
    first = F.col("pos") == F.min("pos").over(Window.partitionBy(key, "dst"))
    df = links.withColumn("reason", F.coalesce(reason, F.when(~first, "dedup"), F.lit("accepted")))
    return df.groupBy(key).agg(*(F.count_if(F.col("reason") == r).alias(r) for r in ("external", "nonhttp", "normalize", "junk", "scope", "dedup", "accepted")))


def link_class(url: Column, href: Column, dst: Column, accepted: Column) -> Column:
    """Why a link is not followed, by the first reason that holds, or `accepted`."""
    return (
        F.when(href.rlike(U.JUNK_RE), "nonhttp").when(dst.isNull(), "normalize").when(U.netloc(dst) != U.domain(url), "external").when(~accepted, "scope").otherwise("accepted")
    )


class _Tree(HTMLParser):
    """One pass over a page: what the parsed profile returns."""

    SKIP = frozenset("script style noscript template svg".split())
    NOISE = frozenset("nav header footer aside form".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.meta, self.images, self.hrefs, self.tables, self.code = "", {}, [], [], [], []
        self.headings: dict[str, list[str]] = {}
        self.blocks: list[tuple[int, int, str]] = []  # (block, how deep in noise, text)
        self.open: list[str] = []
        self.hold: list[tuple[str, list[str]]] = []
        self.block = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        own = dict(attrs)
        if tag == "meta":
            self.meta.setdefault((own.get("name") or own.get("property") or "").lower(), own.get("content") or "")
        elif tag == "img" and own.get("src"):
            self.images.append({k: own.get(k) or "" for k in ("src", "alt", "title", "width", "height")})
        elif tag == "a" and own.get("href"):
            self.hrefs.append(own["href"])
        elif tag == "table":
            self.tables.append(([], []))
        elif tag == "tr" and self.tables:
            self.tables[-1][1].append([])
        if tag in ("title", "pre", "code", "th", "td", *HEADINGS):
            self.hold.append((tag, []))
        if tag in ("p", "div", "section", "article", "main", "li", "tr", *HEADINGS):
            self.block += 1
        if tag not in ("meta", "img", "br", "hr", "link", "input", "wbr"):
            self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            while self.open.pop() != tag:
                pass
        for i in range(len(self.hold) - 1, -1, -1):
            if self.hold[i][0] == tag:
                _, got = self.hold.pop(i)
                text = "".join(got) if tag in ("pre", "code") else " ".join("".join(got).split())
                if tag == "title":
                    self.title = self.title or text
                elif tag in HEADINGS and text:
                    self.headings.setdefault(tag, []).append(text)
                elif tag in ("pre", "code") and len(text.strip()) > 10:
                    self.code.append(text.strip())
                elif tag == "th" and self.tables:
                    self.tables[-1][0].append(text)
                elif tag == "td" and self.tables and self.tables[-1][1]:
                    self.tables[-1][1][-1].append(text)
                break

    def handle_data(self, data: str) -> None:
        for _, got in self.hold:
            got.append(data)
        if not self.SKIP.intersection(self.open) and "title" not in self.open and data.strip():
            self.blocks.append((self.block, sum(t in self.NOISE for t in self.open), data))


def tree(page: str | None) -> dict:
    """title, meta_description, headings, text, tables, code_blocks, images and hrefs of a page."""
    t = _Tree()
    t.feed(page or "")
    t.close()
    text = " ".join(" ".join(x for _, noise, x in t.blocks if not noise).split())
    tables = [{"headers": h, "rows": [r for r in rows if r]} for h, rows in t.tables]
    return {
        "title": t.title or html.unescape(t.meta.get("og:title", "")) or next(iter(t.headings.get("h1", [])), ""),
        "meta_description": next((t.meta[k] for k in ("description", "og:description", "twitter:description") if t.meta.get(k)), ""),
        "headings": list(t.headings.items()), "text": text, "tables": [x for x in tables if x["headers"] or x["rows"]][:20], "code_blocks": t.code[:20], "images": t.images, "hrefs": list(dict.fromkeys(t.hrefs)),
    }


TREE = pa.schema([
    ("title", pa.string()), ("meta_description", pa.string()), ("headings", pa.map_(pa.string(), pa.list_(pa.string()))), ("text", pa.string()),
    ("tables", pa.list_(pa.struct([("headers", pa.list_(pa.string())), ("rows", pa.list_(pa.list_(pa.string())))]))), ("code_blocks", pa.list_(pa.string())),
    ("images", pa.list_(pa.struct([(k, pa.string()) for k in ("src", "alt", "title", "width", "height")]))), ("hrefs", pa.list_(pa.string())),
])
TREE_DDL = "title string, meta_description string, headings map<string,array<string>>, text string, tables array<struct<headers:array<string>,rows:array<array<string>>>>, code_blocks array<string>, images array<struct<src:string,alt:string,title:string,width:string,height:string>>, hrefs array<string>"


def parsed(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, url and the parsed profile of every page. The html goes no further than this scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                found = [tree(p) for p in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([x[f.name] for x in found], f.type) for f in TREE)], names=[key, "url", *TREE.names])

    return pages.select(key, "url", "html").mapInArrow(run, f"{key} {pages.schema[key].dataType.simpleString()}, url string, {TREE_DDL}")
