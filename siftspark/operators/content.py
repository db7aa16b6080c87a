"""Choosing a page's content: named areas, text density, engine selectors, and the ladder of fallbacks.

`contents` parses each page once, in Arrow batches; the ladder is column expressions over the candidate texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import dom

# Fixed values.
STRIPPED_TAGS = frozenset("script style noscript iframe svg canvas template picture source video audio nav footer header aside form button input select textarea label".split())
STRIPPED_ROLES = frozenset("navigation banner complementary contentinfo".split())
CONTENT_NAMES = ["content", "main", "main-content", "article", "post", "entry", "body-content", "page-content", "primary", "main-body", "page-body", "wrapper", "container", "site-content", "entry-content", "post-content", "text-content", "maincontent", "mainContent"]
CONTENT_WORDS = ["content", "main", "body", "article", "entry"]
OTHER_WORDS = ["nav", "menu", "sidebar", "footer", "header"]
NAVIGATION_WORDS = ["nav", "menu", "sidebar", "footer", "header", "breadcrumb", "pagination", "social", "share", "cookie", "consent", "banner", "modal", "popup", "ad", "advertisement", "promo", "related", "comment", "widget"]
CONTENT_SELECTORS = [
    "main", "article", ".content", ".main-content", "#content", '[role="main"]', ".documentation", ".doc-content", ".ohc-main-content", ".topic-content", ".theme-doc-markdown", ".markdown-section", ".md-content",
    ".rst-content", ".document", ".wiki-content", ".article-body", ".MuiContainer-root", ".chakra-container", ".slds-template__container", "#publicationContent", "article.ohc-grid-type", '[role="tree"]',
    "ft-reader", "ft-designed-page", "ft-homepage", "ft-search", ".FT-content", ".FT-reader", '[class*="FT-"]',
]
EXCLUDE_SELECTORS = [
    "nav", "header", "footer", ".sidebar", ".toc", ".breadcrumb", "script", "style", "noscript", ".social-share", ".share-buttons", "oj-menu-button", "#socialMediaButton", ".navigation-side-bar", ".feedback-widget",
    '[class*="feedback-widget"]', "#consent_blackbar", "#trustarc-banner-overlay", "#onetrust-banner-sdk", "#CybotCookiebotDialog",
]

_SELECTOR = re.compile(r"([\w-]*)(?:#([\w-]+))?((?:\.[\w-]+)*)(?:\[([\w-]+)(\*?)=\"([^\"]*)\"\])?")


def matcher(selector: str) -> Callable[[dom.Node], bool]:
    """A test for `tag#id.class[name="value"]` (or `*=` for a part of the value), each part optional."""
    tag, name, classes, attribute, part, value = _SELECTOR.fullmatch(selector).groups()
    wanted = frozenset(classes.split(".")) - {""}

    def fits(node: dom.Node) -> bool:
        if tag and node.tag != tag or name and node.attrs.get("id") != name or not wanted <= node.classes:
            return False
        found = node.attrs.get(attribute, "") if attribute else ""
        return not attribute or (value in found if part else value == found)

    return fits


class Measures:
    """Sizes of every element of a tree without the elements that `gone` names: characters and number of its trimmed strings, and paragraphs in it."""

    def __init__(self, root: dom.Node, gone: Callable[[dom.Node], bool]) -> None:
        self.nodes: list[dom.Node] = []
        self.gone = gone
        stack = [root]
        while stack:
            node = stack.pop()
            if not gone(node):
                self.nodes.append(node)
                stack.extend(x for x in reversed(node.items) if isinstance(x, dom.Node))
        self.size: dict[dom.Node, tuple[int, int, int]] = {}
        for node in reversed(self.nodes):
            chars = pieces = paragraphs = 0
            for item in node.items:
                if isinstance(item, str):
                    n = len(item.strip())
                    chars, pieces = chars + n, pieces + (n > 0)
                elif item in self.size:
                    c, p, k = self.size[item]
                    chars, pieces, paragraphs = chars + c, pieces + p, paragraphs + k + (item.tag in ("p", "li", "td", "blockquote"))
            self.size[node] = chars, pieces, paragraphs

    def chars(self, node: dom.Node, separated: bool = False) -> int:
        chars, pieces, _ = self.size[node]
        return chars + max(0, pieces - 1) * separated

    def text(self, node: dom.Node) -> str:
        out, stack = [], [node]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                out.append(item)
            elif item in self.size:
                stack.extend(reversed(item.items))
        return " ".join(" ".join(x.strip() for x in out).split())


def _names(node: dom.Node) -> str:
    return f"{node.attrs.get('id', '')} {node.attrs.get('class', '')}".lower()


def main_area(m: Measures, least: int = 100) -> dom.Node | None:
    """The named content area with enough text: `main`, `article`, the role, the known names as id or class in their order, then parts of names."""
    enough = lambda n: n is not None and m.chars(n) >= least
    first: dict[str, dom.Node] = {}
    for n in m.nodes:
        keys = [f"<{n.tag}", f"@{n.attrs.get('role', '')}", f"#{n.attrs.get('id', '')}", *(f".{c}" for c in n.classes)]
        for key in keys:
            first.setdefault(key, n)
    for key in ("<main", "<article", "@main", *(f"{kind}{name}" for name in CONTENT_NAMES for kind in "#.")):
        if enough(first.get(key)):
            return first[key]
    for n in m.nodes:
        if n.tag in ("div", "section") and any(w in _names(n) for w in CONTENT_WORDS) and not any(w in _names(n) for w in OTHER_WORDS) and enough(n):
            return n
    return None


def densest(m: Measures, least: int = 100) -> dom.Node | None:
    """The block without a navigation name that has the most text, 50 characters added for each paragraph in it; the first of equals."""
    blocks = [n for n in m.nodes if n.tag in ("div", "section", "article", "main") and not any(w in _names(n) for w in NAVIGATION_WORDS) and m.chars(n, True) >= least]
    return max(blocks, key=lambda n: m.chars(n, True) + 50 * m.size[n][2], default=None)


def selected(root: dom.Node, m: Measures, selectors: list[str], ample: int | None = 500, least: int = 100) -> dom.Node | None:
    """The first selector's element with ample text, else the one with the most if that is enough; without `ample` the first that there is."""
    best = None
    nodes = [n for n in root.walk() if n in m.size]
    for selector in selectors:
        node = next(filter(matcher(selector), nodes), None)
        if node is None:
            continue
        size = len(m.text(node))
        if ample is None or size >= ample:
            return node
        if best is None or size > best[0]:
            best = size, node
    return best[1] if best and best[0] >= least else None


def standard_text(root: dom.Node, most: int | None = None) -> tuple[str, str]:
    """(text, how): the named area's if it has 200 characters, else the densest block's, else the body's; cut after `most` characters with an ellipsis."""
    m = Measures(root, lambda n: n.tag in STRIPPED_TAGS or n.attrs.get("role") in STRIPPED_ROLES)
    out = None
    for how, choose in (("main", main_area), ("density", densest)):
        node = choose(m)
        if node is not None and m.chars(node, True) >= 200:
            out = m.text(node), how
            break
    if out is None:
        out = m.text(next((n for n in m.nodes if n.tag == "body"), root)), "body"
    text, how = out
    return (text[:most] + "..." if most and len(text) > most else text), how


def engine_texts(root: dom.Node) -> tuple[str, str, str]:
    """(text without the excluded elements, whole text, text of the first selector that fits) of the engines' content areas."""
    body = next((n for n in root.walk() if n.tag == "body"), root)
    hidden = Measures(root, lambda n: n.tag in dom.HIDDEN)
    area = selected(root, hidden, CONTENT_SELECTORS) or body
    excluded = [matcher(s) for s in EXCLUDE_SELECTORS]
    kept = Measures(area, lambda n: n is not area and (n.tag in dom.HIDDEN or any(f(n) for f in excluded)))
    return kept.text(area), hidden.text(area), hidden.text(selected(root, hidden, CONTENT_SELECTORS, ample=None) or body)


COLUMNS = "text string, text_from string, engine_text string, engine_whole string, first_text string, anchors int"


def contents(pages: DataFrame, key: str = "page_id", most: int | None = None) -> DataFrame:
    """key, url, text and text_from (standard choice), engine_text, engine_whole, first_text (engines'), anchors of every page. Nulls are empty pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 128):
                batch = whole.slice(lo, 128)
                rows = []
                for page in batch.column(2).to_pylist():
                    root = dom.tree(page)
                    rows.append((*standard_text(root, most), *engine_texts(root), sum(n.tag == "a" and "href" in n.attrs for n in root.walk())))
                columns = [pa.array(c, pa.int32() if i == 5 else pa.string()) for i, c in enumerate(zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=[key, "url", *(c.split()[0] for c in COLUMNS.split(", "))])

    return pages.select(key, "url", "html").mapInArrow(run, f"`{key}` {pages.schema[key].dataType.simpleString()}, url string, {COLUMNS}")


def poorly_parsed(body_chars: Column, anchors: Column) -> Column:
    """A page with text but no link, whose parse is worth a second parser."""
    return (body_chars > 200) & (anchors == 0)


def longest(candidates: Column) -> Column:
    """The longest of an array of texts; the first of equals."""
    best = F.aggregate(candidates, F.lit(""), lambda a, t: F.when(F.length(t) > F.length(a), t).otherwise(a))
    return F.coalesce(best, F.lit(""))


def ladder(dom_text: Column, shadow: Column, api: Column, topic: Column, whole: Column, least: int = 20) -> Column:
    """struct(text, source): the text after exclusions, replaced by each fallback in turn where it says enough more.

    Shadow roots below `least` words; an API response below `least` or three times as long; a topic below 300 words; the
    text before exclusions below `least` words, or if exclusions kept less than 35 % of 50 words or more.
    """
    n = T.word_count
    step = lambda state, use, text, source: F.when(use, F.struct(text.alias("text"), F.lit(source).alias("source"))).otherwise(state)
    state = F.struct(F.coalesce(dom_text, F.lit("")).alias("text"), F.lit("dom").alias("source"))

    def then(state: Column, source: str, text: Column, when: Callable[[Column, Column], Column]) -> Column:
        text = F.coalesce(text, F.lit(""))
        return F.get(F.transform(F.array(state), lambda s: step(s, when(n(s["text"]), n(text)), text, source)), F.lit(0))

    state = then(state, "shadow", shadow, lambda now, other: (now < least) & (other > now) & (other >= least))
    state = then(state, "api", api, lambda now, other: (now < least) & (other >= least) | (other >= 3 * F.greatest(now, F.lit(1))))
    state = then(state, "topic", topic, lambda now, other: (now < 300) & (other >= least) & (other > now))
    return then(state, "whole", whole, lambda now, other: ((now < least) | (now > 0) & (other >= 50) & (now < 0.35 * other)) & (other > now) & (other >= least))


def largest_response(responses: DataFrame, key: str) -> DataFrame:
    """key and body of the longest successful API response of each page. responses: key, url, status, content_type, body."""
    fits = F.col("url").contains("/api/") & (F.col("status") == 200) & F.lower("content_type").contains("text/html")
    return responses.where(fits).groupBy(key).agg(F.max_by("body", F.struct(F.length("body"), F.col("url"))).alias("body"))


def topic_content(pages: DataFrame, topics: DataFrame, path: Column) -> DataFrame:
    """pages with map_id, content_id and content of the topic at their path, or at the path without a leading `/docs`; contents of 100 characters or fewer do not count.

    topics: pretty_url, map_id, content_id, content. Two equi-joins, so neither side is gathered.
    """
    found = topics.dropDuplicates(["pretty_url"])
    first, second = (found.select(*(F.col(c).alias(f"__{c}{i}") for c in found.columns)) for i in (1, 2))
    df = pages.withColumn("__path", path).withColumn("__short", F.regexp_replace("__path", "^/docs", ""))
    df = df.join(first, F.col("__path") == F.col("__pretty_url1"), "left").join(second, F.col("__short") == F.col("__pretty_url2"), "left")
    hit = F.col("__pretty_url1").isNotNull()
    pick = lambda c: F.when(hit, F.col(f"__{c}1")).otherwise(F.col(f"__{c}2"))
    content = F.when(F.length(pick("content")) > 100, pick("content"))
    return df.select(*(pages[c] for c in pages.columns), pick("map_id").alias("map_id"), pick("content_id").alias("content_id"), content.alias("content"))


def topic_links(base: Column, pretty_url: Column) -> Column:
    """The absolute URL of a topic."""
    return F.concat(F.regexp_replace(base, "/+$", ""), F.when(F.startswith(pretty_url, F.lit("/")), pretty_url).otherwise(F.concat(F.lit("/"), pretty_url)))


def enriched(title: Column, url: Column, headings: Column, tables: Column, other_title: Column, other_headings: Column, other_tables: Column) -> Column:
    """struct(title, headings, tables) filled from another page's: the title and tables if missing (a title that is the URL counts as none), headings level by level."""
    missing = F.coalesce(title, F.lit("")).isin("") | (title == url)
    kept = F.map_filter(headings, lambda k, _: ~F.coalesce(F.array_contains(F.map_keys(other_headings), k), F.lit(False)))
    return F.struct(
        F.when(missing & (F.coalesce(other_title, F.lit("")) != ""), other_title).otherwise(title).alias("title"), F.map_concat(kept, F.coalesce(other_headings, F.map_filter(headings, lambda _, __: F.lit(False)))).alias("headings"),
        F.when(F.size(tables) > 0, tables).otherwise(other_tables).alias("tables"),
    )


def supplemented(links: Column, *more: tuple[Column, Column]) -> Column:
    """links with each supplement (when, links) that applies, in order, each link once."""
    out = links
    for when, extra in more:
        out = F.when(when, F.array_union(out, F.coalesce(extra, F.array().cast("array<string>")))).otherwise(out)
    return out


def without_json(blocks: Column) -> Column:
    """Code blocks that are not one JSON value in brackets."""
    bracketed = lambda b: b.rlike(r"(?s)^(\{.*\}|\[.*\])$") & F.try_parse_json(b).isNotNull()
    return F.filter(blocks, lambda b: ~F.coalesce(bracketed(b), F.lit(False)))


def static_fallback(text: Column, most: int = 50_000) -> Column:
    """struct(text, word_count): the text is cut, the words are counted before."""
    return F.struct(F.substring(text, 1, most).alias("text"), T.word_count(text).alias("word_count"))
