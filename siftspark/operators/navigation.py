"""What a landed page says of its place in a site: breadcrumb, section path, routes; and the profiles of help and portal pages.

Edge cases: a null page is empty and has none of these; a null URL leaves relative routes out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from .dom import HIDDEN, Node, inside, tree

# The class and attribute names by which such pages mark their parts.
ACTIVE_CLASSES = [{"toc-item", "active"}, {"nav-item", "active"}, {"tree-item", "selected"}, None, {"ohc-sidebar-item", "active"}, {"is-selected"}]  # None: aria-current="page"
ITEM_CLASSES = {"toc-item", "tree-item", "nav-item"}
NAV_CLASSES = {"sapTntSideNavigation", "sapMNav"}
NAV_CLASS_PARTS = ("sidebar", "Sidebar", "side-nav")
ROUTE_ATTRIBUTES = ("data-href", "data-url", "data-route", "data-navigate", "data-path")
SIDEBAR_LABEL, TAB, TAB_LABEL = "sapMeSidebarTextContent", "sapMITBFilter", "sapMITBText"
TAB_AREA_CLASSES, TAB_AREA_ID = {"sapMPage", "sapMShellContent"}, "content"
SHELL_CLASSES, SHELL_ID = {"sapUshellShellHead", "sapMShellHeader", "sapUshellShellHeadItm", "sapMeShellHead"}, "shell-header"
PLACEHOLDER_TABS = {"some title a", "other title b", "shorter c", "title a", "title b", "title c", "tab 1", "tab 2", "tab 3"}
LINK_CLASSES, TILE_CLASSES = {"sapMLnk", "sapMLink"}, {"sapMGT", "sapFCard", "sapMGenericTile", "sapMTile"}
CARD_CLASSES, SECTION_CLASSES = {"sapFCard", "sapMGT", "sapMGenericTile"}, {"sapUxAPObjectPageSection", "sapUxAPObjectPageSubSection"}
BOX_AREA, BOX_CLASSES = "sapFDynamicPageContent", {"sapMFlexBox", "sapMVBox"}
TABLE_CLASSES = ("sapMList", "sapMTable", "sapUiTable", "sapUiTableCCnt", "sapMListItems", "sapMGrowingList", "sapUiTableCtrlScr", "sapMListTbl", "table.sapMListTbl", "sapUiAnalyticalTable", "sapUiTreeTable")
HEADER_CELLS, ROWS, CELLS = {"sapMListTblHeaderCell", "sapMColumnHeader"}, {"sapMLIB", "sapUiTableRow", "sapMListTblRow"}, {"sapMListTblCell", "sapUiTableCell"}
CODE_CLASSES = ("qtextgrey", "qtext")
HELP_LABELS = {"Description", "Note", "Source Code", "Example"}


def breadcrumb(root: Node) -> list[str]:
    """The different texts of the first kind of breadcrumb that has any."""
    named = lambda name: lambda n: name in n.classes
    label = lambda n: n.attrs.get("aria-label", "")
    kinds = ((named("breadcrumb"), "a"), (named("breadcrumb"), "li"), (lambda n: label(n) == "breadcrumb", "a"), (named("ohc-breadcrumb"), "a"), (lambda n: n.tag == "nav" and "breadcrumb" in label(n), "a"))
    for container, tag in kinds:
        found = dict.fromkeys(filter(None, (n.text() for n in inside(root, container, lambda n: n.tag == tag))))
        if found:
            return list(found)
    return []


def _first_line(node: Node) -> str:
    for line in "".join(node.strings(breaks="\n")).split("\n"):
        if line.strip():
            return " ".join(line.split())[:100]
    return ""


def section_path(root: Node) -> list[str]:
    """The active entry of the table of contents after the entries around it, outermost first."""
    item = lambda n: n.tag == "li" or ITEM_CLASSES & n.classes
    nodes = list(root.walk())
    for classes in ACTIVE_CLASSES:
        active = next((n for n in nodes if (classes <= n.classes if classes else n.attrs.get("aria-current") == "page")), None)
        if active is None:
            continue
        around = [n for n in (active, *active.above()) if item(n)]
        # The innermost item is the active entry's own row; those above it are its ancestors.
        path = [line for n in (*reversed(around[1:]), active) if (line := _first_line(n))]
        if path:
            return path
    return []


def _slug(label: str) -> str:
    return re.sub(r"\s+", "", re.sub(r"\s*&\s*", "", label.lower()))


def routes(root: Node, url: str | None) -> list[str]:
    """The URLs that navigation parts of the page name, each once; labels stand for paths."""
    base = urlsplit(url or "")
    origin, home = f"{base.scheme}://{base.netloc}", base.path.rstrip("/")
    parent = home.rpartition("/")[0] if "/" in home.lstrip("/") else home
    out: dict[str, None] = {}

    def add(target: str) -> None:
        if target.startswith("http"):
            out[target] = None

    def anchored(n: Node) -> str:
        href = n.attrs.get("href", "")
        return "" if n.tag != "a" or not href or href.startswith(("#", "javascript:")) else urljoin(url or "", href)

    nav = lambda n: n.tag in ("nav", "aside") or n.attrs.get("role") == "navigation" or NAV_CLASSES & n.classes or any(p in n.attrs.get("class", "") for p in NAV_CLASS_PARTS)
    for n in inside(root, nav, lambda n: n.tag == "a"):
        add(anchored(n))
    nodes = list(root.walk())
    for n in nodes:
        value = next((n.attrs[a] for a in ROUTE_ATTRIBUTES if n.attrs.get(a)), "")
        add(origin + value if value.startswith("/") else value)
    for n in nodes:
        label = n.text() if SIDEBAR_LABEL in n.classes else ""
        if 1 < len(label) < 80 and _slug(label) not in ("", "status"):
            add(f"{origin}/{_slug(label)}")
    area = next((n for n in nodes if TAB_AREA_CLASSES & n.classes or n.attrs.get("id") == TAB_AREA_ID), root)
    for n in area.walk():
        shell = lambda a: SHELL_CLASSES & a.classes or a.attrs.get("id") == SHELL_ID
        if TAB not in n.classes or "overflow" in n.attrs.get("id", "") or any(shell(a) for a in (n, *n.above())):
            continue
        label = next((x for x in n.walk() if TAB_LABEL in x.classes), n).text()
        if 2 <= len(label) <= 80 and label != "More" and label.lower() not in PLACEHOLDER_TABS and _slug(label) and parent:
            add(f"{origin}{parent}/{_slug(label)}")
    for n in nodes:
        href = n.attrs.get("href", "")
        if LINK_CLASSES & n.classes and (href.startswith("/") or href.startswith("http") and origin in href):
            add(urljoin(url or "", href))
    for n in inside(root, lambda a: bool(TILE_CLASSES & a.classes), lambda n: n.tag == "a"):
        if base.netloc in anchored(n):
            add(anchored(n))
    for n in nodes:
        href = n.attrs.get("href", "")
        if n.tag == "a" and href.startswith("#") and 1 < len(href) < 100:
            add(f"{origin}/{href[1:]}")
    return list(out)


def help_profile(root: Node) -> dict:
    """title, text, code_blocks and headings of a help page; code stands once more at the end of the text."""
    nodes = list(root.walk())
    of = lambda tag: [n for n in nodes if n.tag == tag]
    labels = [n.text() for n in of("span") if "h2" in n.classes]
    titles = [n.text() for n in (*of("title")[:1], *of("h1")[:1])] + [x for x in reversed(labels) if len(x) > 3 and x not in HELP_LABELS]
    code = []
    for name in CODE_CLASSES:
        for n in of("span"):
            if name in n.classes:
                lines = "".join("\n" if isinstance(x, Node) else x for x in _flat(n)).replace("\xa0", " ").strip()
                code += [lines] if len(lines) > 30 else []
    if not code:
        code = [x for n in (*of("pre"), *of("code")) if len(x := "".join(n.strings()).strip()) > 30]
    wanted = (lambda n: n.attrs.get("id") == "main-content", lambda n: "content-area" in n.classes, lambda n: n.tag == "main", lambda n: n.tag == "article", lambda n: n.attrs.get("id") == "content", lambda n: n.tag == "body")
    main = next((n for test in wanted for n in nodes if test(n)), None)
    text = "\n".join(x.strip() for x in main.strings(HIDDEN | {"nav", "footer"}) if x.strip()) if main else ""
    text = re.sub(" {2,}", " ", text)
    headings = {f"h{k}": [x for n in of(f"h{k}") if (x := n.text())] for k in range(1, 7)}
    headings["h2"] += [x for x in labels if x]
    if code:
        text = "\n\n".join((text, "--- Code ---", *code)).strip()
    return {"title": next(filter(None, titles), ""), "text": text, "code_blocks": code, "headings": [(k, v) for k, v in headings.items() if v]}


def _flat(node: Node) -> Iterator[Node | str]:
    """The texts and line breaks inside an element."""
    stack: list[Node | str] = list(reversed(node.items))
    while stack:
        item = stack.pop()
        if isinstance(item, str) or item.tag == "br":
            yield item
        else:
            stack.extend(reversed(item.items))


def portal_tables(root: Node) -> list[dict]:
    """headers and rows of the portal's own table controls, one kind after the other, then of plain tables; rows without text and tables without rows go."""
    kinds = [name.rpartition(".") for name in TABLE_CLASSES]  # a table control of two kinds counts under each
    controls = [n for tag, _, name in kinds for n in root.walk() if name in n.classes and tag in ("", n.tag)]
    out = []
    for table in controls + [n for n in root.walk() if n.tag == "table"]:
        plain = table.tag == "table"
        inner = list(table.walk())
        headers = [x for n in inner if (n.tag == "th" or not plain and HEADER_CELLS & n.classes) and (x := n.text())]
        rows = []
        for row in inner:
            if row.tag == "tr" or not plain and ROWS & row.classes:
                cells = [n.text() for n in row.walk() if n.tag == "td" or not plain and CELLS & n.classes]
                rows += [cells] if any(cells) else []
        if rows:
            out.append({"headers": headers, "rows": rows})
    return out


def portal_cards(root: Node) -> str:
    """The different texts of cards, then of page sections, then of content boxes."""
    boxes = inside(root, lambda a: BOX_AREA in a.classes, lambda n: bool(BOX_CLASSES & n.classes))
    nodes = list(root.walk())
    texts = [x for n in nodes if CARD_CLASSES & n.classes and len(x := n.text()) > 3]
    texts += [x for n in [*(n for n in nodes if SECTION_CLASSES & n.classes), *boxes] if len(x := n.text()) > 10]
    return "\n\n".join(dict.fromkeys(texts))


_STRINGS = pa.list_(pa.string())
PLACE = pa.schema([("breadcrumb", _STRINGS), ("section_path", _STRINGS), ("routes", _STRINGS)])
PLACE_DDL = "breadcrumb array<string>, section_path array<string>, routes array<string>"
PROFILE = pa.schema([
    ("title", pa.string()), ("text", pa.string()), ("code_blocks", _STRINGS), ("headings", pa.map_(pa.string(), _STRINGS)),
    ("tables", pa.list_(pa.struct([("headers", _STRINGS), ("rows", pa.list_(_STRINGS))]))), ("cards", pa.string()),
])
PROFILE_DDL = "title string, text string, code_blocks array<string>, headings map<string,array<string>>, tables array<struct<headers:array<string>,rows:array<array<string>>>>, cards string"


def _mapped(pages: DataFrame, key: str, schema: pa.Schema, ddl: str, read) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                found = [read(tree(page), url) for url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([x[f.name] for x in found], f.type) for f in schema)], names=[key, "url", *schema.names])

    return pages.select(key, "url", "html").mapInArrow(run, f"`{key}` {pages.schema[key].dataType.simpleString()}, url string, {ddl}")


def places(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, url, breadcrumb, section_path and the raw routes of every page."""
    return _mapped(pages, key, PLACE, PLACE_DDL, lambda root, url: {"breadcrumb": breadcrumb(root), "section_path": section_path(root), "routes": routes(root, url)})


def profiles(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, url and the help and portal profile of every page."""
    return _mapped(pages, key, PROFILE, PROFILE_DDL, lambda root, _: help_profile(root) | {"tables": portal_tables(root), "cards": portal_cards(root)})


def site_routes(found: DataFrame, key: str = "page_id") -> DataFrame:
    """key, pos and dst: the normalised routes of `places` on the page's own host, each once, in order."""
    rows = found.select(key, "url", F.posexplode("routes").alias("pos", "route"))
    rows = rows.select(key, "url", "pos", F.explode(F.array(U.normalize(F.col("route")))).alias("dst"))
    return rows.where(F.col("dst").isNotNull() & F.contains(F.lower("dst"), U.domain(F.col("url")))).groupBy(key, "dst").agg(F.min("pos").alias("pos"))


def help_links(html: Column, url: Column) -> Column:
    """Absolute URLs of a help page's script links, then of its links to .htm and .html files, each once."""
    calls = F.regexp_extract_all(html, F.lit(r"""(?i)javascript:call_link\(['"]([^'"]+\.htm)['"]"""), F.lit(1))
    hrefs = F.regexp_extract_all(html, F.lit(r"""(?i)href=["']([^"']*\.html?)["']"""), F.lit(1))
    return F.array_distinct(F.transform(F.concat(calls, F.filter(hrefs, lambda x: ~x.startswith("javascript:"))), lambda x: U.resolve(x, url)))


def portal_text(text: Column, tables: Column, cards: Column, least: int = 300, most_rows: int = 200) -> Column:
    """text with the tables' lines, or the cards' text where that is longer and the rest below `least` words."""
    line = lambda cells: F.concat(F.lit("\n"), F.array_join(cells, " | "))
    lines = F.transform(tables, lambda t: F.concat(F.when(F.size(t["headers"]) > 0, line(t["headers"])).otherwise(F.lit("")), F.array_join(F.transform(F.slice(t["rows"], 1, most_rows), line), "")))
    whole = F.concat(text, F.array_join(lines, ""))
    return U.let(whole, lambda t: F.when((T.word_count(t) < least) & (T.word_count(cards) > T.word_count(t)), cards).otherwise(t))


def preferred_text(text: Column, other: Column, factor: float = 1.2) -> Column:
    """other where it has more than `factor` times the words of text."""
    return F.when(T.word_count(other) > T.word_count(text) * F.lit(factor), other).otherwise(text)
