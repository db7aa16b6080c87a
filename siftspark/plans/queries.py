"""Registered queries over the landed tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import chunking, extract, gates, graph, metrics, navigation, report, robots, scope, sections
from ..sources import files
from ..sources.tables import shared_dir, table
from ..streaming import runs

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---- URLs

_RFC = r"(?s)^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?$"
_PARTS = f"""u AS (SELECT page_id, url, lower(regexp_extract(url, '{_RFC}', 2)) AS scheme, regexp_extract(url, '{_RFC}', 4) AS netloc, regexp_extract(url, '{_RFC}', 5) AS path,
  regexp_extract(url, '{_RFC}', 7) AS query, regexp_extract(url, '{_RFC}', 9) AS fragment FROM pages)"""


def _list(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _form(drop: list[str], ordered: bool = False) -> str:
    kept = f"list_filter(string_split(query, '&'), lambda p: p <> '' AND lower(split_part(p, '=', 1)) NOT IN ({_list(drop)}))"
    kept = f"list_sort({kept})" if ordered else kept
    return f"array_to_string(list_transform({kept}, lambda p: split_part(p, '=', 1) || '=' || substr(p, length(split_part(p, '=', 1)) + 2)), '&')"


_NORM = f"""n AS (SELECT page_id, url, scheme, lower(netloc) AS host, CASE WHEN path IN ('', '/') THEN '/' ELSE regexp_replace(regexp_replace(path, '/+', '/', 'g'), '/$', '') END AS path, {_form(U.TRACKING_PARAMS)} AS q FROM u),
m AS (SELECT *, CASE WHEN scheme IN ('http', 'https') AND host <> '' AND NOT regexp_matches(path, '{U.SKIP_RE}') THEN scheme || '://' || host || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS norm FROM n)"""
_CANON = """c AS (SELECT page_id, url, scheme, regexp_replace(regexp_replace(lower(netloc), CASE scheme WHEN 'http' THEN ':80$' ELSE ':443$' END, ''), '^www\\.', '') AS host,
  CASE WHEN path IN ('', '/') THEN '/' ELSE regexp_replace(path, '/+$', '') END AS path, query FROM u)"""


def _pages(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages")


@_query(f"WITH {_PARTS} SELECT page_id, scheme, netloc AS host, path, query, fragment FROM u")
def url_split(s: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return _pages(s, d).select("page_id", U.scheme(u).alias("scheme"), U.netloc(u).alias("host"), U.path(u).alias("path"), U.query(u).alias("query"), U.fragment(u).alias("fragment"))


@_query(f"WITH {_PARTS}, {_NORM} SELECT page_id, norm FROM m")
def url_normalize(s: SparkSession, d: str) -> DataFrame:
    return _pages(s, d).select("page_id", U.normalize(F.col("url")).alias("norm"))


@_query(f"WITH {_PARTS}, {_NORM} SELECT norm, min(page_id) AS first_page, count(*) AS pages FROM m WHERE norm IS NOT NULL GROUP BY norm")
def url_normalize_dedup(s: SparkSession, d: str) -> DataFrame:
    df = _pages(s, d).select("page_id", U.normalize(F.col("url")).alias("norm")).where("norm is not null")
    return df.groupBy("norm").agg(F.min("page_id").alias("first_page"), F.count("*").alias("pages"))


@_query(f"WITH {_PARTS}, {_CANON} SELECT page_id, host, path, scheme || '://' || host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS raw FROM c")
def url_canonical(s: SparkSession, d: str) -> DataFrame:
    return _pages(s, d).select("page_id", U.canonical(F.col("url")).alias("c")).select("page_id", "c.host", "c.path", "c.raw")


_REPORT = f"""r AS (SELECT page_id, url, scheme || '://' || regexp_replace(lower(netloc), '^www\\.', '') || regexp_replace(regexp_replace(regexp_replace(path, '/+', '/', 'g'), '/$', ''), '(/index\\.html|/index\\.htm|/index\\.php)$', '')
  || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS norm FROM (SELECT *, {_form(U.REPORT_PARAMS, True)} AS q FROM u))"""


@_query(f"WITH {_PARTS}, {_REPORT} SELECT page_id, norm FROM r")
def url_report_norm(s: SparkSession, d: str) -> DataFrame:
    return _pages(s, d).select("page_id", U.report(F.col("url")).alias("norm"))


@_query(f"WITH {_PARTS}, {_NORM} SELECT page_id, md5(norm) AS url_hash, substr(sha256(norm), 1, 16) AS doc_id FROM m")
def url_hash(s: SparkSession, d: str) -> DataFrame:
    n = U.normalize(F.col("url"))
    return _pages(s, d).select("page_id", U.url_hash(n).alias("url_hash"), T.doc_id(n).alias("doc_id"))


@_query(f"WITH {_PARTS} SELECT lower(netloc) AS domain, count(*) AS pages FROM u GROUP BY 1")
def url_domain_counts(s: SparkSession, d: str) -> DataFrame:
    return _pages(s, d).groupBy(U.domain(F.col("url")).alias("domain")).agg(F.count("*").alias("pages"))


@_query(f"WITH {_PARTS} SELECT page_id, scheme || '://' || netloc || '/robots.txt' AS robots, translate(netloc, '.:', '__') || '_' || translate(substr(path, 1, 30), '/', '_') AS output_name FROM u")
def url_origin_names(s: SparkSession, d: str) -> DataFrame:
    return _pages(s, d).select("page_id", U.robots_url(F.col("url")).alias("robots"), U.output_name(F.col("url")).alias("output_name"))


# ---- Scope

ROOT = "https://blog.tionsh.example.net/en"


@_query(f"WITH {_PARTS}, {_CANON} SELECT page_id, path = '/en' OR starts_with(path, '/en/') AS in_scope FROM c")
def scope_filter_subtree(s: SparkSession, d: str) -> DataFrame:
    return _pages(s, d).select("page_id", scope.in_scope(F.col("url"), F.concat(U.origin(F.col("url")), F.lit("/en"))).alias("in_scope"))


@_query(f"""WITH {_PARTS}, {_CANON}, k AS (SELECT *, array_to_string(list_filter(string_split(query, '&'), lambda p: split_part(p, '=', 1) <> 'ref'), '&') AS q FROM c)
SELECT page_id, scheme || '://' || host || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS cleaned FROM k
WHERE host = 'blog.tionsh.example.net' AND (path = '/en' OR starts_with(path, '/en/')) AND NOT regexp_matches(path, '(?i)/en/1[0-9]*\\.html')""")
def scope_filter_deny(s: SparkSession, d: str) -> DataFrame:
    rule = scope.Scope(ROOT, deny=(r"/EN/1[0-9]*\.html", "(broken"), strip_keys=("ref",))
    return _pages(s, d).select("page_id", rule.filter_and_clean(F.col("url")).alias("cleaned")).where("cleaned is not null")


@_query(f"""WITH {_PARTS}, {_CANON}, e AS (SELECT *, len(list_filter(string_split(substr(path, 4), '/'), lambda x: x <> '')) AS extra FROM c)
SELECT page_id, CASE WHEN NOT (path = '/en' OR starts_with(path, '/en/')) OR host <> 'blog.tionsh.example.net' THEN 0.0::DOUBLE WHEN extra = 0 THEN 1.0::DOUBLE WHEN extra = 1 THEN 0.9::DOUBLE WHEN extra = 2 THEN 0.7::DOUBLE ELSE greatest(0.3, 0.7 - 0.1 * extra)::DOUBLE END AS score FROM e""")
def scope_score(s: SparkSession, d: str) -> DataFrame:
    return _pages(s, d).select("page_id", scope.Scope(ROOT).score(F.col("url")).alias("score"))


@_query(f"WITH {_PARTS}, {_CANON} SELECT page_id, path AS root_path, CASE WHEN regexp_matches(path, '(?i)\\.html$') THEN CASE WHEN regexp_replace(path, '/[^/]*$', '') = '' THEN '/' ELSE regexp_replace(path, '/[^/]*$', '') END ELSE path END AS scope_path FROM c")
def scope_info(s: SparkSession, d: str) -> DataFrame:
    p = U.canonical(F.col("url"))["path"]
    return _pages(s, d).select("page_id", p.alias("root_path"), U.scope_path(p).alias("scope_path"))


@_query(f"""WITH {_PARTS}, {_CANON}, s AS (SELECT page_id, list_filter(string_split(path, '/'), lambda x: x <> '') AS a, ['en', '1'] AS b FROM c)
SELECT page_id, CASE WHEN len(a) > 0 AND a[1] = 'en' THEN CASE WHEN len(a) > 1 AND a[2] = '1' THEN '/en/1' ELSE '/en' END ELSE '/' END AS widened FROM s""")
def scope_widen_lcp(s: SparkSession, d: str) -> DataFrame:
    return _pages(s, d).select("page_id", scope.widened(U.canonical(F.col("url"))["path"], F.lit("/en/1")).alias("widened"))


# ---- Extraction

_UNESCAPE = "replace(replace(replace(replace(replace(replace(replace(replace({0}, '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
_DROPPED = r"(?is)<(script|style|noscript)\b.*?</(script|style|noscript)\s*>|<!--.*?-->"


def _plain(x: str) -> str:
    bare = f"regexp_replace(regexp_replace({x}, '{_DROPPED}', ' ', 'g'), '<[^>]*>', ' ', 'g')"
    return f"trim(regexp_replace({_UNESCAPE.format(bare)}, '\\s+', ' ', 'g'))"


_TITLE = _plain(r"regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1)")
_H1 = _plain(r"regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1\s*>', 1)")
_BARE = r"regexp_replace(html, '(?is)<(script|style|nav|header|footer|aside|form|noscript)\b.*?</(script|style|nav|header|footer|aside|form|noscript)\s*>', ' ', 'g')"
_TEXT = _plain(rf"regexp_extract({_BARE}, '(?is)<article\b[^>]*>(.*?)</article\s*>', 1)")
_WORDS = r"len(regexp_extract_all({0}, '\S+'))"
_PAGE_TEXT = f"t AS (SELECT page_id, url, {_TITLE} AS title, {_TEXT} AS body FROM pages)"


def _page_text(s: SparkSession, d: str) -> DataFrame:
    return _pages(s, d).select("page_id", "url", extract.title(F.col("html")).alias("title"), extract.main_text(F.col("html")).alias("body"))


@_query(f"SELECT page_id, coalesce(nullif({_TITLE}, ''), {_H1}) AS title, coalesce(nullif({_H1}, ''), {_TITLE}) AS heading_title FROM pages")
def page_title(s: SparkSession, d: str) -> DataFrame:
    return _pages(s, d).select("page_id", extract.title(F.col("html")).alias("title"), extract.heading_title(F.col("html")).alias("heading_title"))


@_query(f"SELECT page_id, 'h1' AS level, 0 AS pos, {_H1} AS heading FROM pages WHERE {_H1} <> ''")
def page_headings(s: SparkSession, d: str) -> DataFrame:
    rows = _pages(s, d).select("page_id", F.explode(extract.headings(F.col("html"))).alias("level", "texts"))
    return rows.select("page_id", "level", F.posexplode("texts").alias("pos", "heading"))


@_query(f"WITH {_PAGE_TEXT} SELECT page_id, title, md5(body) AS text_md5, {_WORDS.format('body')}::BIGINT AS words FROM t")
def page_text_static(s: SparkSession, d: str) -> DataFrame:
    return _page_text(s, d).select("page_id", "title", F.md5("body").alias("text_md5"), T.word_count(F.col("body")).cast("bigint").alias("words"))


@_query("SELECT page_id, '' AS description FROM pages")
def page_meta(s: SparkSession, d: str) -> DataFrame:
    return _pages(s, d).select("page_id", extract.meta_description(F.col("html")).alias("description"))


_LINKS = f"""a AS (SELECT u.page_id, u.url, u.scheme, u.netloc, regexp_extract_all(p.html, '(?is)<a\\b[^>]*?\\bhref=["'']([^"'']*)["'']', 1) AS hrefs FROM u JOIN pages p USING (page_id, url)),
l AS (SELECT page_id, url, scheme, netloc, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) - 1 AS pos FROM a),
k AS (SELECT page_id, url, pos, href, scheme || '://' || lower(netloc) || CASE WHEN href = '/' THEN '/' ELSE regexp_replace(href, '/$', '') END AS dst FROM l)"""


@_query(f"WITH {_PARTS}, {_LINKS} SELECT page_id, pos, href, dst FROM k")
def page_links(s: SparkSession, d: str) -> DataFrame:
    return extract.links(_pages(s, d)).select("page_id", "pos", "href", "dst")


def _classes(s: SparkSession, d: str) -> DataFrame:
    df = extract.links(_pages(s, d))
    accepted = scope.in_scope(F.col("dst"), F.concat(U.origin(F.col("url")), F.lit("/a"))) | ~U.path(F.col("dst")).startswith("/a")
    return df.withColumn("kind", extract.link_class(F.col("url"), F.col("href"), F.col("dst"), accepted))


_KIND = f"{_LINKS}, kinds AS (SELECT page_id, pos, CASE WHEN starts_with(href, '/a') AND NOT (href = '/a' OR starts_with(href, '/a/')) THEN 'scope' ELSE 'accepted' END AS kind FROM k)"


@_query(f"WITH {_PARTS}, {_KIND} SELECT page_id, pos, kind FROM kinds")
def page_link_classes(s: SparkSession, d: str) -> DataFrame:
    return _classes(s, d).select("page_id", "pos", "kind")


@_query(f"WITH {_PARTS}, {_KIND} SELECT kind, count(*) AS links FROM kinds GROUP BY kind")
def page_link_reject_counts(s: SparkSession, d: str) -> DataFrame:
    return _classes(s, d).groupBy("kind").agg(F.count("*").alias("links"))


@_query(f"""WITH {_PARTS}, {_LINKS}, {_PAGE_TEXT}, g AS (SELECT page_id, url, list(dst ORDER BY pos) AS dsts FROM k GROUP BY ALL)
SELECT t.page_id, t.title, {_H1} AS h1, '' AS h2, substr(body, 1, 10000) AS text_content, coalesce(len(dsts), 0)::BIGINT AS internal_links_count, coalesce(array_to_string(dsts[1:50], ' | '), '') AS internal_links
FROM t JOIN pages p USING (page_id, url) LEFT JOIN g USING (page_id, url)""")
def page_flat_csv_row(s: SparkSession, d: str) -> DataFrame:
    html, url = F.col("html"), F.col("url")
    hrefs = F.regexp_extract_all(html, F.lit(r"""(?is)<a\b[^>]*?\bhref=["']([^"']*)["']"""), F.lit(1))
    flat = files.flat_page(F.transform(hrefs, lambda h: U.normalize(h, url)), extract.headings(html), extract.main_text(html))
    return _pages(s, d).select("page_id", extract.title(html).alias("title"), *(flat[c].alias(c) for c in ("h1", "h2", "text_content", "internal_links_count", "internal_links")))


_VISIBLE = r"""length(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<body[^>]*>(.*?)(</body>|$)', 1), '(?is)<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g'), '\s+', '', 'g'))"""


@_query(f"""SELECT page_id, {_VISIBLE} < 150 OR regexp_matches(html, '(?is)<div[^>]*\\bid=["'']?(root|app|__next|__nuxt)["'']?[^>]*>\\s*</div>') AS js_required FROM pages""")
def js_required(s: SparkSession, d: str) -> DataFrame:
    return _pages(s, d).select("page_id", gates.js_required(F.col("html")).alias("js_required"))


@_query(f"WITH {_PAGE_TEXT} SELECT page_id, CASE WHEN len(regexp_extract_all(html, '(?i)<a\\b[^>]*\\bhref=')) < 5 AND length(body) < 200 THEN 'js' ELSE 'html' END AS complexity FROM t JOIN pages USING (page_id, url)")
def page_complexity(s: SparkSession, d: str) -> DataFrame:
    html = F.col("html")
    closed = F.regexp_count(html, F.lit(r"""(?i)aria-expanded=["']false["']|\bdata-(bs-)?toggle=|class=["'][^"']*\bcollapsed\b|<details(?![^>]*\bopen\b)"""))
    few = (F.regexp_count(html, F.lit(r"(?i)<a\b[^>]*\bhref=")) < 5) & (F.length(extract.main_text(html)) < 200)
    return _pages(s, d).select("page_id", F.when((closed >= 3) | few, "js").otherwise("html").alias("complexity"))


_ERRORS = "page not found|404|not available|access denied|forbidden|unauthorized|no permission|error occurred"


@_query(f"WITH {_PAGE_TEXT} SELECT page_id, regexp_matches(lower(title), '{_ERRORS}') OR regexp_matches(lower(substr(body, 1, 500)), '{_ERRORS}') AS soft_404 FROM t")
def soft_404(s: SparkSession, d: str) -> DataFrame:
    return _page_text(s, d).select("page_id", gates.soft_404(F.col("title"), F.col("body")).alias("soft_404"))


_LOADING = r"loading application|loading\.\.\.|please wait|initializing|just a moment"


@_query(f"WITH h AS (SELECT doc_id, lower(substr(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 500)) AS head FROM documents) SELECT doc_id, regexp_matches(head, '{_LOADING}') OR (contains(head, 'cookie') AND contains(head, 'accept') AND length(head) < 600) AS loading FROM h")
def spa_loading(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", gates.still_loading(F.col("text")).alias("loading"))


@_query()
def page_extract_tree(s: SparkSession, d: str) -> DataFrame:
    p = extract.parsed(_pages(s, d))
    return p.select("page_id", "title", "meta_description", F.md5("text").alias("text_md5"), T.word_count(F.col("text")).alias("words"), F.size("hrefs").alias("links"), F.size("tables").alias("tables"), F.size("code_blocks").alias("code_blocks"), F.size("images").alias("images"), F.to_json("headings").alias("headings"))


# ---- Text


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' {2,}', ' ', 'g'), '^\s+|\s+$', '', 'g')"


@_query(f"SELECT doc_id, md5({_CLEAN}) AS cleaned, length({_CLEAN}) AS chars FROM documents")
def text_clean(s: SparkSession, d: str) -> DataFrame:
    c = T.clean(F.col("text"))
    return _docs(s, d).select("doc_id", F.md5(c).alias("cleaned"), F.length(c).cast("bigint").alias("chars"))


@_query(f"SELECT doc_id, {_WORDS.format('text')}::BIGINT AS words, length(text) AS chars, ({_WORDS.format('text')} * 13 // 10)::INT AS tokens FROM documents")
def word_counts(s: SparkSession, d: str) -> DataFrame:
    n = T.word_count(F.col("text"))
    return _docs(s, d).select("doc_id", n.cast("bigint").alias("words"), F.length("text").cast("bigint").alias("chars"), T.token_estimate(n).alias("tokens"))


@_query(r"WITH h AS (SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS hash FROM documents) SELECT hash, min(doc_id) AS first_doc, count(*) AS copies FROM h GROUP BY hash")
def content_hash_dups(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).groupBy(T.content_hash(F.col("text")).alias("hash")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


_BITS = " ".join(f"+ (CASE WHEN 2 * sum((h >> {k}) & 1) >= count(*) THEN (1::UBIGINT << {k}) ELSE 0::UBIGINT END)" for k in range(64))


@_query(rf"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\S+')) AS w FROM documents), h AS (SELECT doc_id, ('0x' || substr(md5(w), 17, 16))::UBIGINT AS h FROM w),
v AS (SELECT doc_id, lpad(lower(to_hex(0::UBIGINT {_BITS})), 16, '0') AS simhash FROM h GROUP BY doc_id) SELECT doc_id, coalesce(simhash, 'ffffffffffffffff') AS simhash FROM documents LEFT JOIN v USING (doc_id)""")
def simhash64(s: SparkSession, d: str) -> DataFrame:
    return T.simhash(_docs(s, d).select("doc_id", "text"), "text")


@_query("SELECT doc_id, bit_count(xor(('0x' || substr(md5(text), 1, 16))::UBIGINT, ('0x' || substr(md5(text), 17, 16))::UBIGINT))::INT AS distance FROM documents")
def hamming_distance(s: SparkSession, d: str) -> DataFrame:
    h = F.md5("text")
    return _docs(s, d).select("doc_id", T.hamming(F.substring(h, 1, 16), F.substring(h, 17, 16)).alias("distance"))


@_query("SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(replace(replace(text, 'Contact Us', ''), 'Next Page', ''), '(?m)^\\s*(ON|OFF)\\s*$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS cleaned FROM documents")
def boilerplate_phrases(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", F.md5(T.without_phrases(F.col("text"), T.VENDOR_PHRASES + T.PORTAL_PHRASES)).alias("cleaned"))


# ---- Gates


@_query(f"""WITH {_PARTS}, {_PAGE_TEXT}, f AS (SELECT t.page_id, md5(title || '|' || substr(body, 1, 1000) || '|' || u.path) AS print FROM t JOIN u USING (page_id, url))
SELECT page_id, print FROM (SELECT *, row_number() OVER (PARTITION BY print ORDER BY page_id) AS n FROM f) WHERE n = 1""")
def near_dup_pages(s: SparkSession, d: str) -> DataFrame:
    df = _page_text(s, d).select("page_id", gates.fingerprint(F.col("title"), F.col("body"), F.col("url")).alias("print"))
    return df.groupBy("print").agg(F.min("page_id").alias("page_id")).select("page_id", "print")


@_query(f"WITH w AS (SELECT doc_id, lower(text) AS low, {_WORDS.format('text')} AS n FROM documents) SELECT doc_id, n < 10 AND (contains(low, 'loading application') OR n = 0 OR (contains(low, 'cookie') AND n < 30)) AS skipped FROM w")
def low_content_gate(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", gates.low_content(F.col("text"), T.word_count(F.col("text"))).alias("skipped"))


@_query(r"WITH b AS (SELECT event_id, regexp_replace(props, '^\s+|\s+$', '', 'g') AS t FROM events) SELECT event_id, ((starts_with(t, '{') AND ends_with(t, '}')) OR (starts_with(t, '[') AND ends_with(t, ']'))) AND json_valid(t) AS is_json FROM b")
def json_dump_gate(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", gates.json_dump(F.col("props")).alias("is_json"))


_LINES = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
_DUP = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: regexp_matches(x, '^[0-9]'))"


@_query(f"""WITH f AS (SELECT contains(text, 'Share on LinkedIn') OR contains(text, 'Share on X') AS share, contains(text, 'Search Unavailable') OR contains(text, 'No matching results') AS search,
  contains(text, '© Oracle') OR contains(text, 'About Oracle') OR contains(text, 'Terms of Use') AS footer, contains(text, 'Was this page helpful') AS feedback,
  len({_LINES}) > 5 AND len(list_filter({_LINES}, lambda x: regexp_matches(x, '^([0-9]|Title|Get Help)'))) > 0.7 * len({_LINES}) AS toc_only,
  len({_DUP}) > len(list_distinct({_DUP})) AND len(list_distinct({_DUP})) > 3 AS dup_toc FROM documents)
SELECT count(*) FILTER (share) AS share, count(*) FILTER (search) AS search, count(*) FILTER (footer) AS footer, count(*) FILTER (feedback) AS feedback, count(*) FILTER (dup_toc) AS dup_toc, count(*) FILTER (toc_only) AS toc_only, count(*) AS docs FROM f""")
def quality_flags(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).agg(*(F.count_if(c).alias(k) for k, c in gates.quality_flags(F.col("text")).items()), F.count("*").alias("docs"))


@_query(f"""WITH w AS (SELECT text, {_WORDS.format('text')} AS n FROM documents) SELECT count(*) AS pages, sum(n)::BIGINT AS total_words, count(*) FILTER (n = 0) AS empty_pages,
count(*) FILTER (contains(text, 'Restricted Card Content') OR contains(text, 'not authorized to see') OR contains(text, 'Header Title (Not Shown)')) AS junk_pages, (sum(n) // greatest(count(*), 1))::BIGINT AS avg_words FROM w""")
def junk_summary(s: SparkSession, d: str) -> DataFrame:
    df = _docs(s, d).select("text", T.word_count(F.col("text")).cast("bigint").alias("n"))
    return df.agg(F.count("*").alias("pages"), F.sum("n").alias("total_words"), F.count_if(F.col("n") == 0).alias("empty_pages"), F.count_if(gates.portal_junk(F.col("text"))).alias("junk_pages"), F.expr("sum(n) div greatest(count(*), 1)").alias("avg_words"))


_JUNK = "(?i)(" + "|".join(gates.JUNK_PATTERNS) + ")"


@_query(f"SELECT page_id, regexp_matches(url, '{_JUNK}') AS junk FROM pages")
def junk_url_patterns(s: SparkSession, d: str) -> DataFrame:
    return _pages(s, d).select("page_id", gates.junk_url(F.col("url")).alias("junk"))


# ---- Chunks


def _chunk_sql(text: str) -> str:
    """The chunker as a recursive query over the units of each text."""
    n = _WORDS
    return rf"""WITH RECURSIVE d AS (SELECT doc_id, {text} AS text, {n.format(text)} AS n FROM documents),
p AS (SELECT doc_id, pi, p FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS pi FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS ps FROM d WHERE n > 600)) WHERE {n.format('p')} > 0),
s AS (SELECT doc_id, pi, CASE WHEN {n.format('p')} > 600 THEN string_split(regexp_replace(regexp_replace(p, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) ELSE [p] END AS ss FROM p),
x AS (SELECT doc_id, pi, unnest(ss) AS u, generate_subscripts(ss, 1) AS si FROM s),
k AS (SELECT doc_id, {n.format('u')}::BIGINT AS k, row_number() OVER (PARTITION BY doc_id ORDER BY pi, si) AS i, count(*) OVER (PARTITION BY doc_id) AS last FROM x),
f AS (SELECT doc_id, 0::BIGINT AS i, 0::BIGINT AS lo, 0::BIGINT AS hi, 0::BIGINT AS a, 0::BIGINT AS b FROM d WHERE n > 600
  UNION ALL SELECT f.doc_id, k.i, CASE WHEN f.hi > f.lo AND f.hi - f.lo + k.k > 400 THEN greatest(f.lo, f.hi - 40) ELSE f.lo END, f.hi + k.k,
    CASE WHEN f.hi > f.lo AND f.hi - f.lo + k.k > 400 THEN f.lo ELSE 0 END, CASE WHEN f.hi > f.lo AND f.hi - f.lo + k.k > 400 THEN f.hi ELSE 0 END FROM f JOIN k ON k.doc_id = f.doc_id AND k.i = f.i + 1),
r AS (SELECT doc_id, a, b FROM f WHERE b - a >= 20 UNION ALL SELECT f.doc_id, f.lo, f.hi FROM f JOIN k ON k.doc_id = f.doc_id AND k.i = f.i AND k.i = k.last WHERE f.hi - f.lo >= 20),
w AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS ws FROM d WHERE n > 600),
c AS (SELECT r.doc_id, (row_number() OVER (PARTITION BY r.doc_id ORDER BY b) - 1)::INT AS chunk_index, array_to_string(ws[a + 1:b], ' ') AS content FROM r JOIN w USING (doc_id)
  UNION ALL SELECT doc_id, 0, regexp_replace(text, '^\s+|\s+$', '', 'g') FROM d WHERE n BETWEEN 20 AND 600)"""


_PARAGRAPHS = "replace(text, chr(10), chr(10) || chr(10))"
_CHUNK_COLUMNS = f"doc_id, chunk_index, {_WORDS.format('content')}::BIGINT AS words, ({_WORDS.format('content')} * 13 // 10)::INT AS tokens, md5(content) AS content_md5"


def _chunk_rows(docs: DataFrame) -> DataFrame:
    n = T.word_count(F.col("content"))
    return chunking.chunks(docs.select("doc_id", "text"), "text").select("doc_id", "chunk_index", n.cast("bigint").alias("words"), T.token_estimate(n).alias("tokens"), F.md5("content").alias("content_md5"))


@_query(f"{_chunk_sql('text')} SELECT {_CHUNK_COLUMNS} FROM c")
def chunk_documents(s: SparkSession, d: str) -> DataFrame:
    return _chunk_rows(_docs(s, d))


@_query(f"{_chunk_sql(_PARAGRAPHS)} SELECT {_CHUNK_COLUMNS} FROM c")
def chunk_paragraphs(s: SparkSession, d: str) -> DataFrame:
    return _chunk_rows(_docs(s, d).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n"))))


@_query(f"{_chunk_sql('text')} SELECT doc_id, count(*) AS chunks, sum({_WORDS.format('content')})::BIGINT AS words, max({_WORDS.format('content')})::BIGINT AS longest FROM c GROUP BY doc_id")
def chunk_stats(s: SparkSession, d: str) -> DataFrame:
    return _chunk_rows(_docs(s, d)).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("words").alias("words"), F.max("words").alias("longest"))


@_query(f"{_chunk_sql('text')} SELECT count(DISTINCT doc_id) AS documents, count(*) AS chunks, sum({_WORDS.format('content')})::BIGINT AS words FROM c")
def corpus_stats(s: SparkSession, d: str) -> DataFrame:
    by_doc = _chunk_rows(_docs(s, d)).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("words").alias("words"))
    return by_doc.agg(F.count("*").alias("documents"), F.sum("chunks").alias("chunks"), F.sum("words").alias("words"))


@_query(f"""{_chunk_sql('text')}, l AS (SELECT doc_id, chunk_index, length(content) AS chars, coalesce(sum(length(content)) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT doc_id, chunk_index AS block_no, 'text' AS kind, chars::BIGINT AS chars FROM l WHERE before < 20000
UNION ALL SELECT doc_id, min(chunk_index), 'truncated', 0 FROM l WHERE before >= 20000 GROUP BY doc_id""")
def report_blocks(s: SparkSession, d: str) -> DataFrame:
    rows = chunking.chunks(_docs(s, d).select("doc_id", "text"), "text").select("doc_id", "chunk_index", F.length("content").cast("bigint").alias("chars"))
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    before = F.coalesce(F.sum("chars").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("before", before).withColumn("prior", F.lag("before").over(w))
    kept = rows.where((F.col("before") < 20_000) | (F.coalesce("prior", F.lit(0)) < 20_000))
    fits = F.col("before") < 20_000
    return kept.select("doc_id", F.col("chunk_index").alias("block_no"), F.when(fits, "text").otherwise("truncated").alias("kind"), F.when(fits, F.col("chars")).otherwise(0).alias("chars"))


@_query()
def rag_chunks(s: SparkSession, d: str) -> DataFrame:
    out = sections.rag_chunks(extract.parsed(_pages(s, d)))
    return out.withColumn("heading_path", F.array_join("heading_path", " > "))


# ---- Link graph

_RANKED = "p AS (SELECT lower(regexp_extract(url, '^[^:]*://([^/?#]*)', 1)) AS host, page_id FROM pages), k AS (SELECT host, row_number() OVER (PARTITION BY host ORDER BY page_id) AS i, count(*) OVER (PARTITION BY host) AS n FROM p)"


def _ranked(s: SparkSession, d: str) -> DataFrame:
    """host, page_id, i and n: each page's rank among its host's n pages."""
    w = Window.partitionBy("host")
    df = _pages(s, d).select(U.domain(F.col("url")).alias("host"), "page_id")
    return df.withColumn("i", F.row_number().over(w.orderBy("page_id"))).withColumn("n", F.count("*").over(w))


def _edges(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Links between a host's pages by rank: i to 2i and 2i + 1 and back to i div 2. (No link of the pages leads to another page of the table.)"""
    k = _ranked(s, d)
    to = F.filter(F.array(F.expr("2 * i"), F.expr("2 * i + 1"), F.expr("i div 2")), lambda x: (x > 0) & (x <= F.col("n")))
    name = lambda i: F.concat("host", F.lit("#"), i.cast("string"))
    edges = k.select("host", name(F.col("i")).alias("src"), F.posexplode(to).alias("pos", "j")).select("host", "src", "pos", name(F.col("j")).alias("dst"))
    return edges, k.select(name(F.lit(1)).alias("node")).distinct()


@_query(f"WITH {_PARTS}, {_LINKS} SELECT url AS src, dst, min(pos) AS pos FROM k GROUP BY url, dst")
def link_edges(s: SparkSession, d: str) -> DataFrame:
    return extract.links(_pages(s, d)).where("dst is not null").groupBy(F.col("url").alias("src"), "dst").agg(F.min("pos").alias("pos"))


_TREE = f"""WITH RECURSIVE {_RANKED}, e AS (SELECT host, i AS a, unnest([2 * i, 2 * i + 1, i // 2]) AS b, n FROM k), g AS (SELECT host, a, b FROM e WHERE b > 0 AND b <= n),
b AS (SELECT DISTINCT host, 1::BIGINT AS i, 0 AS depth FROM k UNION SELECT b.host, g.b, b.depth + 1 FROM b JOIN g ON g.host = b.host AND g.a = b.i WHERE b.depth < 24)"""


@_query(f"{_TREE} SELECT host || '#' || i AS node, min(depth)::INT AS depth FROM b GROUP BY host, i")
def bfs_depth(s: SparkSession, d: str) -> DataFrame:
    edges, seeds = _edges(s, d)
    return graph.bfs_depths(edges, seeds, 24)


@_query(f"""{_TREE}, m AS (SELECT host, i, min(depth)::INT AS depth FROM b GROUP BY host, i)
SELECT host || '#' || i AS node, depth, CASE WHEN i > 1 THEN host || '#' || (i // 2) END AS parent, row_number() OVER (ORDER BY depth, host || '#1', i) - 1 AS disc_order FROM m""")
def bfs_parent(s: SparkSession, d: str) -> DataFrame:
    edges, seeds = _edges(s, d)
    return graph.bfs(edges, seeds, 24)


@_query(f"""{_TREE}, m AS (SELECT host, i, min(depth)::INT AS depth FROM b GROUP BY host, i), o AS (SELECT host || '#' || i AS node, depth, row_number() OVER (ORDER BY depth, host || '#1', i) - 1 AS disc_order FROM m)
SELECT node, depth, disc_order FROM o WHERE disc_order < 100""")
def bfs_budget(s: SparkSession, d: str) -> DataFrame:
    edges, seeds = _edges(s, d)
    return graph.bfs(edges, seeds, 24, max_pages=100).select("node", "depth", "disc_order")


@_query()
def dfs_order(s: SparkSession, d: str) -> DataFrame:
    return graph.dfs_order(_edges(s, d)[0], "host", 24)


@_query(f"""WITH {_PARTS}, s AS (SELECT url, list_filter(string_split(path, '/'), lambda x: x <> '') AS a FROM u), e AS (SELECT url, a, unnest(range(1, len(a) + 1)) AS level FROM s WHERE len(a) > 0)
SELECT array_to_string(a[1:level], ' > ') AS path, level::INT AS level, count(*) AS pages, min(url) AS first_url FROM e GROUP BY 1, 2""")
def hierarchy_rollup(s: SparkSession, d: str) -> DataFrame:
    rows = _pages(s, d).select("url", F.filter(F.split(U.path(F.col("url")), "/"), lambda x: x != "").alias("sections"))
    return graph.hierarchy(rows, "sections", "url")


# ---- Coverage: the URLs without a fragment are the source, those over https the crawl.

_SETS = f"{_PARTS}, {_REPORT}, src AS (SELECT DISTINCT norm AS url FROM r WHERE NOT contains(url, '#')), crawl AS (SELECT DISTINCT norm AS url FROM r WHERE starts_with(url, 'https'))"


def _sets(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    u = F.col("url")
    rows = _pages(s, d).select("url", U.report(u).alias("norm"))
    return rows.where(~u.contains("#")).select(F.col("norm").alias("url")), rows.where(u.startswith("https")).select(F.col("norm").alias("url"))


@_query(f"""WITH {_SETS}, b AS (SELECT url, src.url IS NOT NULL AS s, crawl.url IS NOT NULL AS c FROM src FULL JOIN crawl USING (url)),
n AS (SELECT count(*) FILTER (s) AS total_source, count(*) FILTER (c) AS total_crawled, count(*) FILTER (s AND c) AS matched, count(*) FILTER (s AND NOT c) AS missed, count(*) FILTER (c AND NOT s) AS extra, count(*) AS combined FROM b),
p AS (SELECT *, round(matched / total_source * 100, 4)::DOUBLE AS coverage_pct, round(matched / total_crawled * 100, 4)::DOUBLE AS precision_pct FROM n)
SELECT *, CASE WHEN total_crawled < total_source THEN least(total_source + 50, total_source * 2) END AS suggested_pages, CASE WHEN coverage_pct >= 90 THEN 'excellent' WHEN coverage_pct >= 70 THEN 'good' WHEN coverage_pct >= 40 THEN 'moderate' ELSE 'low' END AS verdict FROM p""")
def coverage_report(s: SparkSession, d: str) -> DataFrame:
    return metrics.coverage(*_sets(s, d))


@_query(f"WITH {_SETS} SELECT url FROM src ANTI JOIN crawl USING (url) ORDER BY url LIMIT 30")
def coverage_missed_topn(s: SparkSession, d: str) -> DataFrame:
    return metrics.presence(*_sets(s, d)).where("in_source and not in_crawl").select("url").orderBy("url").limit(30)


@_query(f"WITH {_SETS} SELECT url FROM crawl ANTI JOIN src USING (url)")
def coverage_extra(s: SparkSession, d: str) -> DataFrame:
    return metrics.presence(*_sets(s, d)).where("in_crawl and not in_source").select("url")


@_query(f"""WITH {_SETS}, m AS (SELECT min(url) AS lo, max(url) AS hi FROM src), g AS (SELECT lo, hi, len(list_filter(range(1, least(length(lo), length(hi)) + 1), lambda i: substr(lo, 1, i) = substr(hi, 1, i))) AS n FROM m),
q AS (SELECT CASE WHEN length(regexp_extract(substr(lo, 1, n), '(?s)^(.*/)', 1)) > 1 THEN regexp_extract(substr(lo, 1, n), '(?s)^(.*/)', 1) ELSE substr(lo, 1, n) END AS prefix FROM g)
SELECT prefix, (SELECT count(*) FROM crawl ANTI JOIN src USING (url) WHERE starts_with(url, prefix)) AS extras_in_scope FROM q""")
def coverage_prefix(s: SparkSession, d: str) -> DataFrame:
    rows = metrics.presence(*_sets(s, d))
    prefix = rows.where("in_source").agg(F.min("url").alias("lo"), F.max("url").alias("hi")).select(metrics.common_prefix(F.col("lo"), F.col("hi")).alias("prefix"))
    extras = rows.where("in_crawl and not in_source").join(F.broadcast(prefix), F.startswith("url", "prefix"), "right")  # one row
    return extras.groupBy("prefix").agg(F.count("url").alias("extras_in_scope"))


# ---- robots.txt: one of four rule sets by the length of the host's name.

_ROBOTS = {
    1: "User-agent: *\nDisallow: /en/1\nCrawl-delay: 2\nSitemap: /sitemap.xml",
    2: "User-agent: *\nDisallow: /\n\nUser-agent: Googlebot\nAllow: /\nDisallow: /*/2\n",
    3: "# general\nUser-agent: *\nAllow: /en/ # open\nDisallow: /",
}


def _robots(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pages = _pages(s, d).select("page_id", U.domain(F.col("url")).alias("origin"), U.path(F.col("url")).alias("path"))
    k = F.length("origin") % 4
    text = F.when(k == 1, _ROBOTS[1]).when(k == 2, _ROBOTS[2]).when(k == 3, _ROBOTS[3])
    return pages, robots.rules(pages.select("origin").distinct().withColumn("robots_text", text).where("robots_text is not null"))


@_query(f"""WITH {_PARTS}, o AS (SELECT DISTINCT lower(netloc) AS origin FROM u) SELECT origin, length(origin) % 4 = 2 AS blocks_all, CASE WHEN length(origin) % 4 = 2 THEN '/*/2' ELSE '' END AS bot_disallows,
CASE length(origin) % 4 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 2 END AS general_rules, CASE WHEN length(origin) % 4 = 1 THEN 2.0::DOUBLE END AS crawl_delay, CASE WHEN length(origin) % 4 = 1 THEN '/sitemap.xml' ELSE '' END AS sitemaps FROM o WHERE length(origin) % 4 > 0""")
def robots_rules(s: SparkSession, d: str) -> DataFrame:
    return _robots(s, d)[1].select("origin", "blocks_all", F.array_join("bot_disallows", "|").alias("bot_disallows"), F.size("general").alias("general_rules"), "crawl_delay", F.array_join("sitemaps", "|").alias("sitemaps"))


@_query(f"""WITH {_PARTS} SELECT page_id, CASE length(lower(netloc)) % 4 WHEN 0 THEN true WHEN 1 THEN NOT starts_with(path, '/en/1') WHEN 2 THEN NOT regexp_matches(path, '^/.*/2') ELSE starts_with(path, '/en/') OR NOT starts_with(path, '/') END AS allowed FROM u""")
def robots_allowed(s: SparkSession, d: str) -> DataFrame:
    pages, found = _robots(s, d)
    return pages.join(found, "origin", "left").select("page_id", robots.allowed(F.col("path"), F.col("blocks_all"), F.col("bot_disallows"), F.col("general")).alias("allowed"))


# ---- Run metrics: events as page timings.

_TIMINGS = "t AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status, value AS total_ms FROM events)"


def _timings(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"), F.col("value").alias("total_ms"))


@_query(f"WITH {_TIMINGS} SELECT count(*) FILTER (status = 'ok') AS pages_ok, count(*) FILTER (status = 'skipped') AS pages_skipped, count(*) FILTER (status = 'failed') AS pages_failed, count(*) AS total_processed, coalesce(round(avg(total_ms) FILTER (total_ms > 0), 4), 0) AS avg_ms, max(total_ms) AS max_ms FROM t")
def crawl_stats(s: SparkSession, d: str) -> DataFrame:
    return metrics.snapshot(_timings(s, d))


@_query(f"WITH {_TIMINGS}, l AS (SELECT * FROM t ORDER BY ts DESC, event_id DESC LIMIT 1000), v AS (SELECT list(total_ms ORDER BY total_ms) AS v FROM l) SELECT v[least(floor(len(v) * 0.95)::INT, len(v) - 1) + 1] AS p95_ms, len(v) AS n FROM v")
def crawl_p95(s: SparkSession, d: str) -> DataFrame:
    return metrics.p95(metrics.last_rows(_timings(s, d), [F.desc("ts"), F.desc("event_id")]))


@_query(f"WITH {_TIMINGS} SELECT event_id, total_ms FROM t ORDER BY ts DESC, event_id DESC LIMIT 1000")
def crawl_last1000(s: SparkSession, d: str) -> DataFrame:
    return metrics.last_rows(_timings(s, d), [F.desc("ts"), F.desc("event_id")]).select("event_id", "total_ms")


@_query("SELECT event_id, count(*) OVER w AS in_window, count(*) OVER w / 30.0::DOUBLE AS rate FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 30000000 PRECEDING AND CURRENT ROW)")
def crawl_rolling_rate(s: SparkSession, d: str) -> DataFrame:
    return metrics.rolling_rate(table(s, d, "events"), "user_id").select("event_id", "in_window", "rate")


@_query(f"WITH {_TIMINGS} SELECT user_id, status, min(event_id) AS first_event, count(*) AS times FROM t WHERE status = 'failed' GROUP BY user_id, status")
def error_distinct(s: SparkSession, d: str) -> DataFrame:
    return _timings(s, d).where("status = 'failed'").groupBy("user_id", "status").agg(F.min("event_id").alias("first_event"), F.count("*").alias("times"))


@_query("""WITH o AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)
SELECT event_id, max(t - i * 3600000000) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) + i * 3600000000 - t AS wait_us FROM o""")
def token_bucket_waits(s: SparkSession, d: str) -> DataFrame:
    return metrics.token_bucket(table(s, d, "events"), "user_id", 1 / 3600).select("event_id", "wait_us")


@_query("SELECT event_id, unnest(range(0, 7))::INT AS attempt, least(pow(2.0, unnest(range(0, 7))), 60.0)::DOUBLE AS seconds FROM events WHERE event_type = 'error'")
def backoff_schedule(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").where("event_type = 'error'").select("event_id", F.posexplode(metrics.backoff(7)).alias("attempt", "seconds"))


@_query(f"WITH {_PARTS}, {_LINKS} SELECT page_id, pos, " + " OR ".join(f"(contains(dst, '{p}') AND NOT contains(url, '{p}'))" for p in gates.EXPIRY_PATTERNS) + " AS expired FROM k")
def session_expiry(s: SparkSession, d: str) -> DataFrame:
    return extract.links(_pages(s, d)).select("page_id", "pos", gates.session_expired(F.col("dst"), F.col("url")).alias("expired"))


# ---- Navigation, help pages, printed reports


@_query()
def page_places(s: SparkSession, d: str) -> DataFrame:
    found = navigation.places(_pages(s, d))
    return found.select("page_id", F.array_join("breadcrumb", " > ").alias("breadcrumb"), F.array_join("section_path", " > ").alias("section_path"), F.size("routes").alias("routes"))


@_query(rf"""WITH {_PARTS}, v AS (SELECT u.page_id, scheme, netloc, regexp_extract_all(array_to_string(regexp_extract_all(html, '(?is)<nav\b.*?</nav\s*>'), ''), '(?is)<a\b[^>]*?\bhref="(/[^"]*)"', 1) AS hrefs FROM u JOIN pages p USING (page_id, url)),
l AS (SELECT page_id, scheme, netloc, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) - 1 AS pos FROM v)
SELECT page_id, scheme || '://' || lower(netloc) || CASE WHEN href = '/' THEN '/' ELSE regexp_replace(href, '/$', '') END AS dst FROM l GROUP BY ALL""")
def nav_routes(s: SparkSession, d: str) -> DataFrame:
    return navigation.site_routes(navigation.places(_pages(s, d))).select("page_id", "dst")


@_query(f"""WITH RECURSIVE {_RANKED}, r AS (SELECT host, i, CASE WHEN i = 1 THEN host WHEN i % 3 = 0 THEN host || '#' || i END AS own FROM k),
w AS (SELECT host, i, own AS section, i AS up FROM r UNION ALL SELECT w.host, w.i, r.own, r.i FROM w JOIN r ON r.host = w.host AND r.i = w.up // 2 WHERE w.section IS NULL)
SELECT host || '#' || i AS node, section FROM w WHERE section IS NOT NULL""")
def section_inherit(s: SparkSession, d: str) -> DataFrame:
    k = _ranked(s, d)
    name = lambda i: F.concat("host", F.lit("#"), i.cast("string"))
    i = F.col("i")
    own = F.when(i == 1, F.array("host")).when(i % 3 == 0, F.array(name(i)))
    found = graph.inherited(k.select(name(i).alias("node"), F.when(i > 1, name(F.expr("i div 2"))).alias("parent"), own.alias("section_path")))
    return found.select("node", F.array_join("section_path", " > ").alias("section"))


@_query(rf"""WITH {_PARTS}, h AS (SELECT u.page_id, scheme || '://' || netloc AS origin, regexp_extract_all(html, '(?i)href=["'']([^"'']*\.html?)["'']', 1) AS hrefs FROM u JOIN pages p USING (page_id, url))
SELECT page_id, len(list_distinct(hrefs))::INT AS links, coalesce(origin || hrefs[1], '') AS first_link FROM h""")
def help_links(s: SparkSession, d: str) -> DataFrame:
    found = navigation.help_links(F.col("html"), F.col("url"))
    return _pages(s, d).select("page_id", found.alias("links")).select("page_id", F.size("links").alias("links"), F.coalesce(F.get("links", F.lit(0)), F.lit("")).alias("first_link"))


@_query()
def help_profile(s: SparkSession, d: str) -> DataFrame:
    found = navigation.profiles(_pages(s, d))
    text = navigation.portal_text(F.col("text"), F.col("tables"), F.col("cards"))
    return found.select("page_id", "title", F.md5(text).alias("text_md5"), T.word_count(text).cast("bigint").alias("words"), F.size("code_blocks").alias("code_blocks"), F.size("tables").alias("tables"))


@_query(f"WITH {_PAGE_TEXT}, a AS (SELECT t.page_id, body, {_plain('html')} AS whole FROM t JOIN pages p USING (page_id, url)), n AS (SELECT *, {_WORDS.format('whole')} > {_WORDS.format('body')} * 1.2::DOUBLE AS other FROM a) SELECT page_id, other, md5(CASE WHEN other THEN whole ELSE body END) AS text_md5 FROM n")
def text_preference(s: SparkSession, d: str) -> DataFrame:
    df = _pages(s, d).select("page_id", extract.main_text(F.col("html")).alias("body"), extract.plain(F.col("html")).alias("whole"))
    df = df.select("page_id", "body", F.explode(F.array(navigation.preferred_text(F.col("body"), F.col("whole")))).alias("text"))
    return df.select("page_id", (F.col("text") != F.col("body")).alias("other"), F.md5("text").alias("text_md5"))


@_query()
def report_document(s: SparkSession, d: str) -> DataFrame:
    return report.document_blocks(sections.rag_chunks(extract.parsed(_pages(s, d)))).select("doc_id", "block_no", "kind", "level", F.md5("text").alias("text_md5"))


@_query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), c AS (SELECT doc_id, list_filter(list_transform(string_split(line, '|'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS cells FROM l WHERE NOT regexp_matches(line, '^[-| +]*$'))
SELECT doc_id, count(*)::INT AS rows, max(len(cells))::INT AS columns, sum(len(cells))::BIGINT AS cells FROM c WHERE len(cells) > 0 GROUP BY doc_id""")
def report_table_rows(s: SparkSession, d: str) -> DataFrame:
    df = _docs(s, d).select("doc_id", F.explode(report.table_rows(F.col("text"))).alias("cells")).select("doc_id", F.size("cells").alias("n"))
    return df.groupBy("doc_id").agg(F.count("*").cast("int").alias("rows"), F.max("n").alias("columns"), F.sum("n").alias("cells"))


_BLOCK_TEXT = r"(?is)<(?:h1|p)\b[^>]*>(.*?)</(?:h1|p)\s*>"


@_query(rf"""WITH b AS (SELECT page_id, {_H1} AS h, regexp_extract_all(html, '{_BLOCK_TEXT}', 1) AS parts FROM pages), e AS (SELECT page_id, h, unnest(parts) AS part FROM b), q AS (SELECT page_id, h, {_plain('part')} AS p FROM e)
SELECT page_id, count(*) FILTER (p = h) AS headings, count(*) FILTER (p <> h) AS paragraphs, coalesce(sum(length(p)) FILTER (p <> h), 0)::BIGINT AS chars FROM q WHERE p <> '' GROUP BY page_id""")
def report_headings(s: SparkSession, d: str) -> DataFrame:
    text = F.array_join(F.transform(F.regexp_extract_all("html", F.lit(_BLOCK_TEXT), F.lit(1)), extract.plain), "\n\n")
    df = _pages(s, d).select("page_id", F.explode(report.headed_blocks(text, extract.headings(F.col("html")))).alias("b")).select("page_id", "b.*")
    head = F.col("kind") == "heading"
    return df.groupBy("page_id").agg(F.count_if(head).alias("headings"), F.count_if(~head).alias("paragraphs"), F.coalesce(F.sum(F.when(~head, F.length("text"))), F.lit(0)).alias("chars"))


@_query("SELECT doc_id, unnest(range(0, (least(length(text), 15000) + 1999) // 2000))::INT AS slice, md5(substr(substr(text, 1, 15000), unnest(range(0, (least(length(text), 15000) + 1999) // 2000)) * 2000 + 1, 2000)) AS slice_md5 FROM documents")
def report_slices(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", F.posexplode(report.slices(F.col("text"))).alias("slice", "part")).select("doc_id", "slice", F.md5("part").alias("slice_md5"))


@_query("""WITH a AS (SELECT user_id, event_id, value > 50 AS good, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
b AS (SELECT *, i - coalesce(max(CASE WHEN good THEN i END) OVER (PARTITION BY user_id ORDER BY i), 0) AS run FROM a),
c AS (SELECT *, count(*) FILTER (run >= 3) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stops FROM b)
SELECT user_id, count(*) AS attempted, count(*) FILTER (good) AS meaningful_clicks, count(*) FILTER (NOT good) AS wasted_clicks, max(run) >= 3 AS stopped_early, count(*) >= 50 AS hit_limit FROM c WHERE stops = 0 AND i <= 50 GROUP BY user_id""")
def expansion_counters(s: SparkSession, d: str) -> DataFrame:
    """Events as clicks; one with a value above 50 brought something."""
    return metrics.expansion(table(s, d, "events"), "user_id", ["ts", "event_id"], F.col("value") > 50, most_wasted=3)


# ---- Streams and exports


@_query(_SQL["token_bucket_waits"])
def stream_token_bucket(s: SparkSession, d: str) -> DataFrame:
    return runs.finished(runs.token_bucket(runs.events(s, f"{d}/events.parquet"), "user_id", 1 / 3600), "append")


@_query("""WITH w AS (SELECT unnest([0, 10, 20]) AS back, epoch_us(ts) // 10000000 * 10 AS slot FROM events)
SELECT make_timestamp((slot - back) * 1000000) AS window_start, count(*) AS events, count(*) / 30.0::DOUBLE AS rate FROM w GROUP BY 1""")
def stream_rolling_rate(s: SparkSession, d: str) -> DataFrame:
    out = runs.finished(runs.rolling_counts(runs.events(s, f"{d}/events.parquet")), "complete")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "events", "rate")


@_query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(s: SparkSession, d: str) -> DataFrame:
    return runs.finished(runs.first_seen(runs.events(s, f"{d}/events.parquet"), ["user_id", "event_type"]), "append")


def _round_trip(df: DataFrame, kind: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/export-{uuid.uuid4().hex}"
    if kind == "jsonl":
        files.write_jsonl(df, path)
        return df.sparkSession.read.schema(df.schema).json(path)
    files.write_csv(df, path)
    return df.sparkSession.read.schema(df.schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


@_query("SELECT doc_id, lang, source, md5(text) AS text_md5 FROM documents")
def export_jsonl_roundtrip(s: SparkSession, d: str) -> DataFrame:
    return _round_trip(_docs(s, d), "jsonl").select("doc_id", "lang", "source", F.md5("text").alias("text_md5"))


@_query("SELECT doc_id, lang, source, md5(text) AS text_md5 FROM documents")
def export_csv_roundtrip(s: SparkSession, d: str) -> DataFrame:
    return _round_trip(_docs(s, d), "csv").select("doc_id", "lang", "source", F.md5("text").alias("text_md5"))


@_query()
def export_corpus_json(s: SparkSession, d: str) -> DataFrame:
    return files.corpus_json(chunking.chunks(_docs(s, d).select("doc_id", "text"), "text"))


@_query(_chunk_sql("text").replace("WITH RECURSIVE ", f"WITH RECURSIVE {_PAGE_TEXT}, {_PARTS}, documents AS (SELECT page_id AS doc_id, body AS text FROM t), ", 1) + f", h AS (SELECT lower(netloc) AS host, {_WORDS.format('content')} AS n FROM c JOIN u ON u.page_id = c.doc_id) SELECT host, count(*) AS chunks, sum(n)::BIGINT AS words, sum(n * 13 // 10)::BIGINT AS tokens FROM h GROUP BY host")
def host_chunks(s: SparkSession, d: str) -> DataFrame:
    """Pages of any length to chunks to words and tokens a host."""
    df = chunking.chunks(_page_text(s, d).select(U.domain(F.col("url")).alias("host"), "body"), "body").select("host", T.word_count(F.col("content")).cast("bigint").alias("n"))
    return df.groupBy("host").agg(F.count("*").alias("chunks"), F.sum("n").alias("words"), F.sum(T.token_estimate(F.col("n")).cast("bigint")).alias("tokens"))


from . import crawls  # noqa: E402,F401  (registers its queries)
