"""Registered queries of content choice, classifiers, run records and exports. Where the tables have no case of something, rows that do are added, in the query and in its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import classify, content, extract, gates, graph, metrics, scope, sections
from ..sources import files
from ..sources.tables import table
from .queries import _H1, _LINKS, _PAGE_TEXT, _PARTS, _RANKED, _TEXT, _WORDS, _edges, _page_text, _pages, _query, _ranked


def _sql_rows(rows: list[tuple]) -> str:
    code = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(code, r)) + ")" for r in rows)


_PORTAL, _TOPIC = '<div class="x sapUiBody">', "<script src='/a/fluidtopics.js'></script>"
_SITES = [
    (-1, "https://me.sap.com/home", _PORTAL, True, False, False, "sap"), (-2, "https://HELP.sap.com/docs", "<p>sapUiBody</p>", False, False, True, "sap"), (-3, "https://d.org/irj/portal?x", _TOPIC, False, True, False, "sap"),
    (-4, "https://d.org/a", '<script src="/r/sap-ui-core.js">', True, False, False, None), (-5, "https://d.org/b", '<body class="a FT-version-9">', False, True, False, None), (-6, "https://d.org/sapx", '<i class="mysapUiBody">', False, False, False, None),
]


@_query(f"SELECT page_id, false AS portal, false AS topic, false AS help, CAST(NULL AS VARCHAR) AS login FROM pages UNION ALL SELECT a, c, d, e, f FROM (VALUES {_sql_rows([(r[0], *r[3:]) for r in _SITES])}) v(a, c, d, e, f)")
def site_flags(s: SparkSession, d: str) -> DataFrame:
    df = _pages(s, d).select("page_id", "url", "html").union(s.createDataFrame([r[:3] for r in _SITES], "page_id bigint, url string, html string"))
    return df.select("page_id", classify.portal_page(F.col("html")).alias("portal"), classify.topic_site(F.col("html")).alias("topic"), classify.help_site(F.col("url")).alias("help"), classify.login_portal(F.col("url")).alias("login"))


@_query(f"SELECT page_id, CASE WHEN length({_TEXT}) >= 200 THEN 'main' ELSE 'other' END AS text_from, md5(CASE WHEN length({_TEXT}) >= 200 THEN {_TEXT} ELSE '' END) AS text_md5 FROM pages")
def content_choice(s: SparkSession, d: str) -> DataFrame:
    """Pages whose article is long enough; shorter ones go to the density rule or the body, which are tested on fixtures."""
    df = content.contents(_pages(s, d))
    main = F.col("text_from") == "main"
    return df.select("page_id", F.when(main, "main").otherwise("other").alias("text_from"), F.md5(F.when(main, F.col("text")).otherwise("")).alias("text_md5"))


@_query()
def content_engines(s: SparkSession, d: str) -> DataFrame:
    return content.contents(_pages(s, d)).select("page_id", F.md5("engine_text").alias("engine_md5"), F.md5("engine_whole").alias("whole_md5"), F.md5("first_text").alias("first_md5"), "anchors")


@_query(f"""WITH {_PARTS}, {_LINKS}, o AS (SELECT page_id, u.scheme || '://' || netloc || href AS dst, min(pos) AS pos FROM k JOIN u USING (page_id, url) GROUP BY ALL)
SELECT page_id, dst, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS pos, true AS internal FROM o""")
def page_standard_links(s: SparkSession, d: str) -> DataFrame:
    return extract.standard_links(_pages(s, d)).select("page_id", "dst", F.col("pos").cast("bigint").alias("pos"), "internal")


@_query(f"""WITH {_PARTS}, {_LINKS}, r AS (SELECT page_id, CASE WHEN starts_with(href, '/a') AND NOT (href = '/a' OR starts_with(href, '/a/')) THEN 'scope' WHEN pos > min(pos) OVER (PARTITION BY page_id, dst) THEN 'dedup' ELSE 'accepted' END AS r FROM k)
SELECT page_id, 0 AS external, 0 AS nonhttp, 0 AS normalize, 0 AS junk, count(*) FILTER (r = 'scope') AS scope, count(*) FILTER (r = 'dedup') AS dedup, count(*) FILTER (r = 'accepted') AS accepted FROM r GROUP BY page_id""")
def page_link_rejections(s: SparkSession, d: str) -> DataFrame:
    links = extract.links(_pages(s, d))
    accepted = scope.in_scope(F.col("dst"), F.concat(U.origin(F.col("url")), F.lit("/a"))) | ~U.path(F.col("dst")).startswith("/a")
    return extract.rejections(links, accepted, gates.junk_url(F.col("dst"), gates.JUNK_PATTERNS_SYNC))


@_query(f"""WITH {_PARTS} SELECT page_id, path = '/en' OR starts_with(path, '/en/') AS in_scope, regexp_matches(lower(netloc), '(^|\\.)example\\.org$') AS internal, CASE WHEN page_id % 3 = 0 THEN 'js' ELSE 'static' END AS route FROM u""")
def url_scope_rules(s: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    route = classify.route(F.col("page_id") % 6 == 0, F.col("page_id") % 6 == 3)
    return _pages(s, d).select("page_id", classify.plain_scope(url, F.concat(U.origin(url), F.lit("/en/index.html"))).alias("in_scope"), classify.internal_link(url, F.lit("http://www.example.org/x")).alias("internal"), route.alias("route"))


# ---- the ladder of texts, over documents: each has a short text, and others by its number

_N = _WORDS.format("text")


@_query(f"""WITH t AS (SELECT doc_id, text, {_N} AS n, CASE doc_id % 5 WHEN 0 THEN 5 WHEN 1 THEN 25 WHEN 2 THEN 25 WHEN 3 THEN 400 ELSE 25 END AS cut FROM documents),
c AS (SELECT doc_id, n, least(cut, n) AS now, doc_id % 5 AS k FROM t),
a AS (SELECT *, CASE WHEN k = 0 AND now < 20 AND n > now AND n >= 20 THEN 'shadow' ELSE 'dom' END AS s1 FROM c),
b AS (SELECT *, CASE WHEN s1 = 'shadow' THEN n ELSE now END AS n1 FROM a),
e AS (SELECT *, CASE WHEN k = 1 AND ((n1 < 20 AND n >= 20) OR n >= 3 * greatest(n1, 1)) THEN 'api' ELSE s1 END AS s2 FROM b),
f AS (SELECT *, CASE WHEN s2 = 'api' THEN n ELSE n1 END AS n2 FROM e),
g AS (SELECT *, CASE WHEN k = 2 AND n2 < 300 AND n >= 20 AND n > n2 THEN 'topic' ELSE s2 END AS s3 FROM f),
h AS (SELECT *, CASE WHEN s3 = 'topic' THEN n ELSE n2 END AS n3 FROM g)
SELECT doc_id, CASE WHEN k IN (3, 4) AND (n3 < 20 OR (n3 > 0 AND n >= 50 AND n3 < 0.35 * n)) AND n > n3 AND n >= 20 THEN 'whole' ELSE s3 END AS source FROM h""")
def fallback_ladder(s: SparkSession, d: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    k = F.col("doc_id") % 5
    cut = F.when(k == 0, 5).when(k == 3, 400).otherwise(25)
    df = table(s, d, "documents").select("doc_id", text.alias("text"), F.array_join(F.slice(T.words(text), F.lit(1), cut), " ").alias("short"))
    only = lambda *n: F.when(k.isin(*n), F.col("text"))
    return df.select("doc_id", content.ladder(F.col("short"), only(0), only(1), only(2), only(3, 4))["source"].alias("source"))


@_query("SELECT event_id, CASE WHEN json_valid(props) AND regexp_matches(props, '(?s)^(\\{.*\\}|\\[.*\\])$') THEN 1 ELSE 2 END AS kept FROM events")
def code_block_filter(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", F.size(content.without_json(F.array("props", F.lit("{ no json }")))).alias("kept"))


@_query(f"""WITH {_PARTS} SELECT page_id, 4 AS links, scheme || '://' || netloc || '/r/' || page_id AS topic FROM u""")
def link_supplements(s: SparkSession, d: str) -> DataFrame:
    """Links of the page, of shadow roots (few links), of topics and of portals, each once."""
    url = F.col("url")
    topic = content.topic_links(F.concat(U.origin(url), F.lit("/")), F.concat(F.lit("r/"), F.col("page_id").cast("string")))
    own = F.array(F.lit("a"), F.lit("b"))
    links = content.supplemented(own, (F.size(own) < 3, F.array(F.lit("b"), F.lit("c"))), (F.lit(True), F.array(topic, F.lit("a"))), (F.lit(False), F.array(F.lit("z"))))
    return _pages(s, d).select("page_id", F.size(links).alias("links"), F.element_at(links, -1).alias("topic"))


@_query("""WITH r AS (SELECT user_id AS page, event_id, event_type = 'error' AS bad, length(props) AS n, props FROM events)
SELECT page, arg_max(md5(props), (n, '/api/' || lpad(event_id::VARCHAR, 12, '0'))) AS body_md5 FROM r WHERE NOT bad GROUP BY page""")
def largest_api_response(s: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", 500).otherwise(200)
    rows = table(s, d, "events").select(F.col("user_id").alias("page"), F.concat(F.lit("/api/"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("url"), status.alias("status"), F.lit("text/html").alias("content_type"), F.col("props").alias("body"))
    return content.largest_response(rows, "page").select("page", F.md5("body").alias("body_md5"))


@_query(f"WITH {_PARTS}, t AS (SELECT path, min(page_id) AS id FROM u WHERE page_id % 2 = 0 GROUP BY path) SELECT u.page_id, t.id::VARCHAR AS content_id FROM u LEFT JOIN t USING (path)")
def topic_lookup(s: SparkSession, d: str) -> DataFrame:
    path = U.path(F.col("url"))
    topics = _pages(s, d).where("page_id % 2 = 0").groupBy(path.alias("pretty_url")).agg(F.min("page_id").cast("string").alias("content_id")).select("pretty_url", F.lit("m").alias("map_id"), "content_id", F.lit("x" * 101).alias("content"))
    pages = _pages(s, d).select("page_id", F.concat(U.origin(F.col("url")), F.when(F.col("page_id") % 3 == 0, "/docs").otherwise(""), path).alias("url"))
    return content.topic_content(pages, topics, U.path(F.col("url"))).select("page_id", "content_id")


# ---- run records, from events

_RUN = """t AS (SELECT event_id, ts, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'view' THEN 'skipped' ELSE 'ok' END AS status, round(value * 10, 2) AS total_ms, round(value, 2) - 40 AS navigate_ms,
  round(value / 2, 2) AS extract_ms, event_id % 700 AS words, event_id % 30 AS links, event_id % 9000 AS bytes, event_id % 211 AS queued, (event_id % 50 = 0)::INT AS retries, event_id % 3 AS enqueued FROM events)"""
_TOTALS = """a AS (SELECT count(*) FILTER (status = 'ok') AS pages_crawled, count(*) FILTER (status = 'skipped') AS pages_skipped, count(*) FILTER (status = 'failed') AS pages_failed, sum(retries)::BIGINT AS pages_retried, sum(enqueued)::BIGINT AS total_enqueued,
  coalesce(sum(words) FILTER (status = 'ok'), 0)::BIGINT AS total_words, sum(links)::BIGINT AS total_links, sum(bytes)::BIGINT AS total_bytes, max(queued) AS queue_peak, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::DOUBLE AS elapsed_sec FROM t)"""


def _run(s: SparkSession, d: str) -> DataFrame:
    e, n = F.col("event_type"), F.col("event_id")
    status = F.when(e == "error", "failed").when(e == "view", "skipped").otherwise("ok")
    value = F.col("value").cast("double")
    return table(s, d, "events").select(
        "event_id", "ts", status.alias("status"), F.round(value * 10, 2).alias("total_ms"), (F.round(value, 2) - 40).alias("navigate_ms"), F.round(value / 2, 2).alias("extract_ms"),
        (n % 700).alias("words"), (n % 30).alias("links"), (n % 9000).alias("bytes"), (n % 211).alias("queued"), (n % 50 == 0).cast("int").alias("retries"), (n % 3).alias("enqueued"),
    )


@_query(f"WITH {_RUN}, {_TOTALS} SELECT pages_crawled, pages_skipped, pages_failed, pages_retried, total_enqueued, total_words, total_links, total_bytes, queue_peak, round(elapsed_sec, 3) AS elapsed_sec, round(pages_crawled / elapsed_sec, 4) AS pages_per_sec_overall FROM a")
def run_totals(s: SparkSession, d: str) -> DataFrame:
    out = metrics.totals(_run(s, d))
    return out.select("pages_crawled", "pages_skipped", "pages_failed", "pages_retried", "total_enqueued", "total_words", "total_links", "total_bytes", "queue_peak", F.round("elapsed_sec", 3).alias("elapsed_sec"), "pages_per_sec_overall")


@_query(f"""WITH {_RUN} SELECT round(avg(total_ms) FILTER (total_ms > 0), 2) AS avg_page_ms, round(avg(navigate_ms) FILTER (navigate_ms > 0), 2) AS avg_navigate_ms, round(avg(extract_ms) FILTER (extract_ms > 0), 2) AS avg_extract_ms,
  round((sum(words) FILTER (status = 'ok')) / (count(*) FILTER (status = 'ok')), 2) AS avg_words_per_page FROM t""")
def run_averages(s: SparkSession, d: str) -> DataFrame:
    return metrics.totals(_run(s, d)).select(*(F.round(c, 2).alias(c) for c in ("avg_page_ms", "avg_navigate_ms", "avg_extract_ms", "avg_words_per_page")))


@_query(f"""WITH {_RUN}, {_TOTALS}, r AS (SELECT round(count(*) / 30.0, 4)::DOUBLE AS rolling FROM t WHERE epoch_us(ts) >= (SELECT max(epoch_us(ts)) FROM t) - 30000000),
v AS (SELECT list(total_ms ORDER BY total_ms) AS v FROM (SELECT total_ms FROM t ORDER BY ts DESC, event_id DESC LIMIT 1000))
SELECT rolling AS pages_per_sec_rolling, v[least(floor(len(v) * 0.95)::INT, len(v) - 1) + 1] AS p95_page_ms, 6 AS workers,
  'Queue exhausted — only ' || pages_crawled || ' useful pages found on this site (skipped ' || pages_skipped || ', requested 100000000)' AS stop_reason FROM a, r, v""")
def run_record(s: SparkSession, d: str) -> DataFrame:
    return metrics.run_record(_run(s, d), 100_000_000, "all").select("pages_per_sec_rolling", "p95_page_ms", "workers", "stop_reason")


@_query("""WITH t AS (SELECT user_id, event_id, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
m AS (SELECT *, coalesce(bool_or(ok) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS done FROM t)
SELECT user_id, count(*) AS attempts, bool_or(ok) AS ok FROM m WHERE NOT done AND i <= 3 GROUP BY user_id""")
def retry_attempts(s: SparkSession, d: str) -> DataFrame:
    tries = table(s, d, "events").select("user_id", F.col("event_id").alias("attempt"), (F.col("event_type") != "error").alias("ok"))
    return metrics.attempts(tries, "user_id")


@_query("""SELECT event_id, CASE WHEN value > 0 THEN least(2.0, 1 / value) ELSE 2.0 END::DOUBLE AS rate, event_id % 4 > 0 AND value <= 8 AND event_id % 5 <= 3 AS valid,
  CASE WHEN event_id % 7 = 0 THEN 'failed' WHEN event_id % 3 = 1 THEN 'skipped' ELSE 'ok' END AS status, event_id % 2 = 0 AS blocked,
  event_id % 100 >= 80 OR event_id % 3 = 0 AS changed, event_id % 3 > 0 OR event_id % 300 > 200 AS expanded FROM events""")
def fetch_rules(s: SparkSession, d: str) -> DataFrame:
    """Pacing, saved sessions, load status, blocked requests and click outcomes, with events as their inputs."""
    n, value = F.col("event_id"), F.col("value").cast("double")
    kind = F.element_at(F.array(F.lit("text/html; charset=utf-8"), F.lit("application/pdf"), F.lit(None).cast("string")), (n % 3 + 1).cast("int"))
    request = F.when(n % 2 == 0, "https://www.google-analytics.com/a.js").otherwise("https://h/a.js")
    zero = F.lit(0)
    after = F.struct((n % 100).alias("text"), (n % 3 == 0).cast("int").alias("links"), zero.alias("headings"), zero.alias("expanded"))
    return table(s, d, "events").select(
        "event_id", metrics.paced(2.0, value).alias("rate"), classify.session_valid(n % 4, value, n % 5).alias("valid"), gates.load_status(F.when(n % 7 == 0, 404).otherwise(200), kind).alias("status"),
        gates.blocked_request(F.lit("script"), request).alias("blocked"), gates.meaningful_change(F.struct(*(zero.alias(c) for c in ("text", "links", "headings", "expanded"))), after).alias("changed"), gates.bulk_expanded(n % 3, n % 300, zero).alias("expanded"),
    )


@_query(f"WITH {_PARTS}, {_PAGE_TEXT}, w AS (SELECT url, {_WORDS.format('body')} AS n FROM t) SELECT count(DISTINCT url) AS unique_urls, sum(n)::BIGINT AS total_words, round(avg(n), 4) AS avg_words FROM w")
def url_summary(s: SparkSession, d: str) -> DataFrame:
    return metrics.url_summary(_page_text(s, d).select("url", T.word_count(F.col("body")).alias("n")), "url", "n")


@_query(f"SELECT page_id, CASE WHEN {_H1} = '' THEN 0 ELSE 1 END AS headings FROM pages")
def heading_counts(s: SparkSession, d: str) -> DataFrame:
    return _pages(s, d).select("page_id", metrics.heading_count(extract.headings(F.col("html"))).alias("headings"))


@_query("WITH o AS (SELECT min(url) AS url FROM pages) SELECT page_id, md5(html) AS html_md5 FROM pages JOIN o USING (url)")
def page_lookup(s: SparkSession, d: str) -> DataFrame:
    first = _pages(s, d).agg(F.min("url")).first()[0]  # a single value
    return files.page(_pages(s, d), first).select("page_id", F.md5("html").alias("html_md5"))


# ---- traversal


@_query(f"""WITH RECURSIVE {_RANKED}, e AS (SELECT host || '#' || i AS node, host, i FROM k), h AS (SELECT host, row_number() OVER (ORDER BY host || '#1') - 1 AS place FROM (SELECT DISTINCT host FROM k)),
o AS (SELECT node, floor(log2(i))::INT AS depth, host, i, i % 3 = 0 AS skipped, row_number() OVER (ORDER BY floor(log2(i)), place, i) - 1 AS disc_order FROM e JOIN h USING (host)),
g AS (SELECT *, count(*) FILTER (NOT skipped) OVER (ORDER BY disc_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS good FROM o) SELECT node, depth, skipped FROM g WHERE good < 100""")
def crawl_pages(s: SparkSession, d: str) -> DataFrame:
    edges, seeds = _edges(s, d)
    skipped = _ranked(s, d).where("i % 3 = 0").select(F.concat("host", F.lit("#"), F.col("i").cast("string")).alias("node"))
    return graph.crawl(edges, seeds, 24, 100, skipped).select("node", "depth", "skipped")


@_query()
def queue_walk(s: SparkSession, d: str) -> DataFrame:
    edges, _ = _edges(s, d)
    return graph.queue_walk(edges, "host", 24, 50, 10).select("host", "node", "depth", "visit")


@_query(f"WITH {_PARTS}, x AS (SELECT page_id, list_filter(string_split(path, '/'), lambda p: p <> '') AS parts FROM u) SELECT array_to_string(parts[1:n], ' > ') AS path, n::INT AS level, page_id FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS n FROM x)")
def hierarchy_pages(s: SparkSession, d: str) -> DataFrame:
    parts = F.filter(F.split(U.path(F.col("url")), "/"), lambda x: x != "")
    return graph.hierarchy_pages(_pages(s, d).select("page_id", parts.alias("parts")), F.col("parts"), "page_id").withColumnRenamed("url", "page_id")


# ---- exports


def _records(s: SparkSession, d: str) -> DataFrame:
    html, url = F.col("html"), F.col("url")
    none = F.array().cast("array<string>")
    return _pages(s, d).select("page_id", "url", extract.title(html).alias("title"), extract.meta_description(html).alias("meta_description"), extract.headings(html).alias("headings"), extract.main_text(html).alias("text_content"), F.array(url).alias("internal_links"), none.alias("external_links"), none.alias("images"), none.alias("tables"), none.alias("code_blocks"), F.array(F.lit("a"), F.lit("b")).alias("breadcrumb"), none.alias("section_path"), F.lit(2).alias("depth"))


_CSV = f"""WITH {_PAGE_TEXT} SELECT t.url, t.title, '' AS meta_description, {_H1} AS h1, '' AS h2, '' AS h3, '' AS h4, '' AS h5, '' AS h6, substr(body, 1, 10000) AS text_content, 1::BIGINT AS internal_links_count, t.url AS internal_links,
  0::BIGINT AS external_links_count, 0::BIGINT AS images_count, 200 AS status_code, '' AS content_type, {_WORDS.format('body')}::BIGINT AS word_count, 0 AS crawl_depth, '' AS error FROM t JOIN pages p USING (page_id, url)"""


@_query(_CSV)
def export_standard_rows(s: SparkSession, d: str) -> DataFrame:
    return files.standard_rows(_records(s, d))


@_query(f"""WITH {_PAGE_TEXT} SELECT t.url, t.title, 'a > b' AS breadcrumb, '' AS section_path, {_H1} AS h1, '' AS h2, '' AS h3, substr(body, 1, 15000) AS text_content, 0::BIGINT AS tables_count, 0::BIGINT AS code_blocks_count, 1::BIGINT AS internal_links_count,
  2 AS depth, {_WORDS.format('body')}::BIGINT AS word_count FROM t JOIN pages p USING (page_id, url)""")
def export_deep_rows(s: SparkSession, d: str) -> DataFrame:
    return files.deep_rows(_records(s, d))


def _export(s: SparkSession, d: str, kind: str) -> DataFrame:
    pages = _records(s, d).select("url", "title")
    errors = _pages(s, d).where("page_id % 10 = 0").select("url", F.lit("timeout").alias("error"), F.lit(1).alias("depth"))
    stats = pages.agg(F.count("*").alias("pages_crawled"))
    sections_of = graph.hierarchy(_pages(s, d).select("url", F.array(U.domain(F.col("url"))).alias("p")), F.col("p"), "url").select("path", "pages")
    return files.crawl_export(pages, errors, stats, kind, {"max_pages": "9"}, {"domain": "x"} if kind == "standard" else None, "now" if kind == "standard" else None, sections_of)


@_query("""SELECT 'head' AS part, '{"metadata":{"total_pages":' || count(*) || ',"crawl_stats":{"pages_crawled":' || count(*) || '},"config":{"max_pages":"9"},"scope_info":{"domain":"x"},"errors_count":' || count(*) FILTER (page_id % 10 = 0) || ',"exported_at":"now"}}' AS json FROM pages
UNION ALL SELECT 'errors', '{"url":"' || url || '","error":"timeout","depth":1}' FROM pages WHERE page_id % 10 = 0 UNION ALL SELECT 'pages', count(*)::VARCHAR FROM pages""")
def export_standard_json(s: SparkSession, d: str) -> DataFrame:
    """The head and errors as they are, and the number of pages' lines."""
    out = _export(s, d, "standard")
    return out.where("part <> 'pages'").union(out.where("part = 'pages'").groupBy("part").agg(F.count("*").cast("string")))


@_query("""SELECT 'head' AS part, '{"stats":{"pages_crawled":' || count(*) || '}}' AS json FROM pages UNION ALL SELECT 'errors', count(*)::VARCHAR FROM pages WHERE page_id % 10 = 0 UNION ALL SELECT 'pages', count(*)::VARCHAR FROM pages
UNION ALL SELECT 'hierarchy', '{"path":"' || host || '","pages":' || n || '}' FROM (SELECT lower(regexp_extract(url, '^[^:]*://([^/?#]*)', 1)) AS host, count(*) AS n FROM pages GROUP BY 1)""")
def export_deep_json(s: SparkSession, d: str) -> DataFrame:
    out = _export(s, d, "deep")
    counted = F.col("part").isin("pages", "errors")
    return out.where(~counted).union(out.where(counted).groupBy("part").agg(F.count("*").cast("string")))


@_query()
def export_corpus_head(s: SparkSession, d: str) -> DataFrame:
    return files.corpus_head(sections.rag_chunks(extract.parsed(_pages(s, d))), {"max_pages": "9"})


# ---- cases that the tables do not hold

_MARKUP = [
    (-1, '<meta name="description" content="A &amp; b"><h1>One</h1><h2>x</h2><h2>y <b>z</b></h2>', "A & b", "One", "x|y z"), (-2, '<meta property="og:description" content="og"><meta name="twitter:description" content="tw">', "og", "", ""),
    (-3, '<meta name="twitter:description" content=" t  w "><h2></h2>', "t w", "", ""), (-4, None, "", "", ""),
]


@_query(f"SELECT page_id, '' AS description, {_H1} AS h1, '' AS h2 FROM pages UNION ALL SELECT * FROM (VALUES {_sql_rows([(r[0], *r[2:]) for r in _MARKUP])}) v(a, b, c, d)")
def page_meta_headings(s: SparkSession, d: str) -> DataFrame:
    df = _pages(s, d).select("page_id", "html").union(s.createDataFrame([r[:2] for r in _MARKUP], "page_id bigint, html string"))
    html = F.col("html")
    level = lambda h: F.coalesce(F.array_join(F.element_at(extract.headings(html), F.lit(h)), "|"), F.lit(""))
    return df.select("page_id", extract.meta_description(F.coalesce(html, F.lit(""))).alias("description"), level("h1").alias("h1"), level("h2").alias("h2"))


_FILLER = "word " * 120
_SCRIPTED = [
    (-1, "<body></body>", True), (-2, f'<body><div id="app"> </div>{_FILLER}</body>', True), (-3, f"<body><noscript>Please enable JavaScript</noscript>{_FILLER}</body>", True), (-4, "<body>" + "<script src=a.js></script>" * 16 + "x" * 300 + "</body>", True),
    (-5, '<body><script src="react.js"></script><script src="webpack.js"></script>' + "x" * 300 + "</body>", True), (-6, '<body><script type="application/ld+json">{}</script>' + "x" * 250 + "</body>", True), (-7, f"<body>{_FILLER}</body>", False),
]


@_query(f"SELECT * FROM (VALUES {_sql_rows([(r[0], r[2]) for r in _SCRIPTED])}) v(case_id, js_required)")
def js_required_rules(s: SparkSession, d: str) -> DataFrame:
    """One page for each rule of `js_required`, which the tables hardly hold."""
    return s.createDataFrame([r[:2] for r in _SCRIPTED], "case_id int, html string").select("case_id", gates.js_required(F.col("html")).alias("js_required"))


_PHRASES = [*T.VENDOR_PHRASES, *T.PORTAL_PHRASES]


@_query(f"SELECT * FROM (VALUES {_sql_rows([(i, "a Manage  b" if p == "Manage Cookie Preferences" else "a  b") for i, p in enumerate(_PHRASES)])}) v(case_id, cleaned)")
def boilerplate_each(s: SparkSession, d: str) -> DataFrame:
    """Each phrase goes from a text that holds it alone; a phrase that ends with an earlier one loses that one first."""
    return s.createDataFrame([(i, f"a {p} b\nON") for i, p in enumerate(_PHRASES)], "case_id int, text string").select("case_id", T.without_phrases(F.col("text"), _PHRASES).alias("cleaned"))

