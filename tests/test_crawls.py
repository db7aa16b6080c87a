"""Content choice, the ladder of fallbacks, classifiers, traversal with limits, exports, on literal cases and against plain Python."""

import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from siftspark.functions import text as T
from siftspark.operators import classify, content, dom, extract, graph, metrics, robots, scope, sections
from siftspark.plans.crawls import content_choice
from siftspark.plans.queries import oracle_sql
from siftspark.sources import files
from siftspark.streaming import runs


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


def words(n, name="w"):
    return " ".join(f"{name}{i}" for i in range(n))


LONG = words(60)


@pytest.mark.parametrize(("page", "how", "text"), [
    (f"<nav>{LONG}</nav><main><p>{LONG}</p></main>", "main", LONG), (f"<main>short</main><article>{LONG}</article>", "main", LONG), (f"<div role=main>{LONG}</div>", "main", LONG),
    (f'<div id="content">short</div><div class="x content">{LONG}</div>', "main", LONG), (f'<div class="a wrapper">{LONG}</div>', "main", LONG),
    (f'<section class="text-body-2"><b>{LONG}</b></section>', "main", LONG), (f'<div class="sidebar-content">{LONG}</div><section>{LONG} <p>x</section>', "density", f"{LONG} x"),
    (f"<div>{words(70, 'v')}</div><div><p>{LONG}<p>a<p>b</div>", "density", f"{LONG} a b"), ("<p>little", "body", "little"), (None, "body", ""), (f"<div class=menu>{LONG}</div>", "body", LONG),
])
def test_standard_choice(page, how, text):
    assert content.standard_text(dom.tree(page)) == (text, how)


@pytest.mark.parametrize(("markup", "text"), [
    ("a&amp", "a&amp"), ("a&amp;&amp", "a&&amp"), ("&amp&amp;", "&amp&"), ("&ampx; &notit; &x;", "&ampx; &notit; &x;"), ("&#38 &#x26 &#38; &#x26;", "&#38 &#x26 & &"), ("&eacute;&eacute &am &quo &", "é&eacute &am &quo &"),
    ("&amp;amp; &amp;lt;", "&amp; &lt;"), ("&amp<b>;</b>", "&amp ;"),
])
def test_references_end_with_a_semicolon(markup, text):
    assert content.standard_text(dom.tree(f"<main>{LONG}<p>{markup}</p></main>")) == (f"{LONG} {text}", "main")
    assert dom.tree(f"<p>{markup}").text() == text.replace(" ;", ";")


def test_references_in_attributes_and_scripts():
    link, script = dom.tree('<a href="/x?a=1&copy=2&amp;b=3">l</a><script>a &amp; b && c &copy</script>').items
    assert link.attrs["href"] == "/x?a=1&copy=2&b=3" and script.items == ["a &amp; b && c &copy"]


def test_content_choice_of_cut_references(spark, tmp_path):
    """Titles that were cut inside a reference, as some of the tables' are; at 200 characters each of them counts."""
    page = lambda text: f"<html><head><title>x</title></head><body><nav>{LONG}</nav><article><h1>{text}</h1><p>{LONG}</p></article><footer>&copy;</footer></body></html>"
    exact = lambda text, n: f"<body><article><h1>{text}</h1><p>{'x' * (n - 1 - len(text.replace('&amp;', '&')))}</p></article></body>"
    pages = [page("und&amp;&amp;&amp; ver&amp"), page("a&am"), page("a&quot"), page("a&quot;&amp;"), *(exact(t, n) for t in ("a&amp", "a&amp;") for n in (199, 200)), None]
    spark.createDataFrame(list(enumerate(pages)), "page_id bigint, html string").selectExpr("page_id", "'http://h/' || page_id AS url", "html").write.parquet(f"{tmp_path}/pages.parquet")
    got = content_choice(spark, str(tmp_path)).orderBy("page_id").collect()
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        want = con.execute(f"SELECT page_id, text_from, text_md5 FROM ({oracle_sql()['content_choice']}) ORDER BY page_id").fetchall()
    assert list(map(tuple, got)) == want and [w[1] for w in want[4:]] == ["other", "main"] * 2 + ["other"]


def test_standard_choice_is_cut():
    assert content.standard_text(dom.tree(f"<main>{LONG}</main>"), 10) == (LONG[:10] + "...", "main")


def test_engine_choice():
    few, some, ample = words(5), words(40), words(150)
    pick = lambda page: content.engine_texts(dom.tree(page))
    assert pick(f"<main>{few}</main><div id=content>{ample}</div>") == (ample, ample, few)
    assert pick(f"<main>{few}</main><article>{some}</article>")[0] == some
    assert pick(f"<main>{few}</main><p>{few}")[0] == f"{few} {few}"
    assert pick(f'<main>{ample}<nav>n</nav><div class="toc">t</div><div class="my-feedback-widget-2">f</div></main>') == (ample, f"{ample} n t f", f"{ample} n t f")


def test_contents(spark):
    pages = spark.createDataFrame([(1, "u", f"<main>{LONG}<a href=x>a</a></main>"), (2, "v", None)], "page_id bigint, url string, html string")
    got = {r["page_id"]: r for r in content.contents(pages).collect()}
    assert got[1]["text"] == f"{LONG} a" and got[1]["anchors"] == 1 and got[2]["text"] == ""
    assert spark.range(1).select(content.poorly_parsed(F.lit(201), F.lit(0))).first()[0]


def test_ladder(spark):
    cases = [  # dom, shadow, api, topic, whole
        ((30, 50, 50, 0, 40), "dom"), ((5, 30, 0, 0, 0), "shadow"), ((5, 10, 30, 0, 0), "api"), ((30, 0, 90, 0, 0), "api"), ((30, 0, 89, 0, 0), "dom"), ((30, 0, 0, 31, 0), "topic"), ((300, 0, 0, 500, 0), "dom"),
        ((30, 0, 0, 0, 90), "whole"), ((30, 0, 0, 0, 85), "dom"), ((0, 0, 0, 0, 20), "whole"), ((0, 0, 0, 0, 19), "dom"), ((None,) * 5, "dom"),
    ]
    df = spark.createDataFrame([(i, *(n if n is None else words(n) for n in ns)) for i, (ns, _) in enumerate(cases)], "i int, d string, s string, a string, t string, w string")
    got = df.select("i", content.ladder(*(F.col(c) for c in "dsatw")).alias("r")).orderBy("i").collect()
    assert [r["r"]["source"] for r in got] == [want for _, want in cases] and got[-1]["r"]["text"] == ""


def test_enriched(spark):
    df = spark.sql("select 'u' url, 'u' title, map('h1', array('a'), 'h2', array('b')) h, array() t, 'T' title2, map('h2', array('c')) h2, array('x') t2")
    got = df.select(content.enriched(F.col("title"), F.col("url"), F.col("h"), F.col("t").cast("array<string>"), F.col("title2"), F.col("h2"), F.col("t2")).alias("e")).first()["e"]
    assert (got["title"], got["headings"], got["tables"]) == ("T", {"h1": ["a"], "h2": ["c"]}, ["x"])
    assert spark.range(1).select(content.longest(F.array(F.lit("a"), F.lit("bb"), F.lit("cc")))).first()[0] == "bb"
    fall = one(spark, words(9), lambda v: content.static_fallback(v, 5))
    assert (fall["text"], fall["word_count"]) == ("w0 w1", 9)
    assert one(spark, "", lambda v: content.without_json(F.array(F.lit('{"a": 1}'), F.lit("{a}"), F.lit("[1]")))) == ["{a}"]
    assert one(spark, "http://h/docs/", lambda v: content.topic_links(v, F.lit("r/x"))) == "http://h/docs/r/x"


def test_white_space(spark):
    text = "a\u00a0b\u2003c\x1cd\x85e\u200bf"
    assert one(spark, text, T.word_count) == len(text.split()) and one(spark, text, T.collapse) == " ".join(text.split()) and one(spark, text, T.words) == text.split()


def test_small_rules(spark):
    assert one(spark, "https://www.a.b.org/x", lambda v: classify.internal_link(v, F.lit("http://www.b.org"))) and not one(spark, "https://ab.org/", lambda v: classify.internal_link(v, F.lit("http://b.org")))
    assert one(spark, "http://www.h:1/docs/a", lambda v: classify.plain_scope(v, F.lit("http://h:1/docs/i.html"))) and not one(spark, "http://h/docsx", lambda v: classify.plain_scope(v, F.lit("http://h/docs")))
    assert one(spark, "1 a\nTitle b\nGet Help\n2\n3\n\nplain", classify.contents_list_only) and not one(spark, "1\n2\n3\n4\n5", classify.contents_list_only)
    reasons = spark.range(1).select(metrics.stop_reason(F.lit(3), F.lit(1), 3), metrics.stop_reason(F.lit(2), F.lit(1), 3), metrics.stop_reason(F.lit(2), F.lit(1), 3, stopped=True), metrics.stop_reason(F.lit(2), F.lit(1), 3, error="x")).first()
    assert reasons[0].startswith("MAX_PAGES") and "only 2" in reasons[1] and reasons[2].startswith("User") and reasons[3] == "Error: x"
    links = spark.createDataFrame([("http://h/a/1",), ("http://h/b",), ("http://o/",)], "dst string")
    assert [r[0] for r in scope.readmitted(links, "http://h/a", 0, F.lit(True)).collect()] == ["http://h/a/1", "http://h/b"]
    assert scope.readmitted(links, "http://h/a", 1, F.col("dst") != "http://h/a/1").count() == 1


def test_grouped_agents(spark):
    texts = {
        "stacked": "User-agent: a\nUser-agent: *\nDisallow: /x\nUser-agent: b\nDisallow: /", "named": "User-agent: *\nDisallow: /\n\nUser-agent: Mozilla\nDisallow: /m\nCrawl-delay: 3", "loose": "Disallow: /\nUser-agent: *\n\nDisallow: /y",
        "twice": "User-agent: *\nDisallow: /1\n\nUser-agent: *\nDisallow: /2", "comment": "User-agent: *\n# a\nDisallow: /c",
    }
    rules = robots.rules(spark.createDataFrame(list(texts.items()), "origin string, robots_text string"))
    asked = [("stacked", "/x", False), ("stacked", "/y", True), ("named", "/m", False), ("named", "/z", True), ("loose", "/y", True), ("twice", "/1", False), ("twice", "/2", True), ("comment", "/c", False)]
    df = spark.createDataFrame(asked, "origin string, path string, want boolean").join(rules, "origin", "left")
    got = df.select("origin", "path", "want", robots.allowed(F.col("path"), F.col("blocks_all"), F.col("bot_disallows"), F.col("general")).alias("got")).collect()
    assert [r for r in got if r["want"] != r["got"]] == [] and rules.where("origin = 'named'").first()["crawl_delay"] == 3


def test_ranked(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(50), i) for i in range(500)]
    got = graph.ranked(spark.createDataFrame(rows, "a int, b int").repartition(7), ["a", "b"], "r", 3).collect()
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["r"])] == sorted(rows) and {r["r"] for r in got} == set(range(3, 503))


def test_limited_crawls(spark):
    rng = random.Random(2)
    links = [("s", i, f"n{i}") for i in range(4)] + [(f"n{rng.randrange(40)}", i, f"n{rng.randrange(40)}") for i in range(120)]
    edges = spark.createDataFrame([("g", *x) for x in links], "g string, src string, pos int, dst string")
    edges = edges.replace("s", "S")  # the smallest, so that the walk begins there
    order = [r["node"] for r in graph.bfs(edges, spark.createDataFrame([("S",)], "node string"), 30).orderBy("disc_order").collect()]
    skipped = spark.createDataFrame([(n,) for n in order[1:4]], "node string")
    got = graph.crawl(edges, spark.createDataFrame([("S",)], "node string"), 30, 5, skipped).orderBy("disc_order").collect()
    assert [r["node"] for r in got] == order[:8] and [r["skipped"] for r in got] == [n in order[1:4] for n in order[:8]]
    free = graph.queue_walk(edges, "g", 30, 1000, 1000).orderBy("visit").collect()
    assert [r["node"] for r in free] == order
    tight = graph.queue_walk(edges, "g", 30, 10, 3).collect()
    assert len(tight) <= 10 and {r["node"] for r in tight} < set(order)


def test_attempts(spark):
    tries = spark.createDataFrame([("a", 0, False), ("a", 1, True), ("a", 2, True), ("b", 0, False), ("b", 1, False), ("b", 2, False), ("b", 3, True)], "k string, attempt int, ok boolean")
    assert {r["k"]: (r["attempts"], r["ok"]) for r in metrics.attempts(tries, "k").collect()} == {"a": (2, True), "b": (3, False)}


def test_links_of_a_page(spark):
    page = '<a href="/a#x">1</a><a href="/a">2</a><a href="b?c=1&amp;d">3</a><a href="mailto:x">4</a><a href="//s.h.org/q">5</a><a href="http://o.org/">6</a><a href=" ">7</a>'
    df = spark.createDataFrame([(1, "http://www.h.org/d/", page), (2, "http://h.org", None)], "page_id bigint, url string, html string")
    got = extract.standard_links(df).orderBy("pos").collect()
    assert [(r["dst"], r["internal"]) for r in got] == [("http://www.h.org/a", True), ("http://www.h.org/d/b?c=1&d", True), ("http://s.h.org/q", True), ("http://o.org/", False)]


def test_topic_maps(spark, tmp_path):
    deep = {"prettyUrl": "/0", "contentId": "0"}
    for i in range(1, 200):
        deep = {"prettyUrl": f"/{i}", "contentId": i, "children" if i % 2 else "pageToc": [deep]}
    (tmp_path / "m1.json").write_text(json.dumps({"paginatedToc": [deep, {"prettyUrl": "", "contentId": "x"}]}))
    (tmp_path / "m2.json").write_text("{}")
    got = files.topic_map(spark, str(tmp_path)).collect()
    assert sorted(int(r["content_id"]) for r in got) == list(range(200)) and {r["map_id"] for r in got} == {"m1"}


def test_chunk_columns_and_errors():
    page = {"url": "https://H.org:1/a", "title": "T", "headings": [], "text": words(30), "tables": [], "code_blocks": []}
    bad = page | {"headings": [("hx", ["w1"])]}
    row = next(sections.document(*page.values(), "p", "2020", None, ["S"], 2))
    assert list(row) and set(row) == set(sections.CHUNK.names) and len(sections.CHUNK.names) == 19
    assert (row["domain"], row["parent_url"], row["crawl_timestamp"], row["breadcrumb"], row["depth"]) == ("H.org:1", "p", "2020", ["S"], 2)
    more = dict.fromkeys(sections._PAGE)
    assert sections.attempted(more | page)[1] is None
    chunks, error = sections.attempted(more | bad)
    assert chunks == [] and error.startswith("ValueError")


def test_crawl_export(spark, tmp_path):
    pages = spark.createDataFrame([("u", "é"), ("v", None)], "url string, title string")
    errors = spark.createDataFrame([], "url string, error string")
    files.write_crawl(files.crawl_export(pages, errors, spark.createDataFrame([(2,)], "n int"), "async"), f"{tmp_path}/out")
    read = lambda part: sorted(r[0] for r in spark.read.text(f"{tmp_path}/out/part={part}").collect())
    assert read("head") == ['{"stats":{"n":2}}'] and read("pages") == ['{"url":"u","title":"é"}', '{"url":"v","title":null}']


def test_bounded_first_seen(spark, tmp_path):
    spark.sql("select timestamp_seconds(x) ts, x % 3 as k from (select explode(sequence(0, 30)) x)").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, k int").parquet(f"{tmp_path}/in")
    assert sorted(r["k"] for r in runs.finished(runs.first_seen(stream, ["k"], "10 minutes"), "append").select("k").collect()) == [0, 1, 2]
