"""Navigation, help and portal pages, printed reports, click counters and stateful pacing on literal cases."""

import random

from pyspark.sql import functions as F

from siftspark.operators import dom, graph, metrics, navigation, report
from siftspark.streaming import runs

PAGE = """<html><body><ul class="breadcrumb"><li><a href="/">Home</a></li><li><a href="/docs">Docs</a></li><li><a href="/">Home</a></li></ul>
<nav><ul><li>Guide<ul><li class="nav-item">Install<ul><li class="nav-item active"><a href="/docs/linux?x=1">Linux
</a></li></ul></li><li><a href="http://other.org/x">Other</a></li></ul></li></ul></nav>
<div data-route="/r/one"></div><div data-url="mailto:x"></div><span class="sapMeSidebarTextContent">Finance &amp; Legal</span>
<div id="shell-header"><div class="sapMITBFilter">Shell</div></div><div class="sapMPage"><div class="sapMITBFilter"><span class="sapMITBText">My Reports</span>9</div><div class="sapMITBFilter">Tab 1</div></div>
<a class="sapMLnk" href="/see/all">s</a><div class="sapMGT"><a href="/tile">Tile text</a></div><a href="#top/here">t</a></body></html>"""


def test_places(spark):
    root = dom.tree(PAGE)
    assert navigation.breadcrumb(root) == ["Home", "Docs"] and navigation.section_path(root) == ["Guide", "Install", "Linux"]
    got = navigation.routes(root, "http://h.net/getassistance/overview")
    assert got == ["http://h.net/docs/linux?x=1", "http://other.org/x", "http://h.net/r/one", "http://h.net/financelegal", "http://h.net/getassistance/myreports", "http://h.net/see/all", "http://h.net/tile", "http://h.net/top/here"]
    pages = spark.createDataFrame([(1, "http://h.net/a/b", PAGE), (2, None, None), (None, "http://h/", "")], "page_id bigint, url string, html string")
    found = navigation.places(pages)
    assert found.count() == 3 and navigation.site_routes(found).where("dst like '%other%'").isEmpty()
    assert navigation.places(pages.limit(0)).isEmpty() and navigation.profiles(pages).count() == 3
    assert navigation.breadcrumb(dom.tree('<nav aria-label="x breadcrumb"><a>One</a></nav>')) == ["One"]
    assert dom.tree("<div>" * 20_000 + "deep").text() == "deep"


def test_inherited_paths(spark):
    rows = [(str(i), str(i - 1) if i else None, [f"s{i}"] if i in (0, 7, 40) else ([] if i % 2 else None)) for i in range(60)] + [("a", "b", None), ("b", "a", []), ("x", "gone", None)]
    got = {r["node"]: r["section_path"] for r in graph.inherited(spark.createDataFrame(rows, "node string, parent string, section_path array<string>")).collect()}
    assert got == {str(i): [f"s{0 if i < 7 else 7 if i < 40 else 40}"] for i in range(60)} | {"a": [], "b": [], "x": []}


def test_help_and_portal_pages(spark):
    code = "DATA x TYPE i.<br>&nbsp;WRITE x && 'long enough text'."
    page = f"""<title></title><body><nav>n</nav><span class="h2">Note</span><span class="h2">Real title</span><div id="content"><p>Some  text</p><h2>H</h2><span class="qtext">{code}</span></div>
<div class="sapMList"><div class="sapMLIB"><div class="sapMListTblCell">a</div><div class="sapMListTblCell">b</div></div><div class="sapMLIB"><div class="sapMListTblCell"> </div></div></div>
<table><tr><th>A</th></tr><tr><td>1</td></tr></table><table><tr><th>no rows</th></tr></table><div class="sapFCard">Card text</div><div class="sapFCard">Card text</div></body>"""
    found = navigation.help_profile(dom.tree(page))
    lines = "DATA x TYPE i.\n WRITE x && 'long enough text'."
    assert found["title"] == "Real title" and found["code_blocks"] == [lines] and found["text"].endswith("--- Code ---\n\n" + lines)
    assert found["headings"] == [("h2", ["H", "Note", "Real title"])]
    assert navigation.portal_tables(dom.tree(page)) == [{"headers": [], "rows": [["a", "b"]]}, {"headers": ["A"], "rows": [["1"]]}]
    assert navigation.portal_cards(dom.tree(page)) == "Card text"
    html = """<a href="javascript:call_link('x.htm')">x</a><a href='y.html'>y</a><a href="y.html">y</a><a href="javascript:z.htm">z</a>"""
    df = spark.createDataFrame([("http://h/d/p", html, "one two", "c " * 9)], "url string, html string, text string, cards string")
    assert df.select(navigation.help_links(F.col("html"), F.col("url"))).first()[0] == ["http://h/d/x.htm", "http://h/d/y.html"]
    tables = F.expr("array(named_struct('headers', array('A', 'B'), 'rows', array(array('1', '2'))))")
    assert df.select(navigation.portal_text(F.col("text"), tables, F.lit("c"))).first()[0] == "one two\nA | B\n1 | 2"
    assert df.select(navigation.portal_text(F.col("text"), F.slice(tables, 1, 0), F.col("cards"))).first()[0] == "c " * 9
    assert df.select(navigation.preferred_text(F.lit("a b c d e"), F.lit("a b c d e f"))).first()[0] == "a b c d e"


def printed(chunks, budget):
    """Blocks of one document, one chunk after the other."""
    out, last, used = [], "", 0
    for k, (title, section, path, kind, content) in enumerate(chunks):
        if not k:
            out.append(("title", 1, title[:120]))
        if used >= budget:
            return [*out, ("truncated", 0, report.TRUNCATED)]
        if section and section not in (last, title):
            out.append(("heading", max(2, min(6, int(path[-1][1]) + 1 if path else 2)), section[:100]))
            last = section
        if kind != "text":
            out.append((kind, 0, content))
            continue
        for p in filter(None, map(str.strip, content.split("\n\n"))):
            out.append(("text", 0, p))
            used += len(p)
    return out


def test_report(spark):
    rng = random.Random(5)
    docs = {}
    for i in range(40):
        docs[str(i)] = [("T", s := rng.choice(["A", "B", "T", ""]), [f"H{rng.randrange(1, 7)}: {s}"] if rng.random() < 0.8 else [], rng.choice(["text", "text", "table", "code"]), "\n\n".join("x" * rng.randrange(30) for _ in range(3))) for _ in range(rng.randrange(1, 12))]
    rows = [(i, k, *c) for i, cs in docs.items() for k, c in enumerate(cs)]
    df = spark.createDataFrame(rows, "doc_id string, chunk_index int, page_title string, section_title string, heading_path array<string>, chunk_type string, content string")
    got = {}
    for r in report.document_blocks(df, 100).orderBy("doc_id", "block_no").collect():
        got.setdefault(r["doc_id"], []).append((r["kind"], r["level"], r["text"]))
    assert got == {i: printed(c, 100) for i, c in docs.items()}
    assert report.document_blocks(df.limit(0)).isEmpty()
    value = lambda text, f: spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]
    assert value(" a | b |\n---+---\n\n| 1 ||2|\n", report.table_rows) == [["a", "b"], ["1", "2"]] and value(None, report.table_rows) == []
    assert [len(x) for x in value("x" * 16_000, report.slices)] == [2000] * 7 + [1000] and value("", report.slices) == [] and value(None, report.slices) == []
    headings = F.expr("map('h1', array('Same', ' Top '), 'h6', array('Same'))")
    assert [tuple(x) for x in value("Top\n\nplain\n\n\n\nSame", lambda t: report.headed_blocks(t, headings))] == [("heading", 2, "Top"), ("text", 0, "plain"), ("heading", 6, "Same")]


def test_expansion(spark):
    outcomes = {"a": "yynnny", "b": "nnyn", "c": "yyyyyyy", "d": "nnnnn"}
    rows = [(k, i, x == "y") for k, v in outcomes.items() for i, x in enumerate(v)] + [("e", 0, None)]
    got = {r[0]: tuple(r)[1:] for r in metrics.expansion(spark.createDataFrame(rows, "k string, i int, good boolean"), "k", ["i"], F.col("good"), 3, 6).collect()}
    assert got == {"a": (5, 2, 3, True, False), "b": (4, 1, 3, False, False), "c": (6, 6, 0, False, True), "d": (3, 0, 3, True, False), "e": (1, 0, 1, False, False)}


def test_pacing_across_batches(spark, tmp_path):
    rows = [(i, i % 3, 1_000 * i * i % 7_919) for i in range(60)]
    for part in range(3):
        df = spark.createDataFrame(sorted(rows, key=lambda r: r[2])[20 * part : 20 * part + 20], "event_id bigint, k int, ms int").select("event_id", "k", F.timestamp_millis("ms").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        schema = df.schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = {r[0]: r[1] for r in runs.finished(runs.token_bucket(stream, "k", 10), "append").collect()}
    last, want = {}, {}
    for i, k, ms in sorted(rows, key=lambda r: (r[2], r[0])):
        go = max(ms * 1000, last.get(k, -(10**18)) + 100_000)
        last[k], want[i] = go, go - ms * 1000
    assert got == want
