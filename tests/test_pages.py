"""Text, gates, extraction, sections, chunks, robots and sources on literal cases."""

import hashlib
import random

from pyspark.sql import functions as F

from siftspark.functions import text as T
from siftspark.operators import chunking, extract, gates, robots, sections
from siftspark.sources import files


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


PAGE = """<html><head><title>T &amp; t</title><meta name="description" content="about it"><style>p{}</style><script>var a="</p>";</script></head>
<body><nav><a href="/n">n</a></nav><main><h1>Top</h1><p>One two<br>three</p><h2>Install</h2><p>Do it</p><img src="i.png" alt="x"><img alt="none">
<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table><pre><code>print("a long line")</code></pre><a href="g?x=1">g</a><a href="mailto:a@b">m</a></main><footer>f</footer></body></html>"""


def test_extraction(spark):
    assert one(spark, PAGE, extract.title) == "T & t" and one(spark, PAGE, extract.heading_title) == "Top"
    assert one(spark, PAGE, extract.meta_description) == "about it"
    assert one(spark, PAGE, extract.headings) == {"h1": ["Top"], "h2": ["Install"]}
    assert one(spark, PAGE, extract.main_text).startswith("Top One two three Install Do it A B 1 2")
    tree = extract.tree(PAGE)
    assert tree["title"] == "T & t" and tree["headings"] == [("h1", ["Top"]), ("h2", ["Install"])] and tree["tables"] == [{"headers": ["A", "B"], "rows": [["1", "2"]]}]
    assert tree["images"] == [{"src": "i.png", "alt": "x", "title": "", "width": "", "height": ""}] and 'print("a long line")' in tree["code_blocks"] and tree["hrefs"] == ["/n", "g?x=1", "mailto:a@b"]
    pages = spark.createDataFrame([(1, "http://h/d/p.html", PAGE), (2, "http://h/", None)], "page_id bigint, url string, html string")
    assert [r["dst"] for r in extract.links(pages).orderBy("pos").collect()] == ["http://h/n", "http://h/d/g?x=1", None]
    assert extract.parsed(pages).count() == 2


def test_sections_and_chunks():
    text = " ".join(f"w{i}" for i in range(30))
    got = sections.split_sections(f"intro Install Guide {text} Install more", [("h1", ["Install"]), ("h2", ["Install Guide"])])
    assert [(level, h) for level, h, _ in got] == [(0, ""), (1, "Install"), (1, "Install")]
    rows = list(sections.document("u", "P", [("h1", ["A1"]), ("h2", ["B2"]), ("h3", ["C3"])], f"A1 {text} C3 {text} B2 {text}", [{"headers": ["h"], "rows": [["w"] * 20]}, {"headers": ["h"], "rows": [["x"]]}], [text, "short"]))
    assert [r["heading_path"] for r in rows] == [["H1: A1"], ["H1: A1", "H3: C3"], ["H1: A1", "H2: B2"], ["H1: A1", "H2: B2"], ["H1: A1", "H2: B2"]]
    assert [r["chunk_type"] for r in rows] == ["text"] * 3 + ["table", "code"] and [r["chunk_index"] for r in rows] == list(range(5))
    assert rows[0]["section_title"] == "A1" and rows[0]["token_estimate"] == 39 and not list(sections.document("u", "t", [], "", [], []))


def test_chunk_sizes():
    words = lambda n: " ".join(f"x{i}" for i in range(n))
    sizes = lambda t: [len(c.split()) for c in sections.chunk(t)]
    assert sizes(words(19)) == [] and sizes(words(20)) == [20] and sizes(words(600)) == [600]
    assert sizes(words(601)) == [601]  # one sentence is not cut
    assert sizes("\n\n".join(map(words, (390, 20, 390)))) == [390, 60, 430]
    assert sizes("\n\n".join(map(words, (5, 400, 300)))) == [405, 340]  # too short to end a chunk, so it is carried on


def test_both_chunkers_agree(spark):
    rng = random.Random(4)
    texts = ["\n\n".join(" ".join(rng.choice(["a", "bb.", "c!?", "d\n", "e"]) for _ in range(rng.randrange(1, 900))) for _ in range(rng.randrange(1, 6))) for _ in range(30)] + ["", None, "  \n\n "]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {}
    for r in chunking.chunks(df, "text").orderBy("i", "chunk_index").collect():
        got.setdefault(r["i"], []).append(r["content"])
    assert got == {i: c for i, t in enumerate(texts) if (c := sections.chunk(t or ""))}


def test_text(spark):
    assert one(spark, " a\n\n\n\nb   c ", T.clean) == "a\n\nb c" and one(spark, "see http://x/y now", lambda v: T.clean(v, remove_urls=True)) == "see  now"
    hashes = T.simhash(spark.createDataFrame([(1, ""), (2, None), (3, "same same"), (4, "Same")], "i int, t string"), "t").orderBy("i").collect()
    assert [r["simhash"] for r in hashes[:2]] == ["f" * 16] * 2 and hashes[2]["simhash"] == hashes[3]["simhash"] == hashlib.md5(b"same").hexdigest()[16:]
    assert one(spark, "f" * 16, lambda v: T.hamming(v, F.lit("0" * 15 + "1"))) == 63
    assert one(spark, "H2: x", T.heading_level) == 2 and one(spark, "x", T.heading_level) == 0
    assert one(spark, "u", lambda v: T.chunk_id(v, F.lit(7))) == "u_0007"
    assert one(spark, "a Back to Home\nON\n\n\n\nb", lambda v: T.without_phrases(v, T.PORTAL_PHRASES)) == "a \n\nb"
    table = spark.sql("select array('a','bc') h, array(array('1','2')) r").select(T.table_text(F.col("h"), F.col("r"))).first()[0]
    assert table == "a | bc\n---------\n1 | 2"


def test_gates(spark):
    low = lambda words: lambda v: gates.low_content(v, F.lit(words))
    assert one(spark, "Loading application", low(2)) and not one(spark, "nine ordinary words", low(9)) and one(spark, "cookie notice", low(9)) and not one(spark, "cookie notice", low(29))
    assert one(spark, ' {"a": [1]} ', gates.json_dump) and not one(spark, "[not json}", gates.json_dump) and not one(spark, "{x}", gates.json_dump)
    assert one(spark, "Access Denied", lambda v: gates.soft_404(F.lit(""), v)) and not one(spark, "x" * 500 + "404", lambda v: gates.soft_404(F.lit(""), v))
    assert one(spark, "http://h/saml2/idp/sso", lambda v: gates.session_expired(v, F.lit("http://h/a"))) and not one(spark, "http://h/login/x", lambda v: gates.session_expired(v, F.lit("http://h/login")))
    assert one(spark, '<body><div id="root"></div>' + "x" * 200, gates.js_required) and not one(spark, f"<body>{'word ' * 200}</body>", gates.js_required)
    assert one(spark, "application/pdf", lambda v: gates.load_status(F.lit(200), v)) == "skipped" and one(spark, None, lambda v: gates.load_status(F.lit(404), v)) == "failed"
    assert one(spark, "https://www.google-analytics.com/a.js", lambda v: gates.blocked_request(F.lit("script"), v))


def test_robots(spark):
    texts = {
        "plain": "User-agent: *\nDisallow: /a # c\nCrawl-delay: 1.5\nSitemap: http://s/x.xml", "mirror": "User-agent: *\nDisallow: /\nUser-agent: Googlebot\nAllow: /\nDisallow: */cmp/*\nDisallow: /x$",
        "closed": "User-agent: *\nDisallow: /", "none": "",
    }
    rules = robots.rules(spark.createDataFrame(list(texts.items()), "origin string, robots_text string"))
    row = rules.where("origin = 'plain'").first()
    assert row["crawl_delay"] == 1.5 and row["sitemaps"] == ["http://s/x.xml"] and not row["blocks_all"]
    asked = [("plain", "/a/b", False), ("plain", "/b", True), ("mirror", "/q/cmp/z", False), ("mirror", "/x", True), ("mirror", "/x$", False), ("closed", "/b", False), ("none", "/b", True), ("absent", "/b", True)]
    df = spark.createDataFrame(asked, "origin string, path string, want boolean").join(rules, "origin", "left")
    assert all(r["want"] == r["got"] for r in df.select("want", robots.allowed(F.col("path"), F.col("blocks_all"), F.col("bot_disallows"), F.col("general")).alias("got")).collect())


def test_sources(spark, tmp_path):
    (tmp_path / "s.xml").write_text('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>http://h/a</loc></url><url><loc> http://h/b </loc></url></urlset>')
    (tmp_path / "c.json").write_text('{"stats": {}, "pages": [{"url": "http://h/a"}, {"url": "http://h/c", "x": 1}]}')
    (tmp_path / "toc.json").write_text('{"paginatedToc": [{"prettyUrl": "/a", "contentId": "1", "children": [{"prettyUrl": "/a/b", "contentId": "2"}]}, {"prettyUrl": "/c", "contentId": "3"}]}')
    (tmp_path / "h.org.txt").write_text("User-agent: *\n")
    urls = lambda name: sorted(r["url"] for r in files.url_set(spark, f"{tmp_path}/{name}").collect())
    assert urls("s.xml") == ["http://h/a", "http://h/b"] and urls("c.json") == ["http://h/a", "http://h/c"]
    assert sorted(tuple(r) for r in files.topic_map(spark, f"{tmp_path}/toc.json").collect()) == [("/a", "toc", "1"), ("/a/b", "toc", "2"), ("/c", "toc", "3")]
    assert files.robots(spark, f"{tmp_path}/h.org.txt").first()["origin"] == "h.org"
