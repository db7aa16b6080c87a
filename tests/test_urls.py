"""URL algebra on literal cases."""

from itertools import chain

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftspark.functions import urls as U
from siftspark.operators.scope import Scope, in_scope, widened


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


NORMAL = {
    "https://Example.COM/a//b/": "https://example.com/a/b", "HTTPS://x.org": "https://x.org/", "  http://x.org/p?utm_source=a&UTM_Medium=b&k&z=1 ": "http://x.org/p?k=&z=1",
    "http://x.org/p?b=1&a=2&b=3": "http://x.org/p?b=1&b=3&a=2", "http://x.org/a.pdf/": None, "http://x.org/a.PDF": None, "javascript:void(0)": None, "MAILTO:a@b": None, "#top": None, "ftp://x.org/": None,
    "http://www.x.org:8080/a#f": "http://www.x.org:8080/a", "http://x.org/a;p=1?q=*~ b": "http://x.org/a;p=1?q=%2A~+b", "http://under_score.x/a b|c": "http://under_score.x/a b|c", "http://x.org/a.pdf;v=1": None, "": None, "/relative": None, None: None,
}


def test_normalize(spark):
    assert dict(zip(NORMAL, column(spark, NORMAL, U.normalize), strict=True)) == NORMAL


RELATIVE = {"endpoint": "http://h/docs/api/endpoint", "/x/../y": "http://h/y", "../up": "http://h/docs/up", "//o.org/z": "http://o.org/z", "?q=1": "http://h/docs/api?q=1", "https://k/a": "https://k/a", "./a/./b": "http://h/docs/api/a/b", "../../../../top": "http://h/top"}


def test_resolution(spark):
    got = column(spark, RELATIVE, lambda v: U.normalize(v, F.lit("http://h/docs/api")))
    assert dict(zip(RELATIVE, got, strict=True)) == RELATIVE
    assert column(spark, ["c"], lambda v: U.normalize(v, F.lit("http://h/a/b.html"))) == ["http://h/a/c"]


CANONICAL = {
    "http://h/p%61th": "http://h/path", "http://h/a%2Fb": "http://h/a%2Fb", "http://h/a%2fb%7e": "http://h/a%2Fb~", "http://h/a/b/../c": "http://h/a/c", "http://h/a/b/c/../../d": "http://h/a/d", "http://h/a/./b": "http://h/a/b",
    "http://h:80/a": "http://h/a", "https://h:443/a": "https://h/a", "http://h:8080/a": "http://h:8080/a", "http://www.h/a/": "http://h/a", "http://h": "http://h/", "http://H/a#f": "http://h/a", "http://h//a": "http://h//a", "http://h///a": "http://h/a",
    "http://h/a;x=1?q=1": "http://h/a?q=1", "": None, "javascript:x": None, "mailto:a@b": None, "ftp://h/": None, "#": None,
}


def test_canonical(spark):
    assert dict(zip(CANONICAL, column(spark, CANONICAL, lambda v: U.canonical(v)["raw"]), strict=True)) == CANONICAL
    assert column(spark, ["http://h/a?q=1"], lambda v: U.canonical(v, strip_query=True)["raw"]) == ["http://h/a"]


@pytest.mark.parametrize(
    ("root", "url", "inside"),
    [
        ("http://h/docs", "http://h/docs/page", True), ("http://h/docs", "http://h/docs-archive/page", False), ("http://h/docs", "http://h/docs", True), ("http://h/docs", "http://h/blog", False), ("http://h/docs", "http://h/docstring", False),
        ("http://h/", "http://h/any", True), ("http://h/docs", "http://o/docs/a", False), ("http://h/docs/index.html", "http://h/docs/x", True), ("http://h/app/page.php", "http://h/app", True),
    ],
)
def test_scope(spark, root, url, inside):
    assert column(spark, [url], lambda v: in_scope(v, F.lit(root))) == [inside]


def test_scope_options(spark):
    assert column(spark, ["https://h/docs/a", "http://h/docs/a"], lambda v: in_scope(v, F.lit("http://h/docs"), cross_scheme=False)) == [False, True]
    denied = Scope("http://h/", deny=(".*LOGOUT.*", r"\.(pdf|zip)$", "(broken"))
    assert column(spark, ["http://h/logout", "http://h/a.zip", "http://h/a"], denied.accept) == [False, False, True]
    assert column(spark, ["http://h/a?lang=x&id=42&printMode=1"], Scope("http://h/", strip_keys=("lang", "printMode")).filter_and_clean) == ["http://h/a?id=42"]
    assert column(spark, ["http://h/a?id=42"], Scope("http://h/", strip_all=True).filter_and_clean) == ["http://h/a"]
    scores = column(spark, ["http://h/docs", "http://h/docs/a", "http://h/docs/a/b", "http://h/docs/a/b/c", "http://o/"], Scope("http://h/docs").score)
    assert scores == pytest.approx([1.0, 0.9, 0.7, 0.4, 0.0])
    assert column(spark, ["http://h/a"], Scope("").accept) == [False]
    assert column(spark, ["/docs/a/x", "/docs/b", "/blog"], lambda v: widened(v, F.lit("/docs/a/y"))) == ["/docs/a", "/docs", "/"]


def test_report_form(spark):
    cases = {"HTTP://www.H:80/a//b/index.html?b=2&utm_source=x&a=1#f": "http://h/a/b?a=1&b=2", "https://h/": "https://h", "https://h:443/a/": "https://h/a"}
    assert dict(zip(cases, column(spark, cases, U.report), strict=True)) == cases


def test_small_functions(spark):
    assert column(spark, ["http://Www.h:1/a"], U.domain) == ["www.h:1"]
    assert column(spark, ["Guides & Tips", "API Reference"], U.slug) == ["guidestips", "apireference"]
    assert column(spark, ["http://a.b:1/c/d"], U.output_name) == ["a_b_1__c_d"]
    assert column(spark, ["http://www.a/x"], lambda v: U.same_domain(v, F.lit("https://A/y"))) == [True]


def test_canonical_paths(spark):
    cases = {
        "http://h//": "http://h", "http://h//.": "http://h", "http://h//..": "http://h", "http://h///": "http://h/", "http://h": "http://h/", "http://h//a/": "http://h//a",
        "http://h///a": "http://h/a", "http://h/a/../b/./c/": "http://h/b/c", "http://www.H:80/%7ea%2f": "http://h/~a%2F", "\u00a0http://h/a\u2003": "http://h/a",
    }
    assert dict(zip(cases, column(spark, cases, lambda v: U.canonical(v)["raw"]), strict=True)) == cases


@given(st.lists(st.builds("{}://{}/{}{}".format, st.sampled_from(["http", "HTTPS"]), st.sampled_from(["h", "WWW.h.org:80"]), st.text("ab/.c1", max_size=12), st.sampled_from(["", "?a=1&b", "?ref=x#y"])), min_size=1, max_size=30))
@settings(deadline=None, max_examples=15)
def test_normal_forms_are_stable(spark, urls):
    for f in (U.normalize, lambda v: U.canonical(v)["raw"]):
        once = [u for u in column(spark, urls, f) if u is None or "/" in u.partition("://")[2]]  # a path of two slashes goes, and a URL without a path then gets one
        assert list(chain(column(spark, once, f))) == once
