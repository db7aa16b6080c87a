"""Predicates and flags that decide which pages go on. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from .classify import contents_list_only

# Fixed values.
ERROR_PHRASES = ["page not found", "404", "not available", "access denied", "forbidden", "unauthorized", "no permission", "error occurred"]
LOADING_PHRASES = ["loading application", "loading...", "please wait", "initializing", "just a moment"]
JUNK_PATTERNS = [
    "/viewer/attachment/", "/viewer/",
    "/(de-DE|fr-FR|ko-KR|ja-JP|zh-CN|zh-TW|pt-BR|es-ES|it-IT|nl-NL|ru-RU|pl-PL|sv-SE|da-DK|fi-FI|nb-NO|cs-CZ|hu-HU|ro-RO|tr-TR|th-TH|he-IL|ar-SA|id-ID|ms-MY|vi-VN|uk-UA|el-GR|bg-BG|hr-HR|sk-SK|sl-SI|lt-LT|lv-LV|et-EE)/",
    "/json$", r"/json\?", r"\.json$", "/api/", "/rest/", "/graphql", "/odata/", r"\.xml$", r"\.pdf$", r"\.zip$", r"\.csv$",
]
EXPIRY_PATTERNS = ["accounts.sap.com", "/saml2/idp/sso", "/saml/", "/nidp/", "/adfs/", "/idp/", "/login", "login.microsoftonline.com", "authn/SSORedirect", "SAMLRequest="]
BLOCKED_TYPES = ["image", "media", "font"]
BLOCKED_SCRIPTS = ["google[-_]?analytics", "googletagmanager", r"facebook\.net", r"doubleclick\.net", r"hotjar\.", r"optimizely\.", r"segment\.(com|io)", r"mixpanel\.", r"amplitude\.", r"fullstory\.", r"newrelic\.", r"sentry\.io"]
JUNK_PATTERNS_SYNC = JUNK_PATTERNS[:3]
SHARE, SEARCH, FOOTER, FEEDBACK = ["Share on LinkedIn", "Share on X"], ["Search Unavailable", "No matching results"], ["© Oracle", "About Oracle", "Terms of Use"], ["Was this page helpful"]
SCRIPT_NOTICES = ["enable javascript", "requires javascript", "need javascript", "browser"]
FRAMEWORKS = ["react", "vue", "angular", "next", "nuxt", "gatsby", "webpack", "chunk", "bundle", "app.", "main."]
PORTAL_FLAGS = ["Restricted Card Content", "not authorized to see", "Header Title (Not Shown)"]


def content_type_ok(content_type: Column) -> Column:
    """A page: HTML, XHTML, or no type given."""
    t = F.lower(F.coalesce(content_type, F.lit("")))
    return (t == "") | t.contains("text/html") | t.contains("xhtml")


def load_status(status: Column, content_type: Column) -> Column:
    """failed, skipped or ok, from a response's status and type."""
    t = F.lower(F.coalesce(content_type, F.lit("")))
    page = (t == "") | t.contains("text/html") | t.contains("text/plain") | t.contains("application/xhtml")
    return F.when(status >= 400, "failed").when(~page, "skipped").otherwise("ok")


def junk_url(url: Column, patterns: list[str] = JUNK_PATTERNS) -> Column:
    return url.rlike("(?i)(" + "|".join(patterns) + ")")


def soft_404(title: Column, text: Column) -> Column:
    return F.lower(title).rlike(T.quoted(ERROR_PHRASES)) | F.lower(F.substring(text, 1, 500)).rlike(T.quoted(ERROR_PHRASES))


def still_loading(text: Column) -> Column:
    """A page that shows only a loading message or a cookie wall."""
    head = F.lower(F.substring(U.strip(text), 1, 500))
    return head.rlike(T.quoted(LOADING_PHRASES)) | (head.contains("cookie") & head.contains("accept") & (F.length(head) < 600))


def low_content(text: Column, count: Column, cookie_words: int = 30) -> Column:
    low = F.lower(text)
    return (count < 10) & (low.contains("loading application") | (count == 0) | (low.contains("cookie") & (count < cookie_words)))


def json_dump(text: Column) -> Column:
    """The whole text is one JSON value in brackets. (VARIANT parsing: trailing text after a value is rejected by the bracket test, NaN is no JSON.)"""
    bare = U.strip(text)
    bracketed = (bare.startswith("{") & bare.endswith("}")) | (bare.startswith("[") & bare.endswith("]"))
    return bracketed & F.try_parse_json(bare).isNotNull()


def fingerprint(title: Column, text: Column, url: Column) -> Column:
    """What makes a page a repeat: title, first 1000 characters and path; a null counts as empty."""
    title, text, path = (F.coalesce(x, F.lit("")) for x in (title, text, U.path(url)))
    return F.md5(F.concat(title, F.lit("|"), F.substring(text, 1, 1000), F.lit("|"), path))


def first_of(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row of each key. Ties are broken by the order given."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def session_expired(landing: Column, intended: Column) -> Column:
    """The browser landed on a login page that was not asked for."""
    return F.exists(F.array(*map(F.lit, EXPIRY_PATTERNS)), lambda p: F.contains(landing, p) & ~F.contains(intended, p))


def blocked_request(kind: Column, url: Column) -> Column:
    return kind.isin(BLOCKED_TYPES) | ((kind == "script") & url.rlike("(?i)(" + "|".join(BLOCKED_SCRIPTS) + ")"))


def meaningful_change(before: Column, after: Column) -> Column:
    """struct(text, links, headings, expanded) before and after a click."""
    return (after["text"] - before["text"] >= 80) | (after["links"] - before["links"] >= 1) | (after["headings"] > before["headings"]) | (after["expanded"] > before["expanded"])


def bulk_expanded(links: Column, text: Column, expanded: Column) -> Column:
    return (links > 0) | (text > 200) | (expanded > 5)


def quality_flags(text: Column) -> dict[str, Column]:
    """What navigation and search leave in a page's text."""
    lines = F.filter(F.transform(F.split(text, "\n"), F.trim), lambda s: s.rlike("^[0-9]"))
    return {
        **{name: text.rlike(T.quoted(phrases)) for name, phrases in (("share", SHARE), ("search", SEARCH), ("footer", FOOTER), ("feedback", FEEDBACK))},
        "toc_only": contents_list_only(text),
        "dup_toc": (F.size(lines) > F.size(F.array_distinct(lines))) & (F.size(F.array_distinct(lines)) > 3),
    }


def portal_junk(text: Column) -> Column:
    return text.rlike(T.quoted(PORTAL_FLAGS))


def js_required(html: Column) -> Column:
    """The page probably needs a browser: a near-empty body, an empty application root, a notice that asks for scripts, or many scripts around little text."""
    body = F.regexp_replace(F.regexp_replace(F.regexp_extract(html, r"(?is)<body[^>]*>(.*?)(</body>|$)", 1), r"(?is)<!--.*?-->", ""), "<[^>]*>", "")
    size = F.length(F.regexp_replace(body, r"\s+", ""))
    root = html.rlike(r"""(?is)<div[^>]*\bid=["']?(root|app|__next|__nuxt)["']?[^>]*>\s*</div>""")
    notice = F.lower(F.regexp_extract(html, r"(?is)<noscript[^>]*>(.*?)</noscript>", 1)).rlike(T.quoted(SCRIPT_NOTICES))
    scripts = F.regexp_count(html, F.lit("(?i)<script\\b"))
    frameworks = F.size(F.filter(F.regexp_extract_all(html, F.lit(r"(?is)(<script\b[^>]*>[^<]{0,200})"), F.lit(1)), lambda s: F.lower(s).rlike(T.quoted(FRAMEWORKS))))
    data = html.contains("application/ld+json") & (size < 300)
    return (size < 150) | root | notice | ((size < 500) & ((scripts > 15) | (frameworks >= 2))) | data
