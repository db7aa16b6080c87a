"""What kind of site a page or URL belongs to, which links are internal, and whether a saved session holds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import urls as U

# Fixed values.
PORTAL_MARKS = [
    r"<[^>]*\bdata-sap-ui-area\b", r"""<[^>]*\bclass\s*=\s*["'][^"']*(?<![\w-])(sapUiBody|sapMShellContent|sapUshellShellHead|sapFDynamicPage|sapUiLocalBusyIndicator)(?![\w-])""",
    r"""<[^>]*\bid\s*=\s*["']shell-header["']""", r"""<script\b[^>]*\bsrc\s*=\s*["'][^"']*(sap-ui-core|openui5|sapui5)""", r"""<link\b[^>]*\bhref\s*=\s*["'][^"']*sap-ui""",
]
TOPIC_MARKS = [
    r"FluidTopicsClientConfiguration", r"""<[^>]*\bid\s*=\s*["'](fluidtopicsclient|FT-application-loader)["']""", r"""<body\b[^>]*\bclass\s*=\s*["'][^"']*FT-version""",
    r"""<script\b[^>]*\bsrc\s*=\s*["'][^"']*fluidtopics""",
]
HELP_HOST = "help.sap.com"
PORTAL_DOMAINS = ["sap.com", "sap.", "successfactors.", "sapfiori.", ".hana.ondemand.com", "cloud.sap", "s4hana.", "ariba.", "concur.", "fieldglass.", "hybris.", "sapbydesign."]
PORTAL_PATHS = ["/irj/portal", "/sap/bc/", "/sap/bc/ui5", "/sap/bc/gui", "/fiori", "/shell/home", "/nwbc/", "/cp.portal"]

#: Portals in the order in which they are asked: name, parts of the host, parts of the path.
PORTALS = [("sap", PORTAL_DOMAINS, PORTAL_PATHS)]


def _marked(html: Column, marks: list[str]) -> Column:
    return F.coalesce(html.rlike("(?s)" + "|".join(f"({m})" for m in marks)), F.lit(False))


def portal_page(html: Column) -> Column:
    return _marked(html, PORTAL_MARKS)


def topic_site(html: Column) -> Column:
    return _marked(html, TOPIC_MARKS)


def help_site(url: Column) -> Column:
    return F.coalesce(F.contains(F.lower(url), F.lit(HELP_HOST)), F.lit(False))


def login_portal(url: Column, portals: list[tuple[str, list[str], list[str]]] = PORTALS) -> Column:
    """The first portal with a pattern in the URL's host or path, or null."""
    low = F.lower(url)
    out = F.lit(None).cast("string")
    some = lambda text, parts: F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(text, p))
    for name, hosts, paths in reversed(portals):
        out = F.when(some(U.netloc(low), hosts) | some(U.path(low), paths), name).otherwise(out)
    return out


def internal_link(url: Column, base: Column) -> Column:
    """HTTP(S), and the base's host or a subdomain of it, without one leading `www.`."""
    host, own = (F.regexp_replace(U.domain(x), r"^www\.", "") for x in (url, base))
    return F.coalesce(U.scheme(url).isin("http", "https") & ((host == own) | F.endswith(host, F.concat(F.lit("."), own))), F.lit(False))


def plain_scope(url: Column, start: Column) -> Column:
    """The older scope rule: equal hosts with their ports, without `www.`, and a path equal to the start's scope path or below it."""
    path = U.path(url)
    path = F.when(path.isin("", "/"), "/").otherwise(F.regexp_replace(path, "/+$", ""))
    return F.coalesce(U.same_domain(url, start) & U.let(U.scope_path(U.path(start)), lambda s: (s == "/") | (path == s) | F.startswith(path, F.concat(s, F.lit("/")))), F.lit(False))


def route(js_required: Column, static_failed: Column, js_enabled: bool = True) -> Column:
    """Which fetch a page goes through: `js` if it needs a browser or its static fetch failed."""
    return F.when(F.coalesce(js_required | static_failed, F.lit(True)) if js_enabled else F.lit(False), "js").otherwise("static")


def session_valid(cookies: Column, age_hours: Column, logins: Column, most_hours: float = 8.0, most_logins: int = 3) -> Column:
    """A saved session holds: it has cookies, is not too old, and was not logged in to too often."""
    return F.coalesce((cookies > 0) & (age_hours <= most_hours) & (logins <= most_logins), F.lit(False))


def contents_list_only(text: Column) -> Column:
    """More than five lines, over 70 % of which begin with a digit, `Title` or `Get Help`."""
    lines = F.filter(F.transform(F.split(text, "\n"), U.strip), lambda x: x != "")
    heading = F.filter(lines, lambda x: x.rlike(r"^(\p{Nd}|Title|Get Help)"))
    return U.let(F.struct(F.size(lines).alias("n"), F.size(heading).alias("h")), lambda c: (c["n"] > 5) & (c["h"] > 0.7 * c["n"]))
