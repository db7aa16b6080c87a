"""URL algebra as column expressions: everything stays in generated code and can be pushed down.

`parse_url` is not used: it raises on `|` and spaces and rejects some hosts. The RFC 3986 (appendix
B) expression splits any string. A null URL gives null everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RFC3986 = r"(?s)^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?$"

# Fixed values.
TRACKING_PARAMS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref", "source", "mc_cid", "mc_eid", "_ga", "_gid", "dclid", "zanpid", "epik"]
SKIP_EXTENSIONS = [
    ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".svg", ".webp", ".ico", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip", ".rar", ".tar", ".gz", ".7z",
    ".mp3", ".mp4", ".avi", ".mov", ".wmv", ".flv", ".webm", ".css", ".js", ".json", ".xml", ".rss", ".atom", ".woff", ".woff2", ".ttf", ".eot", ".otf",
]
FILE_EXTENSIONS = [".html", ".htm", ".php", ".asp", ".aspx", ".jsp", ".shtml", ".xhtml", ".cfm", ".cgi", ".pl", ".py", ".rb"]
REPORT_PARAMS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "source", "fbclid", "gclid"]
INDEX_FILES = ["/index.html", "/index.htm", "/index.php"]
JUNK_SCHEMES = ["javascript:", "mailto:", "tel:", "data:", "#"]

SKIP_RE = "(?i)(" + "|".join(x.replace(".", r"\.") for x in SKIP_EXTENSIONS) + ")$"
FILE_RE = "(?i)(" + "|".join(x.replace(".", r"\.") for x in FILE_EXTENSIONS) + ")$"
JUNK_RE = "(?i)^(" + "|".join(JUNK_SCHEMES) + ")"


#: White space as Unicode has it, with the separators U+001C to U+001F, as a class of a regular expression.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, RFC3986, 2))


def netloc(url: Column) -> Column:
    """Host and port as written."""
    return F.regexp_extract(url, RFC3986, 4)


def path(url: Column) -> Column:
    return F.regexp_extract(url, RFC3986, 5)


def query(url: Column) -> Column:
    return F.regexp_extract(url, RFC3986, 7)


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, RFC3986, 9)


def domain(url: Column) -> Column:
    """Lower-cased host and port."""
    return F.lower(netloc(url))


def is_valid(url: Column) -> Column:
    return scheme(url).isin("http", "https") & (netloc(url) != "")


def same_domain(a: Column, b: Column) -> Column:
    """Equal hosts, lower-cased and without one leading `www.`."""
    return F.regexp_replace(domain(a), r"^www\.", "") == F.regexp_replace(domain(b), r"^www\.", "")


def joinable_base(base: Column) -> Column:
    """base with a closing slash, unless its last segment looks like a file."""
    p = path(base)
    whole = p.endswith("/") | p.rlike(r"\.[A-Za-z0-9]{1,10}$")
    return F.when(whole, base).otherwise(F.concat(F.regexp_replace(base, r"(?s)[?#].*$", ""), F.lit("/")))


def dot_segments(p: Column) -> Column:
    """RFC 3986 5.2.4 as a fold over the segments."""
    parts = F.split(p, "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc).when(s == "..", F.slice(acc, 1, F.greatest(F.lit(1), F.size(acc) - 1))).otherwise(F.concat(acc, F.array(s))),
    )
    return F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))


def parts(url: Column) -> Column:
    """struct(url, scheme, netloc, path, query), each split off once."""
    return F.struct(url.alias("url"), scheme(url).alias("scheme"), netloc(url).alias("netloc"), path(url).alias("path"), query(url).alias("query"))


def resolve(href: Column, base: Column) -> Column:
    """RFC 3986 5.2: the absolute URL of href in a page at base."""
    return let(parts(base), lambda b: resolve_in(href, b))


def resolve_in(href: Column, base: Column) -> Column:
    """The absolute URL of href in a page whose URL has the `parts` base."""
    has_scheme = href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:")
    has_host = href.startswith("//")
    origin = F.concat(base["scheme"], F.lit("://"), base["netloc"])
    tail = F.regexp_extract(href, r"(?s)([?#].*)$", 1)

    def relative(p: Column) -> Column:
        merged = F.concat(F.regexp_replace(base["path"], "[^/]*$", ""), p)
        merged = F.when(p.startswith("/"), p).otherwise(F.when(merged.startswith("/"), merged).otherwise(F.concat(F.lit("/"), merged)))
        plain = ~merged.contains("/.")  # no dot segment, so nothing to fold
        same = F.when(href.startswith("?"), F.concat(origin, base["path"], tail)).otherwise(F.concat(F.regexp_replace(base["url"], "(?s)#.*$", ""), tail))
        return F.when(p == "", same).otherwise(F.concat(origin, F.when(plain, merged).otherwise(dot_segments(merged)), tail))

    return F.when(has_scheme, href).when(has_host, F.concat(base["scheme"], F.lit(":"), href)).otherwise(let(path(href), relative))


def _coded(x: Column) -> Column:
    """A decoded and re-encoded query component, as form encoding writes it."""
    plain = F.coalesce(F.try_url_decode(x), x)
    return F.replace(F.replace(F.url_encode(plain), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def form_query(q: Column, drop: list[str], ordered: bool = False) -> Column:
    """The query without the parameters in drop (any case), re-encoded; equal keys stand together, in order of first use or sorted."""
    pairs = F.transform(
        F.filter(F.split(q, "&"), lambda p: p != ""),
        lambda p: F.struct(F.coalesce(F.try_url_decode(F.regexp_extract(p, "(?s)^([^=]*)", 1)), F.regexp_extract(p, "(?s)^([^=]*)", 1)).alias("k"), F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1).alias("v")),
    )
    pairs = F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(drop))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    keys = F.array_sort(keys) if ordered else keys
    grouped = F.flatten(F.transform(keys, lambda k: F.filter(pairs, lambda p: p["k"] == k)))
    return F.array_join(F.transform(grouped, lambda p: F.concat(_coded(p["k"]), F.lit("="), _coded(p["v"]))), "&")


def normalize(url: Column, base: Column | None = None, lowercase_path: bool = False, strip_www: bool = False) -> Column:
    """The URL under which a page is known, or null: junk schemes, other protocols, hostless URLs and files that are no pages."""
    return normalize_in(url, None if base is None else parts(joinable_base(base)), lowercase_path, strip_www)


def normalize_in(url: Column, base: Column | None, lowercase_path: bool = False, strip_www: bool = False) -> Column:
    """`normalize`, with the `parts` of the base: split them once a page, not once a link."""
    junk = strip(url).rlike(JUNK_RE)
    u = strip(url)
    if base is not None:
        u = resolve_in(u, base)

    def whole(u: Column) -> Column:
        params = F.regexp_extract(u["path"], "(;[^/]+)$", 1)  # of the last segment; they stay, but are no part of the path
        p = F.regexp_replace(u["path"], ";[^/]*$", "")
        p = F.regexp_replace(F.when(p == "", "/").otherwise(p), "/+", "/")
        p = F.lower(p) if lowercase_path else p
        p = F.when(p == "/", p).otherwise(F.regexp_replace(p, "/+$", ""))
        host = F.regexp_replace(F.lower(u["netloc"]), r"^www\.", "") if strip_www else F.lower(u["netloc"])
        q = F.when(u["query"] == "", "").otherwise(F.concat(F.lit("?"), form_query(u["query"], TRACKING_PARAMS)))
        out = lambda p: F.when(~p.rlike(SKIP_RE), F.concat(u["scheme"], F.lit("://"), host, p, params, F.when(q == "?", "").otherwise(q)))
        return F.when(u["scheme"].isin("http", "https") & (u["netloc"] != ""), let(p, out))

    return F.when(~junk, let(let(u, parts), whole))


def decode_unreserved(text: Column) -> Column:
    """Percent codes of letters, digits and `-._~` decoded, others in upper case; one pass."""
    parts = F.split(text, "%(?=[0-9A-Fa-f]{2})")

    def one(x: Column, i: Column) -> Column:
        code = F.conv(F.substring(x, 1, 2), 16, 10).cast("int")
        plain = F.char(code).rlike(r"^[A-Za-z0-9._~-]$") & (code < 128)
        return F.when(i == 0, x).when(plain, F.concat(F.char(code), F.substr(x, F.lit(3)))).otherwise(F.concat(F.lit("%"), F.upper(F.substring(x, 1, 2)), F.substr(x, F.lit(3))))

    return F.array_join(F.transform(parts, one), "")


def strip_default_port(host: Column, of_scheme: Column) -> Column:
    return F.when(of_scheme == "http", F.regexp_replace(host, ":80$", "")).when(of_scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)


def canonical(url: Column, strip_query: bool = False) -> Column:
    """struct(scheme, host, path, query, raw), or null: no `www.`, default port, parameters or fragment; unreserved codes decoded, dot segments resolved."""
    u = strip(url)
    host = F.regexp_replace(strip_default_port(domain(u), scheme(u)), r"^www\.", "")
    p = decode_unreserved(F.regexp_replace(path(u), ";[^/]*$", ""))
    double = p.rlike("^//[^/]") | (p == "//")  # two leading slashes, and only two, are kept
    kept = F.aggregate(
        F.filter(F.split(p, "/"), lambda s: ~s.isin("", ".")),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
    )
    p = F.concat(F.when(double, "//").otherwise("/"), F.array_join(kept, "/"))
    p = F.when(p == "//", "").otherwise(p)  # then nothing is left but closing slashes, and they go
    q = F.lit("") if strip_query else query(u)
    raw = F.concat(scheme(u), F.lit("://"), host, p, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    whole = F.struct(scheme(u).alias("scheme"), host.alias("host"), p.alias("path"), q.alias("query"), raw.alias("raw"))
    return F.when(~u.rlike(JUNK_RE) & is_valid(u), whole)


def drop_keys(q: Column, keys: list[str]) -> Column:
    """The query without the listed keys (exact case); what is left keeps its bytes."""
    return F.array_join(F.filter(F.split(q, "&"), lambda p: ~F.regexp_extract(p, "(?s)^([^=]*)", 1).isin(keys)), "&") if keys else q


def scope_path(p: Column) -> Column:
    """The directory that a start path stands for: itself, or the parent of a file."""
    bare = F.when(p.isin("", "/"), "/").otherwise(F.regexp_replace(p, "/+$", ""))
    parent = F.regexp_replace(bare, "/[^/]*$", "")
    return F.when(bare.rlike(FILE_RE), F.when(parent == "", "/").otherwise(parent)).otherwise(bare)


def report(url: Column) -> Column:
    """The form in which coverage reports compare URLs."""
    u = strip(url)
    s = F.when(scheme(u) == "", "https").otherwise(scheme(u))
    host = F.regexp_replace(strip_default_port(domain(u), s), r"^www\.", "")
    p = F.regexp_replace(F.regexp_replace(F.regexp_replace(path(u), "/+", "/"), "/$", ""), "(" + "|".join(x.replace(".", r"\.") for x in INDEX_FILES) + ")$", "")
    q = form_query(query(u), REPORT_PARAMS, ordered=True)
    return F.concat(s, F.lit("://"), host, p, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def url_hash(url: Column) -> Column:
    return F.md5(url)


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), netloc(url))


def site_root(url: Column) -> Column:
    """The root of a URL's host."""
    return F.concat(origin(url), F.lit("/"))


def robots_url(url: Column) -> Column:
    return F.concat(origin(url), F.lit("/robots.txt"))


def slug(label: Column) -> Column:
    """The path segment that a navigation label stands for."""
    return F.regexp_replace(F.regexp_replace(F.lower(label), r"\s*&\s*", ""), " ", "")


def output_name(url: Column) -> Column:
    """A file stem from host and path."""
    return F.concat(F.translate(netloc(url), ".:", "__"), F.lit("_"), F.translate(F.substring(path(url), 1, 30), "/", "_"))
