"""Text measures and cleaning as column expressions. White space is Unicode's (`urls.SPACE`)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .urls import SPACE, strip

# Fixed values.
PORTAL_PHRASES = [
    "Restricted Card Content", "It looks like you're not authorized to see the content on this card.", "It looks like you are not authorized to see the content on this card.", "Request Authorization",
    "Missing PO Numbers", "Seems our application is having a small hiccup at the moment.", "Some resources of the application you tried to access failed to load.", "Header Title (Not Shown)",
    "Short Header Subtitle", "Any Group Title 1", "Any Group Title 2", "Collapse Header", "Back to Home", "Personalized:", "Favorite products only", "Hide Legend", "Aggregated view",
    "Customize Home Page", "Accept All Cookies", "Cookie Preferences", "Manage Cookie Preferences", "Get Assistance",
]
VENDOR_PHRASES = [
    "Share on LinkedIn", "Share on X", "Share on Facebook", "Share on Email", "Skip to Content", "Skip to Search", "No matching results", "Try a different search query.", "Search Unavailable",
    "We are making updates to our Search system right now. Please try again later.", "Was this page helpful?", "Tell us how to improve", "© Oracle", "About Oracle", "Contact Us", "Products A-Z",
    "Terms of Use & Privacy", "Ad Choices", "Previous Page", "Next Page",
]


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0))


def token_estimate(count: Column) -> Column:
    """1.3 tokens a word, rounded down."""
    return F.floor(count * 13 / F.lit(10)).cast("int")


def collapse(text: Column) -> Column:
    """All white space to single spaces; this joins paragraphs."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def clean(text: Column, remove_urls: bool = False) -> Column:
    """At most one empty line between paragraphs and one space between words."""
    out = F.regexp_replace(F.regexp_replace(strip(text), r"\n{3,}", "\n\n"), " {2,}", " ")
    return strip(F.regexp_replace(out, f"https?://[^{SPACE}]+", "") if remove_urls else out)


def without_phrases(text: Column, phrases: list[str]) -> Column:
    """text without the phrases, tried in their order, without lines that say only ON or OFF, and with its empty lines squeezed."""
    out = text
    for phrase in phrases:
        out = F.replace(out, F.lit(phrase), F.lit(""))
    out = F.when(text.rlike(quoted(phrases)), out).otherwise(text)  # most texts hold none of them
    out = F.regexp_replace(out, rf"(?m)^[{SPACE}]*(ON|OFF)[{SPACE}]*$", "")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def content_hash(text: Column) -> Column:
    return F.sha2(collapse(text), 256)


def doc_id(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 16)


def chunk_id(of_doc: Column, index: Column) -> Column:
    return F.format_string("%s_%04d", of_doc, index)


def heading_level(entry: Column) -> Column:
    return F.coalesce(F.regexp_extract(entry, r"^H(\d+):", 1).try_cast("int"), F.lit(0))


def table_text(headers: Column, rows: Column) -> Column:
    """A table as lines: headers, a rule, rows; cells joined by ` | `."""
    rule = F.repeat(F.lit("-"), F.aggregate(headers, F.lit(0), lambda n, h: n + F.length(h) + 3))
    lines = F.concat(F.when(F.size(headers) > 0, F.array(F.array_join(headers, " | "), rule)).otherwise(F.array().cast("array<string>")), F.transform(rows, lambda r: F.array_join(r, " | ")))
    return F.array_join(lines, "\n")


def simhash(df: DataFrame, text: str, name: str = "simhash") -> DataFrame:
    """df without `text`, with its 64-bit simhash as 16 hex digits: a bit is set where at least half of the lower-cased words' md5 (its low half) have it, and all are for a text without words.

    One row a word, summed bit by bit: a row's words are in one task, so partial sums meet one row each.
    """
    rest = [c for c in df.columns if c != text]
    rows = df.withColumn("__row", F.monotonically_increasing_id())
    rows = rows.select("__row", *rest, F.explode_outer(words(F.lower(text))).alias("__word"))
    rows = rows.withColumn("__bits", F.conv(F.substring(F.md5("__word"), 17, 16), 16, -10).cast("bigint"))
    sums = [F.sum(F.shiftrightunsigned("__bits", k).bitwiseAND(F.lit(1))).alias(f"__b{k}") for k in range(64)]
    votes = rows.groupBy("__row", *rest).agg(F.count("__word").alias("__n"), *sums)
    bit = lambda k: (F.coalesce(F.col(f"__b{k}"), F.lit(0)) * 2 >= F.col("__n")).cast("int")
    digit = lambda n: F.substring(F.lit("0123456789abcdef"), 1 + bit(4 * n) + 2 * bit(4 * n + 1) + 4 * bit(4 * n + 2) + 8 * bit(4 * n + 3), 1)
    return votes.select(*rest, F.concat(*(digit(n) for n in range(15, -1, -1))).alias(name))


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two 16-digit hex hashes differ."""
    word = lambda x: F.conv(x, 16, -10).cast("bigint")
    return F.bit_count(word(a).bitwiseXOR(word(b)))


def quoted(phrases: list[str]) -> str:
    return "|".join(re.escape(p) for p in phrases)
