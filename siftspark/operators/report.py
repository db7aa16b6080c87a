"""A corpus as blocks of a printed report: titles, section headings, paragraphs, tables, code. A renderer writes them as they come.

Edge cases: null contents are empty and give no paragraph; a document without chunks has no blocks; a
heading path without a level counts as level 1. Extra columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U

TITLE, SECTION, CODE, BUDGET = 120, 100, 5_000, 20_000
TRUNCATED = "[... content truncated ...]"


def paragraphs(text: Column) -> Column:
    """The stripped paragraphs of a text."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), U.strip), lambda p: p != "")


def slices(text: Column, most: int = 15_000, size: int = 2_000) -> Column:
    """The first `most` characters of a text in pieces of `size`."""
    n = F.least(F.length(F.coalesce(text, F.lit(""))), F.lit(most))
    starts = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substr(text, i * size + 1, F.least(F.lit(size), n - i * size)))


def table_rows(text: Column) -> Column:
    """Rows of cells of a table's text; lines of rules and blank lines go, the first row left is the header."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), U.strip), lambda x: ~x.rlike(r"^[-| +]*$"))
    cells = F.transform(lines, lambda x: F.filter(F.transform(F.split(x, r"\|"), U.strip), lambda c: c != ""))
    return F.filter(cells, lambda r: F.size(r) > 0)


def headed_blocks(text: Column, headings: Column) -> Column:
    """array<struct<kind, level, text>>: paragraphs that equal a known heading are headings one level below it (6 at most)."""

    known = F.array(*(F.transform(F.coalesce(F.element_at(headings, F.lit(f"h{k}")), F.array().cast("array<string>")), U.strip) for k in range(1, 7)))

    def block(levels: Column, p: Column) -> Column:
        level = F.greatest(*(F.when(F.array_contains(levels[k], p), F.lit(k + 1)) for k in range(6)))  # of the levels that have this heading the deepest
        heading = F.struct(F.lit("heading").alias("kind"), F.least(level + 1, F.lit(6)).alias("level"), F.substring(p, 1, SECTION).alias("text"))
        return F.when(level.isNotNull(), heading).otherwise(F.struct(F.lit("text").alias("kind"), F.lit(0).alias("level"), p.alias("text")))

    return U.let(known, lambda levels: F.transform(paragraphs(text), lambda p: block(levels, p)))


def document_blocks(chunks: DataFrame, budget: int = BUDGET) -> DataFrame:
    """doc_id, block_no, kind, level, text of the chunks (doc_id, chunk_index, page_title, section_title, heading_path, chunk_type, content).

    A section's heading stands where the section changes and is not the page's title. A chunk is printed while
    the paragraphs before it have fewer than `budget` characters; the first that is not leaves a mark.
    """
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    df = chunks.select("doc_id", "chunk_index", F.coalesce("page_title", F.lit("")).alias("page"), F.coalesce("section_title", F.lit("")).alias("section"), F.get("heading_path", F.size("heading_path") - 1).alias("deepest"), "chunk_type", F.coalesce("content", F.lit("")).alias("content"))
    prose = ~F.col("chunk_type").isin("table", "code")
    df = df.withColumn("chars", F.when(prose, F.aggregate(paragraphs(F.col("content")), F.lit(0), lambda n, p: n + F.length(p))).otherwise(0))
    own = F.when((F.col("section") != "") & (F.col("section") != F.col("page")), F.col("section"))
    df = df.withColumn("own", own).withColumn("used", F.coalesce(F.sum("chars").over(before), F.lit(0))).withColumn("last", F.last("own", ignorenulls=True).over(before))
    df = df.withColumn("stops", F.count_if(F.col("used") >= budget).over(before)).withColumn("i", F.row_number().over(w)).where("stops = 0")
    block = lambda kind, level, text: F.struct(F.lit(kind).alias("kind"), level.cast("int").alias("level"), text.alias("text"))
    none = F.array().cast("array<struct<kind:string,level:int,text:string>>")
    title = F.when(F.col("i") == 1, F.array(block("title", F.lit(1), F.substring("page", 1, TITLE)))).otherwise(none)
    level = F.greatest(F.lit(2), F.least(F.lit(6), T.heading_level(F.coalesce("deepest", F.lit(""))) + 1))
    new = F.col("own").isNotNull() & ~F.col("own").eqNullSafe(F.col("last"))
    heading = F.when(new, F.array(block("heading", level, F.substring("own", 1, SECTION)))).otherwise(none)
    body = (
        F.when(F.col("chunk_type") == "table", F.array(block("table", F.lit(0), F.col("content"))))
        .when(F.col("chunk_type") == "code", F.array(block("code", F.lit(0), F.substring("content", 1, CODE))))
        .otherwise(F.transform(paragraphs(F.col("content")), lambda p: block("text", F.lit(0), p)))
    )
    printed = F.when(F.col("used") >= budget, F.concat(title, F.array(block("truncated", F.lit(0), F.lit(TRUNCATED))))).otherwise(F.concat(title, heading, body))
    rows = df.select("doc_id", "chunk_index", F.posexplode(printed).alias("pos", "b"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index", "pos")) - 1
    return rows.select("doc_id", number.alias("block_no"), "b.kind", "b.level", "b.text")
