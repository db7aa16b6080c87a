"""Sources and exports other than tables: sitemaps, crawl JSON, robots.txt, JSON lines, CSV."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types

from ..functions import text as T

HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


def sitemap(spark: SparkSession, path: str) -> DataFrame:
    """url of every `<loc>` of the sitemaps at path; nested indexes' entries too."""
    schema = types.StructType([types.StructField("loc", types.StringType())])
    read = lambda tag: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    return read("url").unionByName(read("sitemap")).where("loc is not null").select(F.trim("loc").alias("url"))


def crawl_json(spark: SparkSession, path: str) -> DataFrame:
    """url of every page of crawl exports."""
    pages = types.StructType([types.StructField("pages", types.ArrayType(types.StructType([types.StructField("url", types.StringType())])))])
    return spark.read.schema(pages).json(path, multiLine=True).select(F.explode("pages.url").alias("url"))


def url_set(spark: SparkSession, path: str) -> DataFrame:
    """A URL set by its file's ending: .xml a sitemap, .json a crawl, else JSON if it has pages, else a sitemap."""
    if path.endswith(".xml"):
        return sitemap(spark, path)
    found = crawl_json(spark, path)
    return found if path.endswith(".json") or not found.isEmpty() else sitemap(spark, path)


def robots(spark: SparkSession, path: str) -> DataFrame:
    """origin (the file's name without its ending) and robots_text."""
    df = spark.read.text(path, wholetext=True)
    return df.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.txt)?$", 1).alias("origin"), F.col("value").alias("robots_text"))


def topic_map(spark: SparkSession, path: str) -> DataFrame:
    """pretty_url, map_id (the file's name without its ending) and content_id of every node of tables of contents, whatever their depth; nodes lie in `children` and `pageToc`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                waiting = list(reversed(json.loads(text).get("paginatedToc") or []))
                while waiting:
                    node = waiting.pop()
                    if node.get("prettyUrl") and node.get("contentId"):
                        rows.append((node["prettyUrl"], name, str(node["contentId"])))
                    waiting += reversed([*(node.get("children") or []), *(node.get("pageToc") or [])])
            columns = zip(*rows, strict=True) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["pretty_url", "map_id", "content_id"])

    df = spark.read.text(path, wholetext=True)
    return df.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.json)?$", 1).alias("name"), "value").mapInArrow(run, "pretty_url string, map_id string, content_id string")


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line, nulls and non-ASCII characters kept, in parallel part files."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; quotes are doubled, so that line breaks and quotes survive."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def flat_page(links: Column, headings: Column, text: Column, text_chars: int = 10_000, most_links: int = 50) -> dict[str, Column]:
    """The scalar columns of a page's CSV row that need its headings, text and links."""
    return _joined(headings, HEADINGS) | {"text_content": F.substring(text, 1, text_chars), "internal_links_count": F.size(links).cast("bigint"), "internal_links": F.array_join(F.slice(links, 1, most_links), " | ")}


def _joined(headings: Column, levels: tuple[str, ...]) -> dict[str, Column]:
    return {h: F.coalesce(F.array_join(F.element_at(headings, F.lit(h)), " | "), F.lit("")) for h in levels}


def _or(name: str, df: DataFrame, default: object) -> Column:
    return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)


def standard_rows(pages: DataFrame) -> DataFrame:
    """The 19 columns of a page's CSV row. pages: url, title, meta_description, headings, text_content, internal_links, external_links, images and, if it has them, status_code, content_type, crawl_depth, error."""
    flat = flat_page(F.col("internal_links"), F.col("headings"), F.coalesce("text_content", F.lit("")))
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
    columns = {"url": F.col("url"), "title": F.col("title"), "meta_description": F.col("meta_description")} | flat
    columns |= {"external_links_count": count("external_links"), "images_count": count("images"), "status_code": _or("status_code", pages, 200), "content_type": _or("content_type", pages, ""), "word_count": T.word_count(F.col("text_content")).cast("bigint")}
    columns |= {"crawl_depth": _or("crawl_depth", pages, 0), "error": _or("error", pages, "")}
    return pages.select(*(c.alias(k) for k, c in columns.items()))


def deep_rows(pages: DataFrame) -> DataFrame:
    """The 13 columns of a deep crawl's CSV row. pages: url, title, breadcrumb, section_path, headings, text_content, tables, code_blocks, internal_links, depth."""
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
    columns = {"url": F.col("url"), "title": F.col("title"), "breadcrumb": F.array_join("breadcrumb", " > "), "section_path": F.array_join("section_path", " > ")} | _joined(F.col("headings"), HEADINGS[:3])
    columns |= {"text_content": F.substring("text_content", 1, 15_000), "tables_count": count("tables"), "code_blocks_count": count("code_blocks"), "internal_links_count": count("internal_links")}
    return pages.select(*(c.alias(k) for k, c in (columns | {"depth": F.col("depth"), "word_count": T.word_count(F.col("text_content")).cast("bigint")}).items()))


def crawl_export(pages: DataFrame, errors: DataFrame, stats: DataFrame, kind: str, config: dict | None = None, scope_info: dict | None = None, exported_at: str | None = None, hierarchy: DataFrame | None = None) -> DataFrame:
    """A crawl as lines of JSON: (part, position, json). Parts: `head` (one object), `hierarchy` (deep), `pages` and `errors` (an object a row).

    The head of a `standard` export has total_pages, crawl_stats, config and errors_count under `metadata`, with scope_info and exported_at if given; that
    of `deep` and `async` has `stats`. Rows stay rows, so no task holds all pages; `write_crawl` writes the parts as one document.
    """
    lines = lambda df, part: df.select(F.lit(part).alias("part"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))
    record = F.struct(*stats.columns)
    if kind == "standard":
        both = stats.crossJoin(F.broadcast(pages.agg(F.count("*").alias("__pages")))).crossJoin(F.broadcast(errors.agg(F.count("*").alias("__errors"))))  # one row each
        fields = [F.col("__pages").alias("total_pages"), record.alias("crawl_stats"), F.from_json(F.lit(json.dumps(config or {})), "map<string,string>").alias("config")]
        fields += [F.from_json(F.lit(json.dumps(scope_info)), "map<string,string>").alias("scope_info")] if scope_info is not None else []
        fields += [F.col("__errors").alias("errors_count")] + ([F.lit(exported_at).alias("exported_at")] if exported_at else [])
        head = both.select(F.lit("head").alias("part"), F.to_json(F.struct(F.struct(*fields).alias("metadata"))).alias("json"))
    else:
        head = stats.select(F.lit("head").alias("part"), F.to_json(F.struct(record.alias("stats"))).alias("json"))
    out = head.union(lines(pages, "pages")).union(lines(errors, "errors"))
    return out if hierarchy is None or kind != "deep" else out.union(lines(hierarchy, "hierarchy"))


def write_crawl(export: DataFrame, path: str) -> None:
    """The export as JSON lines by part: path/part=head, path/part=pages and so on, written in parallel."""
    export.write.mode("overwrite").partitionBy("part").text(path)


def corpus_json(chunks: DataFrame) -> DataFrame:
    """One JSON document a row: doc_id and its chunks in order."""
    rest = [c for c in chunks.columns if c not in ("doc_id", "chunk_index")]
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", *rest)))
    words = [F.sum("word_count").alias("total_word_count")] if "word_count" in rest else []
    return chunks.groupBy("doc_id").agg(F.to_json(F.struct(F.first("doc_id").alias("doc_id"), F.count("*").alias("total_chunks"), *words, ordered.alias("chunks"))).alias("document"))


def corpus_head(chunks: DataFrame, config: dict | None = None, stats: dict | None = None) -> DataFrame:
    """The head of a corpus export: corpus_stats, crawl_config and crawl_stats, as one JSON object. With `corpus_json` it is the whole corpus; the flat form is the chunks themselves (`write_jsonl`)."""
    totals = chunks.agg(F.count_distinct("doc_id").alias("total_documents"), F.count("*").alias("total_chunks"), F.coalesce(F.sum("word_count"), F.lit(0)).cast("bigint").alias("total_words"))
    given = lambda x: F.from_json(F.lit(json.dumps(x or {})), "map<string,string>")
    return totals.select(F.to_json(F.struct(F.struct(*totals.columns).alias("corpus_stats"), given(config).alias("crawl_config"), given(stats).alias("crawl_stats"))).alias("head"))


def page(pages: DataFrame, url: str) -> DataFrame:
    """The rows of one URL."""
    return pages.where(F.col("url") == url)
