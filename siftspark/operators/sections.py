"""Retrieval documents: sections at known headings, heading paths, chunks of text, tables and code."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunking import LEAST, MOST, OVERLAP, TARGET


_NETLOC = re.compile(r"(?s)(?:[^:/?#]+:)?(?://([^/?#]*))?")


def split_sections(text: str, headings: list[tuple[str, list[str]]]) -> list[tuple[int, str, str]]:
    """(level, heading, body). Every literal occurrence of a heading starts a section; of overlapping ones the first, then the higher level, counts."""
    known = [(int(h[1]), t.strip()) for h, ts in sorted(headings) for t in ts if t.strip()]
    spots = sorted(((m.start(), i, m.end()) for i, (_, t) in enumerate(known) for m in re.finditer(re.escape(t), text)), key=lambda s: s[:2])
    marks, free = [], 0
    for start, i, end in spots:
        if start >= free:
            marks.append((start, end, i))
            free = end
    if not marks:
        return [(0, "", text)]
    out = [(0, "", text[: marks[0][0]].strip())] if text[: marks[0][0]].strip() else []
    stops = [m[0] for m in marks[1:]] + [len(text)]
    return out + [(*known[i], text[end:stop].strip()) for (_, end, i), stop in zip(marks, stops, strict=True)]


def chunk(text: str, target: int = TARGET, most: int = MOST, overlap: int = OVERLAP, least: int = LEAST) -> list[str]:
    """The chunks of a text as ranges of its words (the Arrow twin of `chunking.chunks`)."""
    words = text.split()
    if len(words) <= most:
        return [text.strip()] if len(words) >= least else []
    sizes = []
    for part in filter(str.strip, text.split("\n\n")):
        n = len(part.split())
        sizes += [len(s.split()) for s in re.split(r"(?<=[.!?])\s+", part.strip())] if n > most else [n]
    lo = hi = 0
    out = []
    for n in [*sizes, None]:
        if hi > lo and (n is None or hi - lo + n > target):
            if hi - lo >= least:
                out.append(" ".join(words[lo:hi]))
            lo = max(lo, hi - overlap)
        hi += n or 0
    return out


def table_text(headers: list[str], rows: list[list[str]]) -> str:
    lines = [" | ".join(headers), "-" * sum(len(h) + 3 for h in headers)] if headers else []
    return "\n".join(lines + [" | ".join(r) for r in rows])


CHUNK = pa.schema([
    ("doc_id", pa.string()), ("chunk_id", pa.string()), ("chunk_index", pa.int32()), ("source_url", pa.string()), ("parent_url", pa.string()), ("crawl_timestamp", pa.string()), ("domain", pa.string()), ("page_title", pa.string()), ("section_title", pa.string()),
    ("heading_path", pa.list_(pa.string())), ("breadcrumb", pa.list_(pa.string())), ("depth", pa.int32()), ("chunk_type", pa.string()), ("content", pa.string()), ("content_html", pa.string()), ("word_count", pa.int32()), ("char_count", pa.int32()), ("token_estimate", pa.int32()), ("metadata", pa.map_(pa.string(), pa.string())),
])
CHUNK_DDL = "doc_id string, chunk_id string, chunk_index int, source_url string, parent_url string, crawl_timestamp string, domain string, page_title string, section_title string, heading_path array<string>, breadcrumb array<string>, depth int, chunk_type string, content string, content_html string, word_count int, char_count int, token_estimate int, metadata map<string,string>"


def document(url: str, title: str, headings: list, text: str, tables: list, code: list[str], parent: str = "", stamp: str = "", breadcrumb: list[str] | None = None, section_path: list[str] | None = None, depth: int = 0) -> Iterator[dict]:
    """The chunks of one page, numbered through text, tables and code. A section without text still changes the heading path; a page without a breadcrumb has its section path there."""
    path: list[tuple[int, str]] = []
    parts: list[tuple[str, str, list[str], str, list]] = []
    clean = re.sub(" {2,}", " ", re.sub(r"\n{3,}", "\n\n", text.strip())).strip()
    for level, heading, body in split_sections(clean, headings):
        if heading:
            path = [p for p in path if p[0] < level] + [(level, f"H{level}: {heading}")]
        parts += [("text", heading or title, [p[1] for p in path], c, []) for c in chunk(body)]
    own = [p[1] for p in path]
    parts += [("table", "Table", own, c, [("headers", " | ".join(t["headers"] or []))]) for t in tables if len((c := table_text(t["headers"] or [], t["rows"] or [])).split()) >= LEAST]
    parts += [("code", "Code Block", own, c, []) for c in code if len(c.split()) >= LEAST]
    shared = {"source_url": url, "parent_url": parent, "crawl_timestamp": stamp, "domain": _NETLOC.match(url)[1] or "", "page_title": title, "breadcrumb": breadcrumb or section_path or [], "depth": depth, "content_html": ""}
    name = hashlib.sha256(url.encode()).hexdigest()[:16]
    for i, (kind, section, trail, content, metadata) in enumerate(parts):
        n = len(content.split())
        yield {"doc_id": name, "chunk_id": f"{name}_{i:04d}", "chunk_index": i, **shared, "section_title": section, "heading_path": trail, "chunk_type": kind, "content": content, "word_count": n, "char_count": len(content), "token_estimate": n * 13 // 10, "metadata": metadata}


_PAGE = {"url": "", "title": "", "headings": [], "text": "", "tables": [], "code_blocks": [], "parent_url": "", "crawl_timestamp": "", "breadcrumb": [], "section_path": [], "depth": 0}


def _rows(parsed: DataFrame) -> DataFrame:
    """The columns of `document`'s arguments in their order; those that parsed lacks are null."""
    types = {"parent_url": "string", "crawl_timestamp": "string", "breadcrumb": "array<string>", "section_path": "array<string>", "depth": "int"}
    return parsed.select(*(F.col(c) if c in parsed.columns else F.lit(None).cast(types[c]).alias(c) for c in _PAGE))


def rag_chunks(parsed: DataFrame) -> DataFrame:
    """The chunks of all pages of `extract.parsed`, with parent_url, crawl_timestamp, breadcrumb, section_path and depth if it has them. Row by row, without a shuffle; nulls count as empty. A page that cannot be cut has no chunks (see `chunk_errors`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 128):
                rows = [c for r in whole.slice(lo, 128).to_pylist() for c in attempted(r)[0]]
                yield pa.RecordBatch.from_pylist(rows, CHUNK)

    return _rows(parsed).mapInArrow(run, CHUNK_DDL)


def attempted(row: dict) -> tuple[list[dict], str | None]:
    """(chunks, None) of a page, or ([], what went wrong)."""
    try:
        return list(document(*(row[c] if row[c] is not None else default for c, default in _PAGE.items()))), None
    except Exception as error:  # one page does not stop the others
        return [], f"{type(error).__name__}: {error}"


def chunk_errors(parsed: DataFrame) -> DataFrame:
    """url and error of the pages that cannot be cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 128):
                found = [(r["url"], error) for r in whole.slice(lo, 128).to_pylist() if (error := attempted(r)[1])]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in range(2)], names=["url", "error"])

    return _rows(parsed).mapInArrow(run, "url string, error string")
