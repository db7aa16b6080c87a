"""Link graph traversal: level-synchronous breadth-first search, depth-first order, section hierarchy."""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import shared_dir


def _stored(df: DataFrame) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/bfs-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, order: list[str], name: str, first: int = 0) -> DataFrame:
    """df with its rank in the order, from `first`: ranges are sorted apart, and each range's first rank is the number of rows before it."""
    parts = _stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    before, starts = first, []
    for r in parts.groupBy(part.alias("p")).count().orderBy("p").collect():  # one row a partition
        starts.append((r["p"], before))
        before += r["count"]
    if not starts:
        return parts.drop("__id").withColumn(name, F.lit(0).cast("bigint"))
    start = F.broadcast(df.sparkSession.createDataFrame(starts, "__p bigint, __start bigint"))
    return parts.join(start, part == F.col("__p")).withColumn(name, F.col("__start") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__id", "__p", "__start")


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int, max_pages: int | None = None) -> DataFrame:
    """node, depth, parent and disc_order of every node within max_depth of the seeds.

    edges: src, pos, dst. seeds: node. A node is discovered by the first link to it, in order of its
    page's discovery and then of the link's place, as a first-in-first-out queue would. Each level is
    stored, so a lost executor repeats one level at most; a level's only driver value is its count.
    max_pages keeps the first so many in order of discovery, which a queue would visit.
    """
    seen = ranked(seeds.select("node").distinct().select("node", F.lit(0).alias("depth"), F.lit(None).cast(seeds.schema["node"].dataType).alias("parent")), ["node"], "disc_order")
    seen = _stored(seen.select("node", "depth", "parent", F.col("disc_order").cast("bigint")))
    frontier, total = seen, seen.count()
    levels = [seen]
    for depth in range(1, max_depth + 1):
        found = frontier.join(edges, F.col("node") == F.col("src")).groupBy("dst").agg(F.min(F.struct("disc_order", "pos", "src")).alias("by"))
        for level in levels:  # each level is stored once; a node is in one of them at most
            found = found.join(level.select(F.col("node").alias("__seen")), F.col("dst") == F.col("__seen"), "left_anti")
        placed = ranked(found.select(F.col("dst").alias("node"), F.lit(depth).alias("depth"), F.col("by.src").alias("parent"), F.col("by.disc_order").alias("__of"), F.col("by.pos").alias("__pos")), ["__of", "__pos"], "disc_order", total)
        frontier = _stored(placed.select("node", "depth", "parent", F.col("disc_order").cast("bigint")))
        n = frontier.count()
        if not n:
            break
        levels.append(frontier)
        total += n
        if max_pages is not None and total >= max_pages:
            break
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out if max_pages is None else out.where(F.col("disc_order") < max_pages)


def crawl(edges: DataFrame, seeds: DataFrame, max_depth: int, max_pages: int, skipped: DataFrame | None = None) -> DataFrame:
    """The pages that a crawl visits: node, depth, parent, disc_order, skipped, of the breadth-first order until max_pages that are not skipped have been visited.

    Skipped pages (node) are visited and expanded, but do not count.
    """
    found = bfs(edges, seeds, max_depth)
    marks = (skipped if skipped is not None else seeds.limit(0)).select(F.col("node").alias("__skipped")).distinct()
    found = _stored(found.join(marks, F.col("node") == F.col("__skipped"), "left").select("node", "depth", "parent", "disc_order", F.col("__skipped").isNotNull().alias("skipped")))
    good = ranked(found.where("not skipped").select("disc_order"), ["disc_order"], "__rank")
    last = good.where(F.col("__rank") == max_pages - 1).select("disc_order").first()  # a single value
    return found if last is None else found.where(F.col("disc_order") <= last["disc_order"])


def bfs_depths(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """node and depth only, without a global order: nothing is gathered in one task."""
    seen = frontier = _stored(seeds.distinct().select("node", F.lit(0).alias("depth")))
    for depth in range(1, max_depth + 1):
        found = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = _stored(found.join(seen, "node", "left_anti").select("node", F.lit(depth).alias("depth")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def dfs_order(edges: DataFrame, group: str, max_depth: int) -> DataFrame:
    """Per group (its smallest src is the start): node, depth and visit order of a depth-first walk that marks nodes when it pushes them.

    The walk is sequential by definition, so a group's edges meet in one task; groups are hosts or seeds.
    """

    def walk(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict = {}
        for batch in batches:
            for src, pos, dst in zip(*(batch.column(c).to_pylist() for c in ("src", "pos", "dst")), strict=True):
                out.setdefault(src, []).append((pos, dst))
        start = min(out)
        stack, marked, rows = [(start, 0)], {start}, []
        while stack:
            node, depth = stack.pop()
            rows.append((node, depth))
            fresh = []
            for _, dst in sorted(out.get(node, ())) if depth < max_depth else ():
                if dst not in marked:
                    marked.add(dst)
                    fresh.append((dst, depth + 1))
            stack.extend(reversed(fresh))
        nodes, depths = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(rows)), pa.array(nodes), pa.array(depths, pa.int32()), pa.array(range(len(rows)), pa.int64())], names=[group, "node", "depth", "visit"])

    kind = edges.schema["src"].dataType.simpleString()
    return edges.groupBy(group).applyInArrow(walk, f"{group} {edges.schema[group].dataType.simpleString()}, node {kind}, depth int, visit bigint")


def queue_walk(edges: DataFrame, group: str, max_depth: int, max_pages: int, most_queued: int) -> DataFrame:
    """Per group (its smallest src is the start): node, depth, parent and visit order of a breadth-first crawl with a bounded queue.

    A page adds no links while `most_queued` pages or more wait; links beyond a node are dropped, not kept for later. The
    crawl ends after max_pages. Whether a link is dropped depends on all visits before it, so a group's edges meet in one task.
    """

    def walk(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict = {}
        for batch in batches:
            for src, pos, dst in zip(*(batch.column(c).to_pylist() for c in ("src", "pos", "dst")), strict=True):
                out.setdefault(src, []).append((pos, dst))
        start = min(out)
        queue, marked, rows = deque([(start, 0, None)]), {start}, []
        while queue and len(rows) < max_pages:
            node, depth, parent = queue.popleft()
            rows.append((node, depth, parent))
            if depth >= max_depth or len(queue) >= most_queued:
                continue
            for _, dst in sorted(out.get(node, ())):
                if dst not in marked:
                    marked.add(dst)
                    queue.append((dst, depth + 1, node))
        nodes, depths, parents = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(rows)), pa.array(nodes), pa.array(depths, pa.int32()), pa.array(parents, pa.array(nodes).type), pa.array(range(len(rows)), pa.int64())], names=[group, "node", "depth", "parent", "visit"])

    kind = edges.schema["src"].dataType.simpleString()
    return edges.groupBy(group).applyInArrow(walk, f"{group} {edges.schema[group].dataType.simpleString()}, node {kind}, depth int, parent {kind}, visit bigint")


def hierarchy(pages: DataFrame, sections: str, url: str) -> DataFrame:
    """For every prefix of each page's section path: path, level and number of pages. Prefixes are counted before they are shuffled. `hierarchy_pages` lists the pages."""
    steps = F.transform(F.sequence(F.lit(1), F.size(sections)), lambda n: F.struct(F.array_join(F.slice(sections, F.lit(1), n), " > ").alias("path"), n.alias("level")))
    rows = pages.where(F.size(sections) > 0).select(F.explode(steps).alias("s"), url)
    return rows.groupBy("s.path", "s.level").agg(F.count("*").alias("pages"), F.min(url).alias("first_url"))


def hierarchy_pages(pages: DataFrame, sections: str, url: str) -> DataFrame:
    """path, level and url of each page under every prefix of its section path: a row a page, so no section is gathered."""
    steps = F.transform(F.sequence(F.lit(1), F.size(sections)), lambda n: F.struct(F.array_join(F.slice(sections, F.lit(1), n), " > ").alias("path"), n.alias("level")))
    return pages.where(F.size(sections) > 0).select(F.explode(steps).alias("s"), F.col(url).alias("url")).select("s.path", "s.level", "url")


def inherited(paths: DataFrame) -> DataFrame:
    """(node, parent, section_path) with empty paths taken from the nearest ancestor that has one.

    Pointers double, so a chain of n pages takes log n joins. A circle of empty pages stays empty.
    """
    known = _stored(paths.select("node", F.coalesce("section_path", F.array().cast("array<string>")).alias("section_path"), F.col("parent").alias("up")))
    for _ in range(64):
        if known.where("size(section_path) = 0 and up is not null").isEmpty():
            break
        other = known.toDF("__node", "__path", "__up")
        empty = F.col("up").isNotNull() & (F.size("section_path") == 0)
        both = known.join(other, empty & (F.col("up") == F.col("__node")), "left")
        known = _stored(both.select("node", F.when(empty, F.coalesce("__path", "section_path")).otherwise(F.col("section_path")).alias("section_path"), F.when(empty, F.col("__up")).otherwise(F.col("up")).alias("up")))
    return known.select("node", "section_path")
