"""Near-duplicate documents: fast similarity sketches, banding, exact verification, connected components.

Sketch (rounds of hashed bin placement): in round i every shingle goes to one of `BINS` bins; a bin
that no earlier round filled takes the smallest value that falls into it. From round BINS on, round
i sends all shingles to bin i - BINS, so every bin fills. BANDS bands of ROWS bins make the candidates.

Texts of one set of shingles form a class, taken by its smallest doc_id; only classes are compared.
Members of a bucket are compared with the bucket's hub, twice with different hubs, so a group of
thousands of near copies costs about one comparison for each member. What then still shares a bucket
with another component is joined exactly: two sets as alike as asked share a shingle among the
rarest few of each (prefix filter), early enough that the rest can suffice (positional filter). Any
fixed order of shingles keeps that exact; a table of COUNTERS hashed counts makes it a rare-first
one. Every candidate is confirmed on the full sets of both texts.

Edge cases: null and empty texts, and texts without words, have an empty set, are linked with
nothing and are their own component. A text of fewer words than a shingle has one shingle, all its
words. Rows that repeat a doc_id share its component. A null doc_id takes its class's component,
or null. Extra columns are not carried by `components` and are all carried by `distinct_documents`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BINS, ROWS = 128, 4
BANDS = BINS // ROWS
HUB_ROUNDS = 2
COUNTERS, BLOCK = 1 << 20, 1 << 16
_ROUND = np.random.default_rng(20170).integers(1, 1 << 63, 2 * BINS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct hashes of its runs of `words` words, A-Z lower-cased."""
    for lo, hi, hashes, first in common.hashed(column):
        # Horner's rule over the words of each run; runs that cross two texts are not used.
        long = max(0, len(hashes) - words + 1)
        runs = np.zeros(long, np.uint64)
        for k in range(words if long else 0):
            runs = common.mix64(runs * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + long])
        for i in range(hi - lo):
            a, b = int(first[i]), int(first[i + 1])
            if b - a >= words:
                yield np.unique(runs[a : b - words + 1])
            elif b > a:
                one = np.uint64(0x51ED270B)
                for h in hashes[a:b]:
                    one = common.mix64(np.array([one]) * np.uint64(0x9E3779B97F4A7C15) + h)[0]
                yield np.array([one], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def sketch(items: np.ndarray) -> np.ndarray:
    """BINS values; each is filled, and two sets share a bin's value with the probability of their Jaccard similarity."""
    out = np.zeros(BINS, np.uint64)
    empty = np.ones(BINS, bool)
    i = 0
    while i < 2 * BINS and empty.any():
        h = common.mix64((items ^ np.uint64(i)) * _ROUND[i])
        if i < BINS:
            bins = (h >> np.uint64(64 - 7)).astype(np.int64)
            low = np.full(BINS, np.uint64(0xFFFFFFFFFFFFFFFF))
            np.minimum.at(low, bins, h << np.uint64(7))
            hit = np.zeros(BINS, bool)
            hit[bins] = True
            hit &= empty
            out[hit] = low[hit] + np.uint64(i + 1)
            empty &= ~hit
        elif empty[i - BINS]:
            out[i - BINS] = h.min() + np.uint64(i + 1)
            empty[i - BINS] = False
        i += 1
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """BANDS keys, each of ROWS bins and the band's number."""
    rows = values.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = common.mix64(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key


def signatures(documents: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, set_id (16 bytes; null for an empty set) and bands (BANDS packed keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ids, bands = [], [], []
            for items in shingle_sets(batch.column(1), words):
                sizes.append(len(items))
                ids.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None)
                bands.append(band_keys(sketch(items)).view(np.int64) if len(items) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_id", "bands"])

    return common.map_arrow(documents.select(F.col("doc_id").cast("bigint"), "text"), run, "doc_id bigint, n_shingles bigint, set_id binary, bands array<bigint>")


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union. texts: (doc_id, text), one row an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_set = None, np.zeros(0, np.uint64)
        for batch in batches:
            keep, ids = [], batch.column(0).to_pylist()
            for i, mine in enumerate(shingle_sets(batch.column(3), words)):
                if ids[i] != hub:
                    hub, hub_set = ids[i], next(shingle_sets(batch.column(2).slice(i, 1), words))
                both = len(np.intersect1d(hub_set, mine, assume_unique=True))
                keep.append(100 * both >= percent * (len(hub_set) + len(mine) - both) and both > 0)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("b_text")), "b")
    both = both.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("a_text")), "a")
    return common.map_arrow(both.select("a", "b", "a_text", "b_text"), run, "a bigint, b bigint")


def stars(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of `edges` (a, b) reaches. Alternates large-star and small-star steps."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    before, done = None, []
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = common.store(large.union(edges.groupBy("u").agg(F.min("v").alias("v"))).distinct(), "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = common.store(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        common.drop(edges.sparkSession, *done, large)
        done = [edges]
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now


def shingle_counts(texts: DataFrame, words: int) -> np.ndarray:
    """Counts of hashed shingles over all texts: COUNTERS numbers (4 MB), summed by block before the driver gets them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(COUNTERS, np.int32)
        for batch in batches:
            for items in shingle_sets(batch.column(0), words):
                table += np.bincount((items % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS).astype(np.int32) if len(items) > BLOCK else 0
                if len(items) <= BLOCK:
                    np.add.at(table, (items % np.uint64(COUNTERS)).astype(np.int64), 1)
        full = [k for k in range(COUNTERS // BLOCK) if table[k * BLOCK : (k + 1) * BLOCK].any()]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([table[k * BLOCK : (k + 1) * BLOCK].tobytes() for k in full], pa.binary())], names=["block", "counts"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BLOCK, np.int32)
        for batch in batches:
            for raw in batch.column("counts").to_pylist():
                total += np.frombuffer(raw, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "counts"])

    out = np.zeros(COUNTERS, np.int32)
    for r in common.map_arrow(texts.select("text"), count, "block int, counts binary").groupBy("block").applyInArrow(add, "block int, counts binary").collect():
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["counts"], np.int32)
    return out


def prefixes(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(shingle, rep, n, at, component): the rarest shingles of each text, as many as the prefix filter takes, and their places."""
    counts = texts.sparkSession.sparkContext.broadcast(shingle_counts(texts, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                kept, sizes = [], []
                for items in shingle_sets(batch.column(2), words):
                    n = len(items)
                    rare = items[np.lexsort((items, counts.value[(items % np.uint64(COUNTERS)).astype(np.int64)]))]
                    kept.append(rare[: n + (-percent * n // 100) + 1])
                    sizes.append(n)
                long = np.array([len(x) for x in kept])
                row = np.repeat(np.arange(len(kept)), long)
                place = np.arange(len(row)) - np.repeat(np.cumsum(long) - long, long)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(kept).view(np.int64)), batch.column(0).take(pa.array(row)), pa.array(np.array(sizes)[row]), pa.array(place), batch.column(1).take(pa.array(row))],
                    names=["shingle", "rep", "n", "at", "component"],
                )

    return common.map_arrow(texts.select("rep", "component", "text"), run, "shingle bigint, rep bigint, n bigint, at bigint, component bigint")


def links(documents: DataFrame, signed: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(classes, edges): a representative (rep) of each set of shingles, and enough verified links between them to join what belongs together."""
    classes = common.store(signed.where("set_id is not null and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes")
    rows = classes.select("rep", "n", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").drop("members")
    members = common.store(rows.join(shared, "key"), "members")
    ids = members.select(F.col("rep").alias("doc_id")).distinct()
    texts = common.store(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(ids, "doc_id", "left_semi"), "texts")
    near = F.expr(f"100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)")
    edges, tried, apart = None, None, members.withColumn("component", F.col("rep"))
    for turn in range(HUB_ROUNDS + 1):
        if turn < HUB_ROUNDS:
            order = F.col("rep") if turn == 0 else F.xxhash64("rep", F.lit(turn))
            hubs = apart.groupBy("key").agg(F.min_by(F.struct("rep", "n", "component"), F.struct(order, "rep")).alias("hub"))
            pairs = apart.join(hubs, "key").where("component <> hub.component").withColumn("hub_n", F.col("hub.n")).where(near)
            pairs = pairs.select(F.least("rep", "hub.rep").alias("a"), F.greatest("rep", "hub.rep").alias("b"))
        else:
            of = apart.select("rep", "component").distinct()
            rare = common.store(prefixes(texts.join(of, texts["doc_id"] == of["rep"]), words, percent), "prefixes")
            mixed = rare.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("shingle")
            rare = rare.join(mixed, "shingle")
            other = rare.toDF("shingle", "hub", "hub_n", "hub_at", "hub_component")
            enough = F.expr(f"{100 + percent} * least(n - at, hub_n - hub_at) >= {percent} * (n + hub_n)")
            pairs = rare.join(other, "shingle").where("component < hub_component").where(near & enough).select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"))
        pairs = pairs.distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = common.store(pairs, "pairs")
        tried = pairs if tried is None else tried.union(pairs)
        fresh = common.store(verified(pairs, texts, words, percent), "edges")
        edges = fresh if edges is None else edges.union(fresh)
        if turn < HUB_ROUNDS:
            known = stars(edges)
            now = members.join(known, members["rep"] == known["node"], "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("component"))
            mixed = now.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
            apart = common.store(now.join(mixed, "key", "left_semi"), "apart")
            if apart.isEmpty():
                break
    return classes, edges


def components(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of documents."""
    signed = common.store(signatures(documents, words), "signed")
    classes, edges = links(documents, signed, words, percent)
    of_set = classes.select("set_id", "rep").join(stars(edges), F.col("rep") == F.col("node"), "left").select("set_id", F.coalesce("component", "rep").alias("component"))
    found = signed.drop("bands").join(of_set, "set_id", "left")
    return found.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(False)).alias("kept"))


def distinct_documents(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, with all columns: the one whose doc_id is the component's.

    Rows that repeat a kept doc_id and its text shrink to one. Rows without an id stay: none can stand for a group.
    Only ids that go are joined, as they are fewer than those that stay.
    """
    found = common.store(components(documents, words, percent).where("doc_id is not null").groupBy("doc_id").agg(F.count_if("kept").alias("kept")), "kept")
    gone = common.store(found.where("kept = 0").select(F.col("doc_id").alias("__gone")), "gone")
    kept = documents.join(gone, documents["doc_id"] == gone["__gone"], "left_anti")
    if found.where("kept > 1").isEmpty():
        return kept
    return kept.where(documents["doc_id"].isNotNull()).dropDuplicates(["doc_id", "text"]).unionByName(kept.where(documents["doc_id"].isNull()))
