"""Packing token sequences: shortest pack first over the length histogram.

One scan tokenises each text, cuts it into pieces of at most `length` ids and keeps only what a
piece is (its place, length and checksum) with its rank among the task's pieces of that length.
The histogram has at most `length` rows; the driver places its lengths longest first, each into the
shortest packs that have room, and counts patterns, not packs. Where no pack has room, new packs
take the length as often as it fits. Patterns become slots (length, ranks, first sequence, offset),
and pieces join them by length and rank. No piece is moved or sorted.

Edge cases: a null or empty text is its end id alone. Rows that repeat a doc_id, or have none, are documents of
their own, and a null id stays null. A special token's string in a text is that token, as in the vocabulary's default
encoding. Extra columns are not carried. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from base64 import b64decode
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH = 2048
END = 1
#: How the public byte-level vocabulary splits text, and its special token.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPECIAL = {"<|endoftext|>": 50256}


@lru_cache(1)
def encoder(path: str):
    """The vocabulary at `path`: a ranks file, or a tokenizers JSON file (the same ids, several times slower)."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        return lambda text: found.encode(text, add_special_tokens=False).ids
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    found = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    whole, special = found.encode_ordinary, set(SPECIAL)
    return lambda text: found.encode(text, allowed_special=special) if any(x in text for x in special) else whole(text)


def pieces(documents: DataFrame, vocabulary: str, length: int = LENGTH) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, and part and rank, which name it among pieces of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, part = encoder(vocabulary), {}, TaskContext.get().partitionId()
        for batch in batches:
            rows, source = [], []
            for i, text in enumerate(batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), END], "<u4")
                for start in range(0, len(ids), length):
                    piece = ids[start : start + length]
                    rank = seen.get(len(piece), 0)
                    seen[len(piece)] = rank + 1
                    rows.append((start, len(piece), zlib.crc32(piece.tobytes()), len(ids), part, rank))
                    source.append(i)
            columns = np.array(rows, np.int64).reshape(-1, 6).T
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(source, pa.int64())), *map(pa.array, columns)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank"])

    return common.map_arrow(documents.select("doc_id", "text"), run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, part bigint, rank bigint")


def patterns(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of the packs that hold the histogram's pieces."""
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    spaces: list[int] = []

    def put(space: int, count: int, pack: tuple[int, ...]) -> None:
        if space not in room:
            room[space] = []
            insort(spaces, space)
        room[space].append((count, pack))

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            if spaces and spaces[-1] >= size:
                space = spaces[-1]
                count, pack = room[space].pop()
                if not room[space]:
                    del room[space]
                    spaces.pop(bisect_left(spaces, space))
                n = min(count, left)
                put(space - size, n, (*pack, size))
                if count > n:
                    put(space, count - n, pack)
                left -= n
            else:
                most = length // size
                if left >= most:
                    put(length - most * size, left // most, (size,) * most)
                if left % most:
                    put(length - left % most * size, 1, (size,) * (left % most))
                left = 0
    return [x for space in spaces for x in room[space]]


def slots(packs: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, offset) for each place in each pattern."""
    out, used, sequence = [], {}, 0
    for count, pack in packs:
        offset = 0
        for size in pack:
            rank = used.get(size, 0)
            used[size] = rank + count
            out.append((size, rank, rank + count, sequence, offset))
            offset += size
        sequence += count
    return out


def pack(documents: DataFrame, vocabulary: str, length: int = LENGTH) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = documents.sparkSession
    rows = common.store(pieces(documents, vocabulary, length), "pieces")
    counts = common.store(rows.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `length` rows at most
    before = counts.selectExpr("part", "length", "coalesce(sum(n) over (partition by length order by part rows between unbounded preceding and 1 preceding), 0) as before")
    places = slots(patterns(histogram, length))
    slot = spark.createDataFrame(places, "slot_length bigint, low bigint, high bigint, first bigint, offset bigint")
    if len(places) <= 100 * length:
        slot = F.broadcast(slot)
    rows = rows.join(before.hint("merge"), ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    rows = rows.join(slot, (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return rows.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")
