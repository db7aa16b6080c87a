"""Language-model scores from a log-frequency Bloom filter.

The model, over all training texts: exact counts of tokens (dealt by hash over shards), and of runs of two
and three tokens. Runs are kept from MIN_COUNT occurrences on: what one text alone says would score that
text by itself. A run, the number of times its context (all but its last token) was followed by a kept run, and
the number of different tokens that followed it are items of the filter; an item of count c is put in with levels
1..1+floor(log_1.5 c), and a count is read back by probing levels until one is missing. Blocks of the filter
have LEVEL_BITS bits for each level they hold, so the share of false positives (0.7% of probes of a
level) depends neither on the size of the corpus nor on how its tokens are dealt. Scores are Witten-Bell, interpolated
from the token up: p1(c) = (n(c) + 1) / (N + V + 1); p2(c|b) = (n(bc) + t(b) p1) / (n(b) + t(b)), and
p3(c|ab) from p2 alike; a context without kept runs leaves the shorter one's probability.

The filter grows with the corpus, so it is never gathered or sent to all workers: texts' runs go to the blocks of
their middle tokens' sections, which hold all that a token needs, and the sums of their logarithms come back to
buckets of neighbouring texts.
A section of more than SECTION_TOKENS training tokens is split by the token before the
middle one: a cell has the runs of three of its own contexts, and a copy of the section's block of pairs. Equal
runs of a text travel once.

The exact base score takes exact counts: those of the HEADS / shards most frequent tokens of each shard are
broadcast (HEADS tokens in all, 5 MB), other tokens of a text meet their counts in their shard first.

Edge cases: null and empty texts are one end token. Rows that repeat an id are scored by themselves;
a row with a null id is learnt from. With no training texts
all counts are 0. Extra columns are not carried. The documents are read more than once and their rows
told apart by their places, so they must come in the same order each time, as stored tables do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MOD, HELD_OUT = 7, 2
MIN_COUNT = 2
MIN_SHARDS, MAX_SHARDS, SHARD_DOCUMENTS = 64, 4096, 4096
HEADS = 1 << 18
MIN_BITS, LEVEL_BITS, PROBES, BASE = 1 << 10, 12, 4, 1.5
SECTION_TOKENS, CHUNK = 3_000_000, 1 << 19
FLUSH, RUN_FLUSH, MERGE = 3_000_000, 1_500_000, 2_000_000
BUCKET_BITS = 14
FIRST_BITS, SECOND_BITS = 24, 24
KEY_BITS = FIRST_BITS + SECOND_BITS
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_END, _START = np.uint64(0xE4D0FE4D0FE4D0F1), np.uint64(0x57A2757A2757A275)
_RUN, _FOLLOWED, _TYPES = (np.uint64(x) for x in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x9B05688C2B3E6C1F))
_LEVEL_COUNTS = np.concatenate(([0.0], BASE ** (np.arange(0, 64) + 0.5)))
_LEVEL_COUNTS[1:3] = 1, 2


def _levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / np.log(BASE) + 1e-9).astype(np.int64)


def _spots(items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First spot and step of each item, before they are scaled to a block's size."""
    mixed = common.mix64(items)
    return mixed, (mixed << np.uint64(32) | mixed >> np.uint64(32)) | np.uint64(1)


def _spot(first: np.ndarray, step: np.ndarray, number: int, bits: int) -> np.ndarray:
    return ((first + step * np.uint64(number)) >> np.uint64(32)) * np.uint64(bits) >> np.uint64(32)


def block(items: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bits, as bytes, of a block that holds the items with their counts."""
    top = _levels(counts) if len(counts) else np.zeros(0, np.int64)
    bits = max(MIN_BITS, (LEVEL_BITS * int(top.sum()) + 7) // 8 * 8)
    out = np.zeros(bits, bool)
    first, step = _spots(items)
    level = 1
    while len(first):
        for probe in range(PROBES):
            out[_spot(first, step, level * PROBES + probe, bits).astype(np.int64)] = True
        level += 1
        more = top >= level
        first, step, top = first[more], step[more], top[more]
    return np.packbits(out, bitorder="little")


class Filter:
    """A block of the filter; `counts` probes it."""

    def __init__(self, raw: bytes | None) -> None:
        self.block = np.frombuffer(raw, np.uint8) if raw else np.zeros(1, np.uint8)

    def counts(self, items: np.ndarray) -> np.ndarray:
        """The count of each item as far as its levels are found; never below the stored one's level."""
        found = np.zeros(len(items), np.int64)
        active, level, bits = np.arange(len(items)), 1, 8 * len(self.block)
        first, step = _spots(items)
        while len(active) and level < 64:
            for probe in range(PROBES):
                at = _spot(first, step, level * PROBES + probe, bits).astype(np.int64)
                hit = (self.block[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
                active, first, step = active[hit], first[hit], step[hit]
            found[active] = level
            level += 1
        return _LEVEL_COUNTS[found]

    def contexts(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(times followed, types, which of them each name is) of named contexts. One type is not stored."""
        names, which = np.unique(names, return_inverse=True)
        followed = self.counts(names ^ _FOLLOWED)
        some = np.flatnonzero(followed > 1)
        types = np.ones(len(names))
        types[some] = np.maximum(1, self.counts(names[some] ^ _TYPES))
        return followed, types, which


def _high(hashes: np.ndarray, n: int) -> np.ndarray:
    """Which of n (a power of two) equal parts of the hashes each is in."""
    return hashes >> np.uint64(64 - (n.bit_length() - 1)) if n > 1 else np.zeros(len(hashes), np.uint64)


def _key(first: np.ndarray, second: np.ndarray, sections: int) -> np.ndarray:
    """48 bits of a pair: 24 of the first token (below those of its section), 24 of both."""
    low = (first << np.uint64(sections.bit_length() - 1)) >> np.uint64(64 - FIRST_BITS)
    both = common.mix64(first * _MULTIPLIER + second) >> np.uint64(64 - SECOND_BITS)
    return low << np.uint64(SECOND_BITS) | both


def _triple(keys: np.ndarray, before: np.ndarray) -> np.ndarray:
    """A name of a run of three or, without the key's lower half, of its context."""
    return common.mix64(keys * _MULTIPLIER + before.astype(np.uint64))


def token_runs(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per segment of texts: (first, end, hashes of all tokens with an end after each text, per text its first token)."""
    for lo, hi, words, first in common.hashed(column):
        tokens = np.insert(words, first[1:], _END)
        yield lo, hi, tokens, first + np.arange(hi - lo + 1)


def _behind(tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token before each, and 32 bits of the one before that (0 where there is none: a start stands before a text once)."""
    one, two = np.empty_like(tokens), np.zeros(len(tokens), np.uint32)
    one[1:] = tokens[:-1]
    one[first[:-1]] = _START
    two[1:] = one[:-1] >> np.uint64(32) | np.uint64(1)
    two[first[:-1]] = 0
    return one, two


def _groups(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each key that occurs, with its places in their order."""
    order = np.argsort(keys, kind="stable")
    ends = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1], True]) if len(keys) else np.zeros(1, int)
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield int(keys[order[a]]), order[a:b]


def _sums(row: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The rows that occur, sorted, with the sums of their values."""
    order = np.argsort(row, kind="stable")
    row = row[order]
    at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    return row[at], *(np.add.reduceat(v[order], at) if len(at) else v for v in values)


def _six(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def _squeezed(values: np.ndarray) -> bytes:
    """Numbers of which the high bytes are mostly equal: the bytes of one place together, compressed."""
    wide = np.ascontiguousarray(values)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(wide.view(np.uint8).reshape(-1, wide.itemsize).T).tobytes())


def _unsqueezed(raw: bytes, kind: type) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(size, -1).T).view(kind).ravel()


def _steps(values: np.ndarray) -> np.ndarray:
    """The differences of neighbours, the first from 0; np.cumsum gives the values back."""
    return np.diff(values, prepend=values.dtype.type(0))


class _Tally:
    """Counts of named items, with a column that goes with each; merged whenever MERGE rows wait."""

    def __init__(self) -> None:
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def add(self, names: np.ndarray, counts: np.ndarray, *columns: np.ndarray) -> None:
        self.rows.append((names, counts, *columns))
        self.waiting += len(names)
        if self.waiting > MERGE:
            self.merged()

    def merged(self) -> tuple[np.ndarray, ...]:
        """(names, counts, columns), sorted by name."""
        if len(self.rows) > 1:
            names, counts, *columns = (np.concatenate(x) for x in zip(*self.rows, strict=True))
            order = np.argsort(names, kind="stable")
            names = names[order]
            at = np.flatnonzero(np.r_[True, names[1:] != names[:-1]]) if len(names) else np.zeros(0, np.int64)
            counts = np.add.reduceat(counts[order], at) if len(at) else counts
            self.rows = [(names[at], counts, *(c[order[at]] for c in columns))]
        self.waiting = 0
        return self.rows[0] if self.rows else ()


def token_counts(train: DataFrame, shards: int) -> DataFrame:
    """Per shard: the sorted hashes of its tokens with their exact counts, packed, and its most frequent tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0

        def flush() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(kept), return_counts=True)
            rows = [(s, _squeezed(_steps(keys[k])), _squeezed(counts[k].astype(np.uint32))) for s, k in _groups(_high(keys, shards))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["shard", "keys", "counts"])

        for batch in batches:
            for _, _, tokens, _ in token_runs(batch.column(0)):
                kept.append(tokens)
                n += len(tokens)
                if n > FLUSH:
                    yield flush()
                    kept, n = [], 0
        if kept:
            yield flush()

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        for batch in batches:
            for k, c in zip(batch.column("keys"), batch.column("counts"), strict=True):
                tally.add(np.cumsum(_unsqueezed(k.as_py(), np.uint64)), _unsqueezed(c.as_py(), np.uint32).astype(np.int64))
        keys, counts = tally.merged()
        most = np.sort(np.lexsort((keys, -counts))[: HEADS // shards])
        cells = [key[0].as_py(), len(keys), int(counts.sum()), _squeezed(_steps(keys)), _squeezed(counts), keys[most].tobytes(), counts[most].tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(cells, (pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4), strict=True)], names=["shard", "distinct", "total", "keys", "counts", "head_keys", "head_counts"])

    dealt = train.select("text").mapInArrow(count, "shard int, keys binary, counts binary")
    return dealt.groupBy("shard").applyInArrow(add, "shard int, distinct bigint, total bigint, keys binary, counts binary, head_keys binary, head_counts binary")


@dataclass
class Model:
    """What is learnt: tables of exact token counts and of the filter's blocks, and numbers of a bounded size."""

    counts: DataFrame
    blocks: DataFrame
    heads: tuple[np.ndarray, np.ndarray]
    total: int
    distinct: int
    shards: int
    copies: np.ndarray  # cells of each section


def log_probability(pairs: Filter, triples: Filter, keys: np.ndarray, before: np.ndarray, levels: np.ndarray, total: int, distinct: int) -> np.ndarray:
    """log10 of the probability of each run's last token, whose own count has the level, after the others."""
    p = (_LEVEL_COUNTS[levels] + 1) / (total + distinct + 1)
    names, which = np.unique(keys, return_inverse=True)
    followed, types, of = pairs.contexts(names >> np.uint64(SECOND_BITS))
    run = np.where(followed[of] > 0, pairs.counts(names ^ _RUN), 0)[which]
    followed, types = followed[of][which], types[of][which]
    p = np.where(followed > 0, np.minimum(1, (run + types * p) / (followed + types)), p)
    three = np.flatnonzero(before)
    followed, types, of = triples.contexts(_triple(keys[three] >> np.uint64(SECOND_BITS), before[three]))
    known = np.flatnonzero(followed[of] > 0)
    three, followed, types = three[known], followed[of][known], types[of][known]
    run = triples.counts(_triple(keys[three], before[three]) ^ _RUN)
    p[three] = np.minimum(1, (run + types * p[three]) / (followed + types))
    return np.log10(p)


def fit(train: DataFrame, rows: int) -> Model:
    """The model of the column text of train, a table of at most `rows` rows."""
    shards = min(MAX_SHARDS, max(MIN_SHARDS, 1 << max(0, rows // SHARD_DOCUMENTS - 1).bit_length()))
    counts = common.store(token_counts(train, shards), "tokens", clean=True)
    found = counts.select("shard", "total", "distinct", "head_keys", "head_counts").collect()  # MAX_SHARDS rows, HEADS tokens at most
    total, distinct = sum(r["total"] for r in found), sum(r["distinct"] for r in found)
    heads = _Tally()
    for r in found:
        heads.add(np.frombuffer(r["head_keys"], np.uint64), np.frombuffer(r["head_counts"], np.int64))
    sections = min(shards, max(16, 1 << (total // SECTION_TOKENS).bit_length()))
    load = np.zeros(sections, np.int64)
    for r in found:
        load[r["shard"] * sections // shards] += r["total"]
    load[int(_high(np.array([_START]), sections)[0])] += rows
    model = Model(counts, counts, heads.merged() or (np.zeros(0, np.uint64), np.zeros(0, np.int64)), total, distinct, shards, np.minimum(65_535, 1 + load // SECTION_TOKENS))
    model.blocks = _blocks(train, model)
    return model


def _blocks(train: DataFrame, model: Model) -> DataFrame:
    """(section, copy, order, block) of each cell: its section's pairs and its own runs of three."""
    copies = model.copies
    sections = len(copies)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0

        def flush() -> pa.RecordBatch:
            section, key, before, deal = (np.concatenate(x) for x in zip(*kept, strict=True))
            out = []
            # Runs of three, and the pairs of sections that are split, by the second token.
            split = np.flatnonzero(copies[section] > 1)
            for order, at in ((3, np.arange(len(key))), (2, split)):
                wide = section[at].astype(np.uint64) << np.uint64(KEY_BITS) | key[at]
                _, one, times = np.unique(_triple(wide, before[at]) if order == 3 else wide, return_index=True, return_counts=True)
                one = at[one]
                cell = section[one].astype(np.int64) << 16 | (np.where(before[one] > 0, before[one], deal[one]) if order == 3 else deal[one]) % copies[section[one]]
                for k, i in _groups(cell):
                    i = i[np.argsort(key[one[i]])]
                    i, counts = one[i], times[i].astype(np.uint32)
                    out.append((k >> 16, k & 0xFFFF, order, _squeezed(_steps(key[i])), before[i].tobytes() if order == 3 else b"", _squeezed(counts)))
            types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["section", "copy", "order", "keys", "before", "counts"])

        for batch in batches:
            for _, _, tokens, first in token_runs(batch.column(0)):
                one, two = _behind(tokens, first)
                kept.append((_high(one, sections).astype(np.int32), _key(one, tokens, sections), two, (tokens >> np.uint64(32)).astype(np.uint32)))
                n += len(tokens)
                if n > RUN_FLUSH:
                    yield flush()
                    kept, n = [], 0
        if kept:
            yield flush()

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The block of the kept runs of three, and the kept pairs."""
        section, copy = key[0].as_py(), key[1].as_py()
        triples, pairs = _Tally(), _Tally()
        for batch in batches:
            for order, raw, two, often in zip(*(batch.column(c).to_pylist() for c in ("order", "keys", "before", "counts")), strict=True):
                keys, times = np.cumsum(_unsqueezed(raw, np.uint64)), _unsqueezed(often, np.uint32).astype(np.int64)
                if order == 3:
                    before = np.frombuffer(two, np.uint32)
                    triples.add(_triple(keys, before), times, keys, before)
                else:
                    pairs.add(keys, times)
        if copies[section] == 1:
            _, times, keys, _ = triples.merged()
            pairs.add(*_sums(keys, times))
        out = []
        if pairs.rows:
            names, times = pairs.merged()
            kept = times >= MIN_COUNT
            out.append((section, copy, 2, _squeezed(_steps(names[kept])), _squeezed(times[kept])))
        if triples.rows:
            names, times, keys, before = triples.merged()
            kept = (times >= MIN_COUNT) & (before > 0)
            context, followed, types = _sums(_triple(keys[kept] >> np.uint64(SECOND_BITS), before[kept]), times[kept], np.ones(int(kept.sum()), np.int64))
            many = types > 1
            raw = block(np.concatenate((names[kept] ^ _RUN, context ^ _FOLLOWED, context[many] ^ _TYPES)), np.concatenate((times[kept], followed, types[many])))
            out.append((section, copy, 3, raw.tobytes(), b""))
        types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["section", "copy", "order", "data", "counts"])

    def build(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The block of a section's pairs; each pair comes from one cell."""
        tally = _Tally()
        for batch in batches:
            for raw, times in zip(batch.column("data"), batch.column("counts"), strict=True):
                tally.add(np.cumsum(_unsqueezed(raw.as_py(), np.uint64)), _unsqueezed(times.as_py(), np.int64))
        keys, times = tally.merged()
        context, followed, types = _sums(keys >> np.uint64(SECOND_BITS), times, np.ones(len(keys), np.int64))
        many = types > 1
        raw = block(np.concatenate((keys ^ _RUN, context ^ _FOLLOWED, context[many] ^ _TYPES)), np.concatenate((times, followed, types[many])))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([raw.tobytes()], pa.binary())], names=["section", "block"])

    dealt = train.select("text").mapInArrow(count, "section int, copy int, order int, keys binary, before binary, counts binary")
    merged = common.store(dealt.groupBy("section", "copy").applyInArrow(merge, "section int, copy int, order int, data binary, counts binary"), "runs", clean=True)
    pairs = merged.where("order = 2").groupBy("section").applyInArrow(build, "section int, block binary")
    cells = F.explode(F.sequence(F.lit(0), F.get(F.array(*(F.lit(int(x)) for x in copies)), F.col("section")) - 1))
    pairs = pairs.select("section", cells.alias("copy"), F.lit(2).alias("order"), "block")
    return pairs.union(merged.where("order = 3").select("section", "copy", "order", F.col("data").alias("block")))


def scores(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of documents, learnt from those not held out."""
    held = F.coalesce(F.expr(f"pmod(crc32(cast(cast(doc_id as string) as binary)), {MOD}) = {HELD_OUT}"), F.lit(False))
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), held.alias("held_out"), "text")
    return score(rows, fit(rows.where("not held_out"), documents.count()))


def score(rows: DataFrame, model: Model) -> DataFrame:
    """The model's scores of rows (doc_id, held_out, text)."""
    context = rows.sparkSession.sparkContext
    counts, blocks, shards, copies = model.counts, model.blocks, model.shards, model.copies
    sections, total, distinct = len(copies), model.total, model.distinct
    known, times = model.heads
    shared = context.broadcast((known, times, _levels(np.maximum(1, times)).astype(np.uint8)))
    cell = "section int, copy int, keys binary, before binary, levels binary, times binary, rows binary, spans binary, exact binary, texts binary, bucket bigint"
    names = [x.split()[0] for x in cell.split(", ")]
    cell_types = [pa.int32()] * 2 + [pa.binary()] * 8 + [pa.int64()]
    part = "bucket bigint, texts binary, rows binary, logs binary, base binary, known binary"
    part_types = [pa.int64()] + [pa.binary()] * 5

    def batch_of(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def runs(row: np.ndarray) -> tuple[bytes, bytes]:
        at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        return _squeezed(_steps(row[at])), _squeezed(np.diff(np.r_[at, len(row)]).astype(np.uint32))

    def few(counts: np.ndarray) -> bytes:
        return _squeezed(counts.astype(np.uint32)) if len(counts) and counts.max() > 1 else b""

    def cells(to: np.ndarray, keys: np.ndarray, before: np.ndarray, levels: np.ndarray, times: np.ndarray, row: np.ndarray, exact: np.ndarray | None = None) -> pa.RecordBatch:
        out = [(t >> 16, t & 0xFFFF, _six(keys[k]), before[k].tobytes(), _squeezed(levels[k]), few(times[k]), *runs(row[k]), _squeezed(exact[k]) if exact is not None else None, None, None) for t, k in _groups(to)]
        return batch_of(out, cell_types, names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Per segment: its batch, first and last row there, number of its first row, tokens, first of each text, place in the head, whether there."""
        known = shared.value[0]
        index = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo, hi, tokens, first in token_runs(batch.column(2)):
                at = np.minimum(np.searchsorted(known, tokens), max(0, len(known) - 1))
                yield batch, lo, hi, index, tokens, first, at, known[at] == tokens if len(known) else np.zeros(len(tokens), bool)
                index += hi - lo

    def distinct_runs(index: int, tokens: np.ndarray, first: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the chosen tokens' runs, each text's different ones: (place of one, cell, key, before, times, row)."""
        one, two = _behind(tokens, first)
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        chosen = np.flatnonzero(chosen)
        key, two, text = _key(one[chosen], tokens[chosen], sections), two[chosen], text[chosen]
        section = _high(one[chosen], sections).astype(np.int64)
        _, at, times = np.unique(_triple(_triple(key ^ section.astype(np.uint64) << np.uint64(KEY_BITS), two), text), return_index=True, return_counts=True)
        order = np.argsort(at)
        at, times = at[order], times[order]
        deal = np.where(two > 0, two, (tokens[chosen] >> np.uint64(32)).astype(np.uint32))[at]
        return chosen[at], section[at] << 16 | deal % copies[section[at]], key[at], two[at], times, index + text[at]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole texts with what the head gives, and the runs whose last token is in the head, by the cell of the others."""
        _, times, tops = shared.value
        for batch, lo, hi, index, tokens, first, at, in_head in read(batches):
            n = hi - lo
            logs = np.where(in_head, np.log10(times[at] + 1.0), 0.0) if len(times) else np.zeros(len(tokens))
            ids, held = batch.column(0).slice(lo, n), batch.column(1).slice(lo, n)
            sums = np.add.reduceat(np.stack((in_head, logs)), first[:-1], 1)
            texts = np.stack((np.arange(index, index + n), ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(False), held.to_numpy(False), np.diff(first), sums[0].astype(np.int64), sums[1].view(np.int64)))
            yield batch_of([(b % sections, b // sections % int(copies[b % sections]), *[None] * 7, _squeezed(texts[:, k].ravel()), b) for b, k in _groups(texts[0] >> BUCKET_BITS)], cell_types, names)
            place, to, key, two, often, row = distinct_runs(index, tokens, first, in_head)
            yield cells(to, key, two, tops[at[place]] if len(tops) else np.zeros(0, np.uint8), often, row)

    def send_tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The runs whose last token is not in the head, by that token's shard."""
        fields = ["shard", "tokens", "cells", "keys", "before", "times", "rows", "spans"]
        for _, _, _, index, tokens, first, _, in_head in read(batches):
            place, to, key, two, often, row = distinct_runs(index, tokens, first, ~in_head)
            out = [(s, tokens[place[k]].tobytes(), to[k].astype(np.uint32).tobytes(), _six(key[k]), two[k].tobytes(), few(often[k]), *runs(row[k])) for s, k in _groups(_high(tokens[place], shards))]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary() if i else pa.int32()) for i in range(len(fields))], names=fields)

    def unpacked(part: dict[str, list]) -> tuple[np.ndarray, ...]:
        """(keys, before, times, rows, spans) of packs."""
        spans = [_unsqueezed(x, np.uint32) for x in part["spans"]]
        often = [_unsqueezed(t, np.uint32) if t else np.ones(int(s.sum()), np.uint32) for t, s in zip(part["times"], spans, strict=True)]
        return _from_six(b"".join(part["keys"])), np.frombuffer(b"".join(part["before"]), np.uint32), np.concatenate(often), np.concatenate([np.cumsum(_unsqueezed(x, np.int64)) for x in part["rows"]]), np.concatenate(spans).astype(np.int64)

    def chunks(table: pa.Table) -> Iterator[dict[str, list]]:
        """Packs of about CHUNK runs together."""
        part, n = [], 0
        for i in range(table.num_rows):
            part.append(i)
            n += len(table.column("before")[i].as_py()) // 4
            if n >= CHUNK or i == table.num_rows - 1:
                yield {c: table.column(c).slice(part[0], len(part)).to_pylist() for c in table.column_names}
                part, n = [], 0

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        """Tail tokens with their exact counts, on their way to the cells of the tokens before them."""
        out = [cells(np.zeros(0, np.int64), *[np.zeros(0, np.uint64)] * 5)]
        counted = (np.cumsum(_unsqueezed(right.column("keys")[0].as_py(), np.uint64)), _unsqueezed(right.column("counts")[0].as_py(), np.int64)) if right.num_rows else None
        for part in chunks(left):
            key, two, often, rows, spans = unpacked(part)
            tokens, to = np.frombuffer(b"".join(part["tokens"]), np.uint64), np.frombuffer(b"".join(part["cells"]), np.uint32).astype(np.int64)
            exact = np.zeros(len(tokens), np.int64)
            if counted:
                at = np.minimum(np.searchsorted(counted[0], tokens), len(counted[0]) - 1)
                exact = np.where(counted[0][at] == tokens, counted[1][at], 0)
            levels = np.where(exact > 0, _levels(np.maximum(1, exact)), 0).astype(np.uint8)
            out.append(cells(to, key, two, levels, often, np.repeat(rows, spans), exact))
        return pa.Table.from_batches(out)

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        """Packs of texts as they are, and for each text with runs in the cell the sums of what they give, by bucket."""
        texts = left.filter(left.column("texts").is_valid())
        out = [(b, t, *[None] * 4) for b, t in zip(texts.column("bucket").to_pylist(), texts.column("texts").to_pylist(), strict=True)]
        pairs, triples = (Filter(next((b for o, b in zip(right.column("order").to_pylist(), right.column("block").to_pylist(), strict=True) if o == k), None)) for k in (2, 3))
        found = []
        for pack in chunks(left.select(names[2:9]).filter(left.column("texts").is_null())):
            key, two, often, rows, spans = unpacked(pack)
            levels = np.concatenate([_unsqueezed(x, np.uint8) for x in pack["levels"]])
            logs = log_probability(pairs, triples, key, two, levels, total, distinct) * often
            exact = np.concatenate([_unsqueezed(x, np.int64) if x is not None else np.zeros(len(y) // 4, np.int64) for x, y in zip(pack["exact"], pack["before"], strict=True)])
            at = np.cumsum(spans) - spans
            found.append(_sums(rows, *(np.add.reduceat(v, at) for v in (logs, often * np.log10(exact + 1.0), np.where(exact > 0, often, 0).astype(np.int64)))))
        if found:
            row, logs, base, known = _sums(*(np.concatenate(x) for x in zip(*found, strict=True)))
            for b, k in _groups(row >> BUCKET_BITS):
                tails = known[k].any()
                out.append((b, None, _squeezed(_steps(row[k])), logs[k].astype(np.float32).tobytes(), *((_squeezed(base[k]), _squeezed(known[k])) if tails else (None, None))))
        return pa.Table.from_batches([batch_of(out, part_types, [x.split()[0] for x in part.split(", ")])])

    def finish(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The texts of a bucket with the sums of all cells."""
        texts, sums = [], np.zeros((3, 1 << BUCKET_BITS))
        first = key[0].as_py() << BUCKET_BITS
        for batch in batches:
            for raw, row, *packed in zip(*(batch.column(c).to_pylist() for c in ("texts", "rows", "logs", "base", "known")), strict=True):
                if raw is not None:
                    texts.append(_unsqueezed(raw, np.int64).reshape(7, -1))
                    continue
                at = np.cumsum(_unsqueezed(row, np.int64)) - first
                sums[0, at] += np.frombuffer(packed[0], np.float32)
                if packed[1] is not None:
                    sums[1, at] += _unsqueezed(packed[1], np.float64)
                    sums[2, at] += _unsqueezed(packed[2], np.int64)
        row, ids, valid, held, n, known, logs = np.concatenate(texts, 1)
        logs_of, base, more = sums[:, row - first]
        columns = [pa.array(ids, mask=valid == 0), pa.array(held.astype(bool)), pa.array(n), pa.array(known + more.astype(np.int64)), pa.array(logs.view(np.float64) + base), pa.array(logs_of)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "log_counts", "score"])

    three = rows.select("doc_id", "held_out", "text")
    tails = three.mapInArrow(send_tails, "shard int, tokens binary, cells binary, keys binary, before binary, times binary, rows binary, spans binary").groupBy("shard").cogroup(counts.select("shard", "keys", "counts").groupBy("shard")).applyInArrow(meet, cell)
    sent = three.mapInArrow(send, cell).union(tails)
    parts = sent.groupBy("section", "copy").cogroup(blocks.groupBy("section", "copy")).applyInArrow(probe, part)
    one = parts.groupBy("bucket").applyInArrow(finish, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, log_counts double, score double")
    base = F.col("log_counts") - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))
    return one.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), base.alias("base_score"), "score")
