"""A quality classifier: logistic regression on hashed word n-grams, fitted by follow-the-regularised-leader (proximal) updates.

Features of a text are words and word pairs, and one to three of the words' forms in a row (case,
length, last bytes, and whether a word repeats the one before), all hashed into one table. A text's
score is a sparse dot product: the mean weight of its n-grams in each of the two blocks, scaled.

Fit: at most `max_rows` labelled rows, the ones of the smallest hashed ids, dealt over tasks of about `SHARD_ROWS`;
each runs FTRL on its rows, and the weights are averaged. Only weights (1 MB a shard) reach the driver.

Edge cases: a null or empty text scores the bias alone. Null ids and null labels are not learnt
from, and a null id is not held out. Repeated labels of an id: the smaller label counts; of rows that repeat a
labelled id the smallest text is learnt from, so the fit reads max_rows texts at most. With no labels every score is 0.5.
Extra columns are carried by `score` under their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BITS = 18
SHARD_ROWS = 2_048
MAX_ROWS = 16_384
UPDATES = 30_000  # about as many in all: few labelled rows are passed over more often
SCALE = np.float32(12.0)
_CLASS = np.zeros(256, np.uint64)  # the form of a byte: itself, or one class for lower case, upper case and digits
_CLASS[:] = np.arange(256)
_CLASS[97:123] = _CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return common.mix64(a * np.uint64(0x9E3779B97F4A7C15) + b)


def ngrams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per segment of texts: (first, end, word n-gram slots, text of each, form n-gram slots, text of each)."""
    data, at = common.utf8(column)
    mask = np.uint64((1 << BITS) - 1)
    for lo, hi, part, off in common.segments(data, at):
        starts, ends, first = common.spans(part, off)
        words = common.word_hashes(part, starts, ends)
        text = np.repeat(np.arange(hi - lo), np.diff(first))
        upper = np.zeros(len(part) + 1, np.int32)
        np.cumsum(_UPPER[part], out=upper[1:])
        size = ends - starts
        form = _CLASS[part[starts]] | _CLASS[part[ends - 1]] << np.uint64(8) | _CLASS[part[np.maximum(starts, ends - 2)]] << np.uint64(16)
        form |= ((upper[ends] - upper[starts]) * 2 > size).astype(np.uint64) << np.uint64(24) | np.minimum(np.log2(size + 1).astype(np.uint64), np.uint64(7)) << np.uint64(25)
        pairs = text[1:] == text[:-1]
        again = np.zeros(len(words), np.uint64)
        again[1:] = pairs & (words[1:] == words[:-1])
        form = common.mix64(form | again << np.uint64(32) | np.uint64(1) << np.uint64(40))
        two = _pair(form[:-1], form[1:])[pairs]
        triples = pairs[1:] & pairs[:-1]
        three = _pair(_pair(form[:-2], form[1:-1]), form[2:])[triples]
        grams = np.concatenate((words, _pair(words[:-1], words[1:])[pairs]))
        forms = np.concatenate((form, two, three))
        yield lo, hi, (grams & mask).astype(np.int32), np.concatenate((text, text[1:][pairs])), (forms & mask).astype(np.int32), np.concatenate((text, text[1:][pairs], text[2:][triples]))


def _sparse(slots: np.ndarray, text: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    order = np.argsort(text, kind="stable")
    ends = np.searchsorted(text[order], np.arange(n + 1))
    out = []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        k, c = np.unique(slots[order[a:b]], return_counts=True)
        out.append((k, (c * (SCALE / max(1, b - a))).astype(np.float32)))
    return out


def features(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(different slots, values) of each text, without the bias."""
    out = []
    for lo, hi, grams, of_gram, forms, of_form in ngrams(column):
        for (a, x), (b, y) in zip(_sparse(grams, of_gram, hi - lo), _sparse(forms, of_form, hi - lo), strict=True):
            slots, which = np.unique(np.concatenate((a, b)), return_inverse=True)
            out.append((slots, np.bincount(which, np.concatenate((x, y))).astype(np.float32)))
    return out


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5) -> np.ndarray:
    """Weights (the last is the bias) after 3 to 40 passes of FTRL-proximal updates."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size, np.float64), np.zeros(size, np.float64)
    seed = np.random.default_rng(7)

    def weight(k: np.ndarray) -> np.ndarray:
        zk = z[k]
        return np.where(np.abs(zk) <= l1, 0.0, -(zk - np.sign(zk) * l1) / ((beta + np.sqrt(n[k])) / alpha + l2))

    for _ in range(min(40, max(3, UPDATES // max(1, len(rows))))):
        for i in seed.permutation(len(rows)):
            k = np.append(rows[i][0], size - 1)
            x = np.append(rows[i][1], np.float32(1))
            w = weight(k)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - labels[i]) * x
            s = (np.sqrt(n[k] + g * g) - np.sqrt(n[k])) / alpha
            z[k] += g - s * w
            n[k] += g * g
    return weight(np.arange(size)).astype(np.float32)


def labelled(labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, quality) of the rows to learn from: labels whose crc32(doc_id) mod 5 is not 0, at most max_rows."""
    rows = labels.where("doc_id is not null and quality is not null and pmod(crc32(cast(cast(doc_id as string) as binary)), 5) <> 0")
    rows = rows.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def fit(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> np.ndarray:
    """The weights. The sample has at most max_rows rows, so it is broadcast to the scan of documents."""
    sample = common.store(labelled(labels, max_rows), "labelled")
    shards = max(1, round(sample.count() / SHARD_ROWS))
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = rows.select(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(shards)).alias("shard"), "doc_id", "text", "quality")

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, marks, ids = [], [], []
        for batch in batches:
            vectors += features(batch.column("text"))
            marks += batch.column("quality").to_pylist()
            ids += batch.column("doc_id").to_pylist()
        order = np.argsort(ids, kind="stable")  # rows come in any order, and the updates depend on it
        w = ftrl([vectors[i] for i in order], np.array(marks, np.float64)[order])
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([len(marks)], pa.int64()), pa.array([w.tobytes()], pa.binary())], names=["shard", "n", "w"])

    found = sorted(rows.groupBy("shard").applyInArrow(run, "shard bigint, n bigint, w binary").collect())
    total = sum(r["n"] for r in found)
    out = np.zeros((1 << BITS) + 1, np.float32)
    for r in found:
        out += np.frombuffer(r["w"], np.float32) * np.float32(r["n"] / total)
    return out


def scores(column: pa.Array, weights: np.ndarray) -> np.ndarray:
    """The probability of label 1 for each text."""
    out = np.empty(len(column), np.float64)
    for lo, hi, grams, of_gram, forms, of_form in ngrams(column):
        total = np.full(hi - lo, float(weights[-1]))
        for slots, text in ((grams, of_gram), (forms, of_form)):
            n = np.bincount(text, minlength=hi - lo)
            total += np.bincount(text, weights[slots], hi - lo) * (float(SCALE) / np.maximum(1, n))
        out[lo:hi] = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
    return out


def score(documents: DataFrame, weights: np.ndarray, keep: list[str] | None = None, above: float | None = None) -> DataFrame:
    """documents (or its columns `keep`) with a last column score, or without it only the rows that score `above` or more. Whole texts are scored."""
    names = keep or documents.columns
    place = names.index("text") if "text" in names else len(names)
    columns = [documents[c].alias(f"c{i}") for i, c in enumerate(names)]  # so that no name can clash
    rows = documents.select(*columns, *([documents["text"]] if place == len(names) else []))
    model = documents.sparkSession.sparkContext.broadcast(weights)  # 1 MB, whatever the input
    fields = [*rows.schema.fields[: len(names)], T.StructField("score", T.DoubleType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(scores(batch.column(place), model.value))], names=[f.name for f in fields])

    out = common.map_arrow(rows, run, T.StructType(fields))
    if above is not None:
        return out.where(F.col("score") >= above).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), "score")


def quality_scores(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of documents."""
    found = score(documents, fit(documents, labels), ["doc_id"])
    return found.select("doc_id", F.expr("coalesce(pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0, false)").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of documents, with all their columns, that the classifier does not reject."""
    return score(documents, fit(documents, labels), above=threshold)
