"""URL verdicts: rules first, then gradient-boosted trees on lexical features.

Rules are (verdict, host, path): one fits its host and all subdomains if the URL's path starts with
its own; the longest wins. URLs that a rule fits are the labelled URLs. At most MAX_ROWS of each
verdict (those of the smallest hashes) train the trees on the driver, 2 MB of URLs; the model
goes to the tasks. Features: lengths, depth, digit ratio, entropies, parameter counts, letters
and marks, and suffix statistics: the smoothed share of blocked URLs, among all labelled ones, of the host's last one
and two labels, of the path's first segment and of its extension. While training, a URL meets the statistics of the
other folds' URLs: to leave out its own label alone would give the label away. The statistics are summed over the whole
table in BUCKETS hashed buckets (1 MB a fold), whatever the number of suffixes.

Edge cases: a null URL or one without `://` has an empty host and path, and the trees judge it. With
fewer than two verdicts to learn from, the trees' score is the share of blocked URLs. Ties of rules'
lengths: block. Repeated rows have equal verdicts. Null page_ids are kept, an empty table gives no rows, and extra
columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, urls

Rule = tuple[str, str, str]
MAX_ROWS = 10_000
TREES, DEPTH, BINS, RATE = 40, 3, 32, 0.2
BUCKETS, FOLDS = 1 << 16, 4
_CLASSES = {"digits": np.arange(48, 58), "upper": np.arange(65, 91), "slash": [47], "dot": [46], "dash": [45, 95], "params": [38], "query": [63], "equals": [61], "percent": [37], "fragment": [35]}


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for what, on, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = ((host == on) | host.endswith("." + on)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(on + start)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def suffixes(host: Column, path: Column) -> list[Column]:
    """The buckets of a URL's suffix statistics."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    keys = [F.substring_index(host, ".", -1), F.substring_index(host, ".", -2), F.when(F.size(parts) > 1, F.get(parts, F.lit(0))).otherwise(""), F.when(F.contains(last, F.lit(".")), F.substring_index(last, ".", -1)).otherwise("")]
    return [F.pmod(F.xxhash64(F.lit(i), k), F.lit(BUCKETS)) for i, k in enumerate(keys)]


def lexical(column: pa.Array) -> np.ndarray:
    """One row of lexical features a URL, from its bytes."""
    data, at = common.utf8(column)
    n = len(at) - 1
    size = np.diff(at)
    row = np.repeat(np.arange(n), size)
    table = np.bincount(row * 256 + data, minlength=n * 256).reshape(n, 256) if n else np.zeros((0, 256))
    share = table / np.maximum(1, size)[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(1)
    counts = [table[:, list(v)].sum(1) for v in _CLASSES.values()]
    first_slash = np.full(n, -1)
    slashes = np.flatnonzero(data == 47)
    np.add.at(out := np.zeros(n), row[slashes], 1)
    third = np.flatnonzero(np.r_[True, row[slashes][1:] != row[slashes][:-1]]) + 2 if len(slashes) else np.zeros(0, int)
    third = third[third < len(slashes)]
    same = out[row[slashes[third]]] >= 3 if len(third) else np.zeros(0, bool)
    first_slash[row[slashes[third[same]]]] = slashes[third[same]] - at[row[slashes[third[same]]]]
    host = np.where(first_slash > 0, first_slash, size)
    return np.column_stack([size, host, size - host, counts[0] / np.maximum(1, size), entropy, *counts]).astype(np.float64)


class Trees:
    """Boosted trees of one depth for the log-odds of `block`, grown by gains over quantile bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        p = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 1e-3
        self.base, self.trees = float(np.log(p / (1 - p))), []
        if len(y) < 2 or y.min() == y.max():
            return
        edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)])
        score = np.full(len(y), self.base)
        for _ in range(TREES):
            q = 1 / (1 + np.exp(-score))
            g, h = y - q, q * (1 - q)
            node = np.zeros(len(y), int)
            tree = []
            for depth in range(DEPTH):
                width = 1 << depth
                best = np.full(width, 1e-9)
                feature, cut = np.zeros(width, int), np.full(width, np.inf)
                for k, e in enumerate(edges):
                    if not len(e):
                        continue
                    cell = node * BINS + binned[:, k]
                    gs, hs = (np.bincount(cell, v, width * BINS).reshape(width, BINS).cumsum(1) for v in (g, h))
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = (gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1))[:, : len(e)]
                    at = gain.argmax(1)
                    top = gain[np.arange(width), at]
                    better = top > best
                    best[better], feature[better], cut[better] = top[better], k, e[at[better]]
                tree.append((feature, cut))
                node = 2 * node + (x[np.arange(len(y)), feature[node]] > cut[node])
            leaf = RATE * np.bincount(node, g, 1 << DEPTH) / (np.bincount(node, h, 1 << DEPTH) + 1)
            score += leaf[node]
            self.trees.append((tree, leaf))

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The probability of `block`."""
        score, rows = np.full(len(x), self.base), np.arange(len(x))
        for tree, leaf in self.trees:
            node = np.zeros(len(x), int)
            for feature, cut in tree:
                node = 2 * node + (x[rows, feature[node]] > cut[node])
            score += leaf[node]
        return 1 / (1 + np.exp(-score))


class Model:
    """Trees over lexical features and suffix statistics; `sums` has blocked and all labelled URLs of each fold and bucket."""

    def __init__(self, found: list[str], blocked: np.ndarray, buckets: np.ndarray, fold: np.ndarray, sums: np.ndarray) -> None:
        self.sums = sums.sum(0)
        total = self.sums.sum(1) / max(1, buckets.shape[1])  # every labelled URL is in one bucket of each kind of suffix
        self.share = (total[0] + 1) / (total[1] + 2)
        own = self.rates(self.sums[:, buckets] - sums.transpose(1, 0, 2)[:, fold[:, None], buckets])
        self.trees = Trees(np.column_stack([lexical(pa.array(found, pa.string())), own]), blocked)

    def rates(self, sums: np.ndarray) -> np.ndarray:
        """Smoothed shares of blocked URLs."""
        return (sums[0] + 5 * self.share) / (sums[1] + 5)

    def predict(self, column: pa.Array, buckets: np.ndarray) -> np.ndarray:
        return self.trees.predict(np.column_stack([lexical(column), self.rates(self.sums[:, buckets])]))


def verdicts(pages: DataFrame, rules: list[Rule], threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score of every row of pages."""
    df = pages.select("page_id", "url", urls.host(F.col("url")).alias("host"), urls.path(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    df = df.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), "url", F.array(*suffixes(F.col("host"), F.col("path"))).alias("buckets"))
    ruled = df.where("ruled is not null").withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(FOLDS)))
    sums = np.zeros((FOLDS, 2, BUCKETS))
    for r in ruled.select("fold", F.explode("buckets").alias("bucket"), "ruled").groupBy("fold", "bucket").agg(F.count_if(F.col("ruled") == "block").alias("blocked"), F.count("*").alias("n")).collect():  # FOLDS * BUCKETS rows at most
        sums[r["fold"], :, r["bucket"]] = r["blocked"], r["n"]
    sample = [ruled.where(F.col("ruled") == v).select("url", "ruled", "buckets", "fold").orderBy(F.xxhash64("url", "page_id"), "url").limit(MAX_ROWS) for v in ("allow", "block")]
    rows = sample[0].union(sample[1]).collect()  # 2 * MAX_ROWS rows at most
    fitted = Model([r["url"] for r in rows], np.array([r["ruled"] == "block" for r in rows], float), np.array([r["buckets"] for r in rows], np.int64).reshape(-1, 4), np.array([r["fold"] for r in rows], np.int64), sums)
    model = pages.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                batch = whole.slice(lo, 2048)
                score = model.value.predict(batch.column(5), batch.column(6).flatten().to_numpy().reshape(-1, 4))
                own = np.where(score >= threshold, "block", "allow")
                verdict = [a or b for a, b in zip(batch.column(4).to_pylist(), own.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(verdict, pa.string()), pa.array(score)], names=["page_id", "host", "path", "rule", "verdict", "block_score"])

    return df.mapInArrow(run, "page_id bigint, host string, path string, rule string, verdict string, block_score double")
