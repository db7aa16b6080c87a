"""Document fingerprints in DataFrame functions alone: one-permutation MinHash with optimal densification.

Every run of five lower-cased words is hashed once. A hash's top bits give its bin, and the smallest
hash of each of BINS bins is kept: as the sorted hashes of a bin stand together, that is the first
of each. An empty bin takes the value of the filled bin that comes first in the empty bin's own
random order of bins, as if it drew bins until one is filled; equal for all documents. The low 8 bits of each
bin are packed as hex. Two fingerprints' share of equal places, less what chance makes equal
(2**-8), estimates the Jaccard similarity.

Edge cases: a null text is empty; a text of fewer words than a shingle, also an empty one, has one
shingle, all its words. Null ids come last in descending order; rows of one id are ordered by text.
A single row is its own next document. Extra columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BIN_BITS = 7
BINS = 1 << BIN_BITS
VALUE_BITS = 8
BUCKET_ROWS, MAX_BUCKETS, CROWDED = 2_000, 200_000, 4


def bound(df: DataFrame, name: str, value: Column | str) -> DataFrame:
    """df with a column that is computed once for each row, however often lambdas use it (a projection might be inlined)."""
    value = F.expr(value) if isinstance(value, str) else value
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_fingerprint(df: DataFrame, text: str, name: str, words: int = 5) -> DataFrame:
    """df with the fingerprint of the column `text` as the hex string `name`."""
    kept = [*df.columns, name]
    rest = ", ".join(f"get(__words, i + {k})" for k in range(1, words))
    df = bound(df, "__words", rf"transform(filter(split(translate(lower(coalesce(`{text}`, '')), '\t\n\u000b\f\r', '     '), ' '), w -> w <> ''), w -> xxhash64(w))")
    df = bound(df, "__all", f"if(size(__words) < {words}, array(xxhash64(__words)), sort_array(transform(slice(__words, 1, greatest(size(__words) - {words - 1}, 0)), (x, i) -> xxhash64(x, {rest}))))")
    top = 64 - BIN_BITS
    df = bound(df, "__first", f"filter(__all, (x, i) -> i = 0 or shiftrightunsigned(x, {top}) <> shiftrightunsigned(get(__all, i - 1), {top}))")
    df = bound(df, "__bins", f"transform(__first, x -> shiftrightunsigned(x, {top}))")
    df = bound(df, "__at", "map_from_arrays(__bins, __first)")
    drawn = f"array_min(transform(__bins, b -> (xxhash64(i, b) & ~{BINS - 1}L) | b)) & {BINS - 1}L"
    value = f"coalesce(element_at(__at, i), element_at(__at, {drawn}))"
    df = df.withColumn(name, F.expr(f"lower(array_join(transform(sequence(0L, {BINS - 1}L), i -> lpad(hex({value} & {(1 << VALUE_BITS) - 1}L), {VALUE_BITS // 4}, '0')), ''))"))
    return df.select(*kept)


def likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """df with the estimated Jaccard similarity of the texts behind fingerprints a and b, bias corrected, from 0 to 1."""
    kept = [*df.columns, name]
    df = bound(bound(df, "__a", f"unhex({a})"), "__b", f"unhex({b})")
    chance = 1 / (1 << VALUE_BITS)
    share = f"size(filter(sequence(1, {BINS}), i -> substr(__a, i, 1) = substr(__b, i, 1))) / {BINS}D"
    return df.withColumn(name, F.expr(f"least(1D, greatest(0D, ({share} - {chance}D) / {1 - chance}D))")).select(*kept)


def places(keys: DataFrame, key: str) -> tuple[tuple[int, int], list[DataFrame]]:
    """How to deal rows into buckets of neighbouring keys, in steps.

    Step 0 cuts the keys' range into equal parts; each step after it cuts the parts with more than CROWDED times
    BUCKET_ROWS rows again, where keys crowd. The first step is (low, width); each other is a stored table of `__of` (a
    part, a list of one number for each step before), `low` and `width`, of rows / (CROWDED * BUCKET_ROWS) rows and MAX_BUCKETS at most.
    """
    low, high, rows = keys.agg(F.min(key), F.max(key), F.count("*")).first()
    parts = max(1, min(MAX_BUCKETS, rows // BUCKET_ROWS))
    first, out = (0, 1) if low is None else (low, min((high - low) // parts + 1, (1 << 63) - 1)), []
    while len(out) < 3:
        crowd = max(CROWDED * BUCKET_ROWS, rows // MAX_BUCKETS)
        dealt = in_buckets(keys.select(key), (first, out), key).groupBy("__bucket").agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count("*").alias("n"))
        dense = dealt.where((F.col("n") > crowd) & (F.col("high") > F.col("low")))
        pieces = F.least(F.lit(MAX_BUCKETS), F.floor(F.col("n") / BUCKET_ROWS))
        found = common.store(dense.withColumn("pieces", pieces).selectExpr("__bucket as __of", "low", "(cast(high as decimal(20, 0)) - low) div pieces + 1 as width"), "places")
        if found.isEmpty():
            break
        out.append(found)
    return first, out


def in_buckets(df: DataFrame, steps: tuple[tuple[int, int], list[DataFrame]], key: str) -> DataFrame:
    """df with `__bucket`, its part at each step: an array that orders as the keys do. Null keys come before all."""
    (low, width), tables = steps
    part = lambda low, width: F.expr(f"coalesce((cast({key} as decimal(20, 0)) - {low}) div {width}, -1L)")
    df = df.withColumn("__bucket", F.array(part(low, width)))
    for table in tables:
        df = df.join(F.broadcast(table), F.col("__bucket") == F.col("__of"), "left")
        df = df.withColumn("__bucket", F.when(F.col("__of").isNotNull(), F.concat("__bucket", F.array(part("low", "width")))).otherwise(F.col("__bucket"))).drop("__of", "low", "width")
    return df


def with_next(df: DataFrame, keys: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """df with next_<column> from the row of the next smaller key; the last row's next is the first. keys: the same rows' keys, cheap to read.

    Rows are dealt into buckets of neighbouring keys; each bucket also gets a copy of the row that
    follows its last, so no window spans more than a bucket.
    """
    steps = places(keys, key)
    df = in_buckets(df, steps, key)
    heads = in_buckets(keys.select(key), steps, key).groupBy("__bucket").agg(F.max(key).alias("__head"))
    # The bucket above takes a copy of a bucket's first row; the lowest takes that of the highest.
    above = "coalesce(lag(__bucket) over (order by __bucket desc), min(__bucket) over ())"
    heads = heads.select(F.col("__bucket").alias("__of"), "__head", F.expr(above).alias("__above"))
    same = (F.col("__bucket") == F.col("__of")) & F.col(key).eqNullSafe(F.col("__head"))
    df = df.join(F.broadcast(heads), same, "left")  # 2 * MAX_BUCKETS rows at most
    to = F.when(F.col("__above").isNull(), F.array(F.struct(F.col("__bucket").alias("b"), F.lit(False).alias("copy")))).otherwise(
        F.array(F.struct(F.col("__bucket").alias("b"), F.lit(False).alias("copy")), F.struct(F.col("__above").alias("b"), F.lit(True).alias("copy")))
    )
    df = df.withColumn("__to", F.explode(to)).select("*", F.col("__to.b").alias("__b"), F.col("__to.copy").alias("__copy"))
    order = f"(partition by __b order by __copy, {key} desc nulls last, {columns[0]})"
    df = df.select("*", *(F.expr(f"lead({c}) over {order}").alias(f"next_{c}") for c in columns)).where("not __copy")
    return df.drop("__bucket", "__of", "__head", "__above", "__to", "__b", "__copy")


def edited_fingerprints(documents: DataFrame) -> DataFrame:
    """Fingerprints of every text, and of it with its last third replaced by the start of the next document's."""
    df = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = with_next(with_fingerprint(df, "text", "fingerprint"), documents.select("doc_id"), "doc_id", ["text", "fingerprint"])
    df = df.withColumn("n_chars", F.length("text").cast("bigint"))
    cut = "cast(n_chars div 3 as int)"
    df = bound(df, "edited", f"concat(left(text, cast(n_chars as int) - {cut}), left(next_text, {cut}))").drop("text", "next_text")
    df = with_fingerprint(df.withColumn("edited_sha256", F.sha2("edited", 256)), "edited", "edited_fingerprint")
    df = likeness(likeness(df, "fingerprint", "edited_fingerprint", "near_edited"), "fingerprint", "next_fingerprint", "near_next")
    return df.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
