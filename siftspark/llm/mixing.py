"""Mixing sources to target weights, in DataFrame functions alone: Efraimidis-Spirakis sampling to word budgets.

Targets: sources by code point (null last) weigh `weights`, repeated, and share `share` times all
words; a target stops at `most` times its source's words, and the excess is shared by weight among
the rest until none is above (water-filling, solved in closed form over the sources).

Selection: a document's key is -ln(u) / w, u from a hash of its id and w its quality weight; the
smallest keys come first. A source's whole epochs come first, then documents by key until the
budget is used up; the last one is taken in part. Running sums are over cells, slices of the keys of a source in
equal ratios (CELLS an octave), and over single rows only in the cell where the budget ends, so no task holds a source:
exponential keys of any one weight put at most one in 1,900 documents in a cell.

Edge cases: null texts have size 0 and are never taken; a null source is a source of its own; null
ids share one u; rows that repeat an id share what that id takes at the end of the budget. Empty
tables give empty results. `mixed` keeps extra columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

CELLS = 512
WORD = r"[^\x20\x09-\x0D]+"


def size() -> Column:
    """Words in `text`."""
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")


def quality(words: Column) -> Column:
    """The weight of a text that has no other: higher the closer the mean word is to six characters with its space, from 0.1 to 1."""
    mean = F.length("text") / F.greatest(words, F.lit(1))
    return F.greatest(F.lit(0.1), F.lit(1.0) / (F.lit(1.0) + F.abs(mean - 6.0) / 6.0))


def key(words: Column, weight: str | None = None) -> Column:
    """The exponential key, from the quality weight in the column `weight` (a classifier's score, say; 0.001 at least, also for null) or `quality`."""
    u = F.expr("(cast(conv(substr(md5(coalesce(cast(doc_id as string), '')), 1, 13), 16, 10) as bigint) + 1) / 4503599627370497D")
    return -F.log(u) / (quality(words) if weight is None else F.greatest(F.lit(0.001), F.coalesce(F.col(weight).cast("double"), F.lit(0.0))))


def items(documents: DataFrame, weight: str | None = None) -> DataFrame:
    """doc_id, source, size, key, cell of every row."""
    own = [] if weight is None else [documents[weight].alias("__weight")]
    df = documents.select(documents["doc_id"], documents["source"], size().alias("__size"), documents["text"], *own)
    df = df.select("doc_id", "source", F.col("__size").alias("size"), F.coalesce(key(F.col("__size"), "__weight" if own else None), F.lit(0.0)).alias("key"))
    return df.withColumn("cell", F.floor(F.log2(F.greatest("key", F.lit(2.0**-60))) * CELLS))


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """sources (source, source_size) with target. One row a source."""
    cases = " ".join(f"when {i} then {w}" for i, w in enumerate(weights))
    df = sources.selectExpr("*", f"case (row_number() over (order by source asc nulls last) - 1) % {len(weights)} {cases} end as w", f"{most} * source_size as cap", f"{share}D * sum(source_size) over () as total")
    df = df.selectExpr("*", "(total - coalesce(sum(cap) over (order by cap / w, source rows between unbounded preceding and 1 preceding), 0)) / sum(w) over (order by cap / w, source rows between current row and unbounded following) as level", "row_number() over (order by cap / w, source) as place")
    df = df.selectExpr("*", "(min(case when cap / w > level then struct(place, level) end) over ()).level as final")
    return df.selectExpr("source", "source_size", "case when final is null or cap / w <= final then cast(cap as double) else w * final end as target")


def plan(rows: DataFrame, **options) -> DataFrame:
    """Per source: target, epochs, and where its fractional part ends: the key and id of the last document, its rows' size, and the words that are left for it."""
    cells = rows.groupBy("source", "cell").agg(F.sum("size").alias("words"))
    cells = common.store(cells, "cells")
    sources = targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), **options)
    sources = sources.selectExpr("*", "cast(round(target) as bigint) as budget").selectExpr("*", "if(source_size > 0, budget div source_size, 0) as epochs")
    sources = common.store(sources.selectExpr("*", "budget - epochs * source_size as rest"), "sources")
    cells = cells.selectExpr("source as s", "cell", "words", "coalesce(sum(words) over (partition by source order by cell rows between unbounded preceding and 1 preceding), 0) as before")
    ends = cells.join(sources, cells["s"].eqNullSafe(sources["source"])).where("before < rest and before + words >= rest").select("s", F.col("cell").alias("end_cell"), (F.col("rest") - F.col("before")).alias("left"))
    ends = common.store(ends, "ends")
    inside = rows.join(ends, rows["source"].eqNullSafe(ends["s"]) & (rows["cell"] == ends["end_cell"])).groupBy("s", "left", "key", "doc_id").agg(F.sum("size").alias("words"))
    inside = inside.selectExpr("*", "coalesce(sum(words) over (partition by s order by key, doc_id rows between unbounded preceding and 1 preceding), 0) as before")
    last = inside.where("before < left and before + words >= left").select(F.col("s").alias("l"), F.col("key").alias("last_key"), F.col("doc_id").alias("last_id"), F.col("words").alias("last_size"), (F.col("left") - F.col("before")).alias("last_words"))
    return common.store(sources.join(last, sources["source"].eqNullSafe(last["l"]), "left").drop("l", "rest", "budget"), "plan")


def taken() -> Column:
    """Words that the mix takes of a row of `items` joined with its source's `plan`."""
    first = "key < last_key or key = last_key and coalesce(doc_id < last_id, last_id is not null)"
    return F.expr(f"epochs * size + case when last_key is null then 0 when {first} then size when key = last_key and doc_id <=> last_id then last_words * size div last_size else 0 end")


def _planned(df: DataFrame, sources: DataFrame) -> DataFrame:
    # The plan is a stored table: Spark broadcasts it if its files are below the session's threshold.
    return df.join(sources.withColumnRenamed("source", "__source"), df["source"].eqNullSafe(F.col("__source"))).drop("__source")


def mix(documents: DataFrame, weight: str | None = None, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of documents."""
    rows = common.store(items(documents, weight), "items")
    return _planned(rows, plan(rows, **options)).select("doc_id", "size", "source_size", "target", taken().alias("taken"))


def mixed(documents: DataFrame, weight: str | None = None, **options) -> DataFrame:
    """The rows of documents as often as the mix takes them, with all columns. A document taken in part comes whole if at least half of it is taken."""
    rows = common.store(items(documents, weight), "items")
    own = [] if weight is None else [documents[weight].alias("__weight")]
    words = documents.select(*(documents[c].alias(f"__c{i}") for i, c in enumerate(documents.columns)), documents["doc_id"], documents["source"], documents["text"], size().alias("size"), *own)
    words = words.withColumn("key", F.coalesce(key(F.col("size"), "__weight" if own else None), F.lit(0.0)))
    copies = F.expr("if(size > 0, cast(round(__taken / size) as int), 0)")
    out = _planned(words, plan(rows, **options)).withColumn("__taken", taken()).withColumn("__n", copies).where("__n > 0")
    out = out.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    return out.select(*(F.col(f"__c{i}").alias(c) for i, c in enumerate(documents.columns)))


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, text FROM documents),
k AS (SELECT doc_id, source, size, coalesce(-ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 1) / 4503599627370497::DOUBLE)
  / greatest(0.1::DOUBLE, 1::DOUBLE / (1::DOUBLE + abs(length(text)::DOUBLE / greatest(size, 1) - 6) / 6)), 0) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 2 * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
  row_number() OVER (ORDER BY cap / w, source) AS place FROM w),
f AS (SELECT *, (SELECT min_by(level, place) FROM l WHERE cap / w > level) AS final FROM l),
t AS (SELECT source, source_size, CASE WHEN final IS NULL OR cap / w <= final THEN cap::DOUBLE ELSE w * final END AS target FROM f),
b AS (SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS epochs FROM t),
p AS (SELECT k.*, b.source_size, b.target, b.epochs, round(b.target)::BIGINT - b.epochs * b.source_size AS rest,
  coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (epochs * size + least(size, greatest(0, rest - before)))::BIGINT AS taken FROM p
"""
