"""Chunks for retrieval: paragraphs, or sentences of long paragraphs, gathered to a target with an overlap.

A chunk is a range of the text's words, so the fold over units carries two numbers and the ranges
found so far; no text is copied until the ranges are cut out. Everything is one projection: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

TARGET, MOST, OVERLAP, LEAST = 400, 600, 40, 20


def units(text: Column, most: int = MOST) -> Column:
    """Word counts of the paragraphs, and of the sentences of paragraphs over `most` words."""
    paragraphs = F.filter(F.split(text, "\n\n"), lambda p: T.word_count(p) > 0)
    parts = F.transform(paragraphs, lambda p: F.when(T.word_count(p) > most, F.transform(F.split(F.regexp_replace(p, r"^\s+|\s+$", ""), r"(?<=[.!?])\s+"), T.word_count)).otherwise(F.array(T.word_count(p))))
    return F.flatten(parts)


def ranges(counts: Column, target: int = TARGET, overlap: int = OVERLAP, least: int = LEAST) -> Column:
    """array<struct<lo, hi>>: the words of each chunk."""
    span = "array<struct<lo:int,hi:int>>"
    start = F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.array().cast(span).alias("out"))

    def ended(s: Column) -> Column:
        return F.when(s["hi"] - s["lo"] >= least, F.concat(s["out"], F.array(F.struct(s["lo"].alias("lo"), s["hi"].alias("hi"))))).otherwise(s["out"])

    def step(s: Column, n: Column) -> Column:
        full = (s["hi"] > s["lo"]) & (s["hi"] - s["lo"] + n > target)
        return F.struct(F.when(full, F.greatest(s["lo"], s["hi"] - overlap)).otherwise(s["lo"]).alias("lo"), (s["hi"] + n).alias("hi"), F.when(full, ended(s)).otherwise(s["out"]).alias("out"))

    return F.aggregate(counts, start, step, ended)


def chunks(df: DataFrame, text: str, target: int = TARGET, most: int = MOST, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """df's other columns with chunk_index and content for each chunk of the column `text`. Texts of fewer than `least` words give none."""
    rest = [c for c in df.columns if c != text]
    t = F.coalesce(F.col(text), F.lit(""))
    counted = df.select(*rest, t.alias("__text"), T.word_count(t).alias("__n")).where(F.col("__n") >= least)
    # Each is computed once a row: a Generate node stands between it and the lambdas that read it.
    long = counted.select("*", F.explode(F.array(F.when(F.col("__n") > most, T.words(F.col("__text"))))).alias("__words"))
    long = long.select("*", F.explode(F.array(F.when(F.col("__n") > most, ranges(units(F.col("__text"), most), target, overlap, least)))).alias("__spans"))
    whole = F.array(F.regexp_replace("__text", r"^\s+|\s+$", ""))
    parts = F.transform("__spans", lambda s: F.array_join(F.slice("__words", s["lo"] + 1, s["hi"] - s["lo"]), " "))
    return long.select(*rest, F.posexplode(F.when(F.col("__n") > most, parts).otherwise(whole)).alias("chunk_index", "content"))
