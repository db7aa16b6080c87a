"""Run metrics from page timings, coverage of one URL set by another, request pacing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshot(timings: DataFrame) -> DataFrame:
    """One row: counts by outcome, averages over positive times. timings: status (ok, skipped, failed), total_ms."""
    n = lambda s: F.count_if(F.col("status") == s)
    positive = F.avg(F.when(F.col("total_ms") > 0, F.col("total_ms")))
    return timings.agg(n("ok").alias("pages_ok"), n("skipped").alias("pages_skipped"), n("failed").alias("pages_failed"), F.count("*").alias("total_processed"), F.coalesce(F.round(positive, 4), F.lit(0.0)).alias("avg_ms"), F.max("total_ms").alias("max_ms"))


def totals(timings: DataFrame) -> DataFrame:
    """One row: sums and averages of a run. timings: ts, status (ok, skipped, failed, timeout), total_ms, navigate_ms, extract_ms, words, links, bytes, queued, retries, enqueued.

    Words count for pages that are ok, links and bytes for all; averages are over positive times; the overall rate is ok pages by
    the seconds from the first event to the last. Nulls count as 0.
    """
    ok = F.col("status") == "ok"
    whole = lambda c, when=None: F.coalesce(F.sum(F.when(when, F.col(c)) if when is not None else F.col(c)), F.lit(0)).cast("bigint")
    positive = lambda c: F.coalesce(F.round(F.avg(F.when(F.col(c) > 0, F.col(c))), 4), F.lit(0.0))
    seconds = (F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))) / F.lit(1e6)
    df = timings.agg(
        F.count_if(ok).alias("pages_crawled"), F.count_if(F.col("status") == "skipped").alias("pages_skipped"), F.count_if(F.col("status").isin("failed", "timeout")).alias("pages_failed"),
        whole("retries").alias("pages_retried"), whole("enqueued").alias("total_enqueued"), whole("words", ok).alias("total_words"), whole("links").alias("total_links"), whole("bytes").alias("total_bytes"),
        positive("total_ms").alias("avg_page_ms"), positive("navigate_ms").alias("avg_navigate_ms"), positive("extract_ms").alias("avg_extract_ms"), F.coalesce(F.max("queued"), F.lit(0)).alias("queue_peak"), F.coalesce(seconds, F.lit(0.0)).alias("elapsed_sec"),
    )
    rate = F.when(F.col("elapsed_sec") > 0, F.round(F.col("pages_crawled") / F.col("elapsed_sec"), 4)).otherwise(0.0)
    words = F.when(F.col("pages_crawled") > 0, F.round(F.col("total_words") / F.col("pages_crawled"), 4)).otherwise(0.0)
    return df.withColumn("pages_per_sec_overall", rate).withColumn("avg_words_per_page", words)


def stop_reason(crawled: Column, skipped: Column, most: int, stopped: bool = False, error: str | None = None) -> Column:
    """Why a run ended."""
    if error is not None:
        return F.lit(f"Error: {error}")
    if stopped:
        return F.lit("User requested stop")
    exhausted = F.format_string(f"Queue exhausted — only %d useful pages found on this site (skipped %d, requested {most})", crawled, skipped)
    return F.when(crawled >= most, f"MAX_PAGES limit reached ({most})").otherwise(exhausted)


def run_record(timings: DataFrame, most: int, scope: str = "", workers: int = 6) -> DataFrame:
    """The record of a run: `totals`, the trailing rate at its end, the 95th percentile of its last 1000 pages, why it ended."""
    ends = timings.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("__end"))
    last = timings.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("__t")).join(F.broadcast(ends), F.col("__t") >= F.col("__end") - 30_000_000)
    rolling = last.agg(F.round(F.count("*") / 30.0, 4).alias("pages_per_sec_rolling"))
    slow = p95(last_rows(timings, [F.desc("ts"), F.desc("event_id")])).select(F.col("p95_ms").alias("p95_page_ms"))
    df = totals(timings).crossJoin(F.broadcast(rolling)).crossJoin(F.broadcast(slow))  # one row each
    return df.withColumn("workers", F.lit(workers)).withColumn("scope", F.lit(scope)).withColumn("stop_reason", stop_reason(F.col("pages_crawled"), F.col("pages_skipped"), most))


def attempts(tries: DataFrame, key: str, most: int = 2) -> DataFrame:
    """Per page: attempts made (of its tries in order, until one succeeds or `most` have been made again) and whether it succeeded. tries: key, attempt, ok."""
    w = Window.partitionBy(key).orderBy("attempt")
    before = F.coalesce(F.max(F.col("ok").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    made = tries.withColumn("__done", before).withColumn("__i", F.row_number().over(w)).where((F.col("__done") == 0) & (F.col("__i") <= most + 1))
    return made.groupBy(key).agg(F.count("*").alias("attempts"), F.max("ok").alias("ok"))


def paced(rate: float, crawl_delay: Column) -> Column:
    """The request rate that a crawl delay leaves: the smaller of `rate` and one in that many seconds."""
    return F.when(crawl_delay > 0, F.least(F.lit(float(rate)), F.lit(1.0) / crawl_delay)).otherwise(F.lit(float(rate)))


def url_summary(pages: DataFrame, url: str, words: str) -> DataFrame:
    """One row: different URLs, all words, and words a page."""
    return pages.agg(F.count_distinct(url).alias("unique_urls"), F.coalesce(F.sum(words), F.lit(0)).cast("bigint").alias("total_words"), F.coalesce(F.round(F.avg(words), 4), F.lit(0.0)).alias("avg_words"))


def heading_count(headings: Column) -> Column:
    """All headings of a page."""
    return F.aggregate(F.map_values(headings), F.lit(0), lambda n, v: n + F.size(v))


def last_rows(timings: DataFrame, order: list[Column], n: int = 1000) -> DataFrame:
    return timings.orderBy(*order).limit(n)


def p95(timings: DataFrame, value: str = "total_ms") -> DataFrame:
    """The value at index floor(0.95 n) of the sorted values, at most the last. For bounded sets such as the last 1000."""
    at = F.least(F.floor(F.size("v") * F.lit(0.95)), F.size("v") - 1).cast("int")
    return timings.agg(F.sort_array(F.collect_list(value)).alias("v")).select(F.when(F.size("v") > 0, F.get("v", at)).otherwise(0.0).alias("p95_ms"), F.size("v").cast("bigint").alias("n"))


def rolling_rate(events: DataFrame, key: str, seconds: int = 30) -> DataFrame:
    """Events of the trailing window, both ends included, for each event; by key, so no task holds all."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("in_window", F.count("*").over(w)).withColumn("rate", F.col("in_window") / F.lit(float(seconds)))


def token_bucket(requests: DataFrame, key: str, rate: float) -> DataFrame:
    """When each request may go if a key sends `rate` a second and no bursts: max over earlier j of t_j + (i - j) / rate, a running maximum."""
    order = Window.partitionBy(key).orderBy("ts", "event_id")
    gap = int(1_000_000 / rate)
    df = requests.withColumn("__i", F.row_number().over(order) - 1).withColumn("__t", F.unix_micros(F.col("ts").cast("timestamp")))
    go = F.max(F.col("__t") - F.col("__i") * gap).over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("__i") * gap
    return df.withColumn("wait_us", go - F.col("__t")).drop("__i", "__t")


def backoff(attempts: int, base: float = 1.0, most: float = 60.0) -> Column:
    """Seconds before each retry, without jitter."""
    return F.transform(F.sequence(F.lit(0), F.lit(attempts - 1)), lambda n: F.least(F.lit(base) * F.pow(F.lit(2.0), n), F.lit(most)))


def presence(source: DataFrame, crawl: DataFrame) -> DataFrame:
    """url, in_source, in_crawl of the union of two URL sets: one shuffle of distinct URLs."""
    both = source.select("url", F.lit(1).alias("s"), F.lit(0).alias("c")).unionByName(crawl.select("url", F.lit(0).alias("s"), F.lit(1).alias("c")))
    return both.groupBy("url").agg((F.max("s") == 1).alias("in_source"), (F.max("c") == 1).alias("in_crawl"))


def common_prefix(low: Column, high: Column) -> Column:
    """The common start of the smallest and largest URL, cut after its last slash."""
    same = F.transform(F.sequence(F.lit(1), F.least(F.length(low), F.length(high))), lambda i: F.substr(low, i, F.lit(1)) == F.substr(high, i, F.lit(1)))
    gap = F.array_position(same, False)
    prefix = F.substr(low, F.lit(1), F.when(gap > 0, gap - 1).otherwise(F.size(same)).cast("int"))
    cut = F.regexp_extract(prefix, "(?s)^(.*/)", 1)
    return F.when(F.length(cut) > 1, cut).otherwise(prefix)


def coverage(source: DataFrame, crawl: DataFrame) -> DataFrame:
    """The one-row report of how much of source the crawl has."""
    rows = presence(source, crawl)
    n = lambda cond: F.count_if(cond)
    s, c = F.col("in_source"), F.col("in_crawl")
    df = rows.agg(n(s).alias("total_source"), n(c).alias("total_crawled"), n(s & c).alias("matched"), n(s & ~c).alias("missed"), n(c & ~s).alias("extra"), F.count("*").alias("combined"))
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b) * 100, 4)).otherwise(0.0)
    df = df.withColumn("coverage_pct", share("matched", "total_source")).withColumn("precision_pct", share("matched", "total_crawled"))
    tips = F.when(F.col("total_crawled") < F.col("total_source"), F.least(F.col("total_source") + 50, F.col("total_source") * 2))
    verdict = F.when(F.col("coverage_pct") >= 90, "excellent").when(F.col("coverage_pct") >= 70, "good").when(F.col("coverage_pct") >= 40, "moderate").otherwise("low")
    return df.withColumn("suggested_pages", tips).withColumn("verdict", verdict)


def expansion(clicks: DataFrame, key: str, order: list[str], meaningful: Column, most_wasted: int = 15, most_clicks: int = 50) -> DataFrame:
    """Per key, of the clicks that are made: attempted, meaningful_clicks, wasted_clicks, stopped_early, hit_limit.

    A key's clicks stop after `most_wasted` in a row that bring nothing, or after `most_clicks`. Null outcomes are wasted.
    """
    w = Window.partitionBy(key).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    df = clicks.select(key, *(c for c in order if c != key), F.coalesce(meaningful, F.lit(False)).alias("__good"))
    df = df.withColumn("__i", F.row_number().over(w))
    df = df.withColumn("__run", F.col("__i") - F.coalesce(F.max(F.when(F.col("__good"), F.col("__i"))).over(so_far), F.lit(0)))
    df = df.withColumn("__stops", F.count_if(F.col("__run") >= most_wasted).over(so_far) - (F.col("__run") >= most_wasted).cast("int"))
    df = df.where((F.col("__stops") == 0) & (F.col("__i") <= most_clicks))
    return df.groupBy(key).agg(
        F.count("*").alias("attempted"), F.count_if("__good").alias("meaningful_clicks"), F.count_if(~F.col("__good")).alias("wasted_clicks"),
        (F.max("__run") >= most_wasted).alias("stopped_early"), (F.count("*") >= most_clicks).alias("hit_limit"),
    )
