"""Structured Streaming twins of the run metrics and of incremental dedup."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.tables import shared_dir


def events(spark: SparkSession, path: str) -> DataFrame:
    """The event table as a stream of its files. The path may be one file or a folder, which a pattern covers."""
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def finished(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all that is there and return what it wrote; state and output are in the shared folder.

    In complete mode a later batch replaces the output; in append mode it adds to it, each batch in a folder
    of its own, so that a batch that is run again after a failure replaces what it wrote.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    write = lambda df, batch: df.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/batch={batch}")
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out").select(*stream.columns)


def rolling_counts(stream: DataFrame, seconds: int = 30, every: int = 10) -> DataFrame:
    """Events of each sliding window; late events count up to a minute."""
    w = F.window("ts", f"{seconds} seconds", f"{every} seconds")
    return stream.withWatermark("ts", "1 minute").groupBy(w).agg(F.count("*").alias("events")).select(F.col("window.start").alias("window_start"), "events", (F.col("events") / F.lit(float(seconds))).alias("rate"))


def first_seen(stream: DataFrame, keys: list[str], within: str | None = None) -> DataFrame:
    """The keys of the stream, each once: of the whole stream, whose state is all keys, or once `within` an interval of `ts`, whose state is bounded."""
    if within is None:
        return stream.select(*keys).dropDuplicates(keys)
    return stream.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys).select(*keys)


def token_bucket(stream: DataFrame, key: str, rate: float) -> DataFrame:
    """event_id and wait_us of each request (event_id, key, ts) if a key sends `rate` a second and no bursts.

    The state of a key is when its last request went. A batch's requests of a key are put in order of time, so a
    batch must fit in memory by key: bound it with the source's maxFilesPerTrigger.
    """
    gap = int(1_000_000 / rate)

    def run(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        steps = np.arange(len(rows), dtype=np.int64) * gap
        at = rows["at"].to_numpy(np.int64)
        free = at - steps
        if state.exists:
            free[:1] = np.maximum(free[:1], state.get[0] + gap)
        go = np.maximum.accumulate(free) + steps
        state.update((int(go[-1]),))
        yield pd.DataFrame({"event_id": rows["event_id"].to_numpy(np.int64), "wait_us": go - at})

    rows = stream.select(key, "event_id", F.unix_micros("ts").alias("at"))
    return rows.groupBy(key).applyInPandasWithState(run, "event_id bigint, wait_us bigint", "last bigint", "append", GroupStateTimeout.NoTimeout)
