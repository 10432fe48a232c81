"""Streams: new documents once, windows over events, and the pace of fetching by host."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def new_documents(stream: DataFrame, key: str = "sha256", time: str = "ingested_at", late: str = "30 days") -> DataFrame:
    """Each content hash once, as long as the watermark remembers it; rows without a hash are dropped."""
    return stream.where(F.col(key).isNotNull()).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def tumbling(stream: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts by window and keys, final once the watermark has passed."""
    counted = stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def sliding(stream: DataFrame, time: str, width: str, slide: str, late: str, *keys: str) -> DataFrame:
    counted = stream.withWatermark(time, late).groupBy(F.window(time, width, slide), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def sessions(stream: DataFrame, time: str, gap: str, late: str, *keys: str) -> DataFrame:
    counted = stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


MIN_INTERVAL, MAX_BACKOFF = 3.0, 60.0


def next_wait(backoff: float, status: int) -> tuple[float, float]:
    """The new backoff of a host and the wait until its next request, after an answer of that status.

    Refusals (429 and 5xx) double the backoff, from the least interval up to a minute; success clears it.
    """
    if status == 429 or status >= 500:
        backoff = min(MAX_BACKOFF, max(MIN_INTERVAL, backoff * 2))
    elif status < 400:
        backoff = 0.0
    return backoff, max(MIN_INTERVAL, backoff)


def paced(stream: DataFrame, host: str = "host", time: str = "ts", status: str = "status") -> DataFrame:
    """For every answer of a host, in order of time, when it may be asked again: ``host``, ``ts``, ``wait_s``."""

    def run(key: tuple[str], rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        backoff = state.get[0] if state.exists else 0.0
        for batch in rows:
            out = []
            for ts, code in batch.sort_values("ts")[["ts", "status"]].itertuples(index=False):
                backoff, wait = next_wait(backoff, int(code))
                out.append((key[0], ts, wait))
            yield pd.DataFrame(out, columns=["host", "ts", "wait_s"])
        state.update((backoff,))

    rows = stream.select(F.col(host).alias("host"), F.col(time).alias("ts"), F.col(status).alias("status")).where("host is not null and status is not null")
    return rows.groupBy("host").applyInPandasWithState(run, "host string, ts timestamp, wait_s double", "backoff double", "append", GroupStateTimeout.NoTimeout)


def append_ledger(stream: DataFrame, path: str, checkpoint: str):
    """An append-only ledger as parquet; restarts go on from the checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
