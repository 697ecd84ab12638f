"""Streaming forms: rate limits and sessions with keyed state, windows with watermarks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def timestamped(events: DataFrame, at: str) -> DataFrame:
    """Watermarks need timestamps with a time zone; event times without one are read as UTC."""
    return events.withColumn(at, F.col(at).cast("timestamp"))


def limited(requests: DataFrame, key: str, at: str, request_id: str, most: int, seconds: float, idle: str = "10 minutes") -> DataFrame:
    """key, request_id, allowed, retry_after of a stream; state: the times of allowed requests in the window.

    Rejected requests aren't recorded. The state of a key that is idle is dropped once the watermark
    has passed. Requests of one micro-batch are taken in order of time and id.
    """

    def run(keys, batches, state):
        times = list(state.get[0]) if state.exists else []
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values([at, request_id])
        out = []
        for when, rid in zip(rows[at], rows[request_id], strict=True):
            now = when.timestamp()
            times = [t for t in times if t >= now - seconds]
            allowed = len(times) < most
            out.append((keys[0], rid, allowed, 0.0 if allowed else times[0] + seconds - now))
            if allowed:
                times.append(now)
        state.update((times,))
        end = int(max(rows[at]).timestamp() * 1000) + int(seconds * 1000) + 1
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "request_id", "allowed", "retry_after"])

    stream = timestamped(requests, at).withWatermark(at, idle).select(F.col(key).cast("string").alias("key"), at, F.col(request_id).cast("long").alias(request_id))
    return stream.groupBy("key").applyInPandasWithState(run, "key string, request_id long, allowed boolean, retry_after double", "times array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def sessions(requests: DataFrame, key: str, at: str, ttl: str = "4 hours", late: str = "10 minutes") -> DataFrame:
    """Sessions that end ttl after their last request; emitted once the watermark has passed their end."""
    stream = timestamped(requests, at).withWatermark(at, late)
    w = F.session_window(at, ttl)
    return stream.groupBy(key, w.alias("w")).agg(F.count("*").alias("requests"), F.max(at).alias("last_seen")).select(key, F.col("w.start").alias("started"), "last_seen", "requests")


def windowed(events: DataFrame, kind: str, at: str, value: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    stream = timestamped(events, at).withWatermark(at, late)
    return stream.groupBy(kind, F.window(at, length).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(kind, F.col("w.start").alias("start"), "n", "total")
