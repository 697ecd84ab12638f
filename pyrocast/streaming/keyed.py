"""Streams with keyed state: two chained rate limits, sessions with a time to live and a sweeper, upserts of a running table.

State lives by key in the state store, with timers that drop or end it; the session needs
spark.sql.streaming.stateStore.providerClass set to the RocksDB provider (see conf).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ..session import written
from .requests import timestamped

#: Settings that keyed state needs.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
_TIMES = StructType([StructField("times", ArrayType(DoubleType()))])
_SESSION = StructType([StructField("started", LongType()), StructField("last", LongType()), StructField("requests", LongType()), StructField("number", LongType())])


class _Limiter(StatefulProcessor):
    """Of the rows of a key in order of time and id, at most `most` allowed ones in any window; rows with an empty key, or rejected before, pass as they are."""

    def __init__(self, key: str, stage: str, most: int, seconds: float):
        self.key, self.stage, self.most, self.seconds = key, stage, most, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.times = handle, handle.getValueState("times", _TIMES)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["at", "id"], kind="stable")
        times = list(self.times.get()[0]) if self.times.exists() else []
        allowed, stages, retry = [], [], []
        for row in pdf.itertuples():
            if not row.allowed or not getattr(row, self.key):
                allowed.append(row.allowed)
                stages.append(row.rejected_by)
                retry.append(row.retry_after)
                continue
            now = row.at.timestamp()
            times = [t for t in times if t >= now - self.seconds]
            free = len(times) < self.most
            allowed.append(free)
            stages.append(None if free else self.stage)
            retry.append(0.0 if free else max(0.0, times[0] + self.seconds - now))
            if free:
                times.append(now)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if times:
            self.times.update((times,))
            self.handle.registerTimer(int((times[-1] + self.seconds) * 1000) + 1)
        yield pdf.assign(allowed=allowed, rejected_by=pd.Series(stages, pdf.index, dtype=object), retry_after=retry)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """No time counts any more: the key's state goes."""
        self.times.clear()
        yield from ()

    def close(self) -> None:
        pass


_LIMITED = "id long, at timestamp, address string, session string, allowed boolean, rejected_by string, retry_after double"


def limited_twice(requests: DataFrame, request_id: str, at: str, address: str, session: str, most: int, seconds: float, idle: str = "10 minutes") -> DataFrame:
    """id, at, address, session, allowed, rejected_by ('address' or 'session'), retry_after of a stream of requests.

    First at most `most` allowed requests of an address in any window of so many seconds; then the same of a
    session, among those that its address allows. A request that the session's limit rejects has used the address'
    quota all the same. Rejected requests aren't recorded. Requests without a session pass the second limit.
    Requests of one micro-batch are taken in order of time and id; state of keys that are idle is dropped.
    """
    rows = timestamped(requests, at).withWatermark(at, idle)
    fresh = [F.lit(True).alias("allowed"), F.lit(None).cast("string").alias("rejected_by"), F.lit(0.0).alias("retry_after")]
    rows = rows.select(F.col(request_id).cast("long").alias("id"), F.col(at).alias("at"), F.coalesce(F.col(address).cast("string"), F.lit("")).alias("address"), F.coalesce(F.col(session).cast("string"), F.lit("")).alias("session"), *fresh)
    for key in ("address", "session"):
        rows = rows.groupBy(key).transformWithStateInPandas(_Limiter(key, key, most, seconds), _LIMITED, "Append", "EventTime", eventTimeColumnName="at")
    return rows


class _Sessions(StatefulProcessor):
    """The open session of a key; it ends at the first sweep more than `ttl` after its last request."""

    def __init__(self, ttl: float, sweep: float):
        self.ttl, self.sweep = int(ttl * 1_000_000), int(sweep * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open = handle, handle.getValueState("open", _SESSION)

    def _end(self, last: int) -> int:
        """The sweep that ends a session: the first that is later than last + ttl."""
        return ((last + self.ttl) // self.sweep + 1) * self.sweep

    def _row(self, key, started: int, last: int, requests: int, number: int) -> pd.DataFrame:
        stamp = lambda x: pd.Timestamp(x, unit="us")
        return pd.DataFrame({"key": [key[0]], "session": [number], "started": [stamp(started)], "last_seen": [stamp(last)], "requests": [requests]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at = sorted(int(t.timestamp() * 1_000_000 + 0.5) for pdf in rows for t in pdf["at"])
        now = list(self.open.get()) if self.open.exists() else None
        for t in at:
            if now is not None and now[2] and t >= self._end(now[1]):
                yield self._row(key, *now)
                now = [t, t, 1, now[3] + 1]
            elif now is None or not now[2]:
                now = [t, t, 1, now[3] + 1 if now else 1]
            else:
                now = [min(now[0], t), max(now[1], t), now[2] + 1, now[3]]
        self.open.update(tuple(now))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(self._end(now[1]) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The session's row; of the key only the number of its sessions stays."""
        now = self.open.get()
        self.open.update((0, 0, 0, now[3]))
        yield self._row(key, *now)

    def close(self) -> None:
        pass


def swept_sessions(requests: DataFrame, key: str, at: str, ttl: float = 4 * 3600, sweep: float = 600, late: str = "10 minutes") -> DataFrame:
    """key, session (from 1), started, last_seen, requests of each session of a stream, once it has ended.

    A sweeper runs every `sweep` seconds and ends sessions whose last request is more than ttl seconds back; a
    request that comes before the sweeper still finds its session. What is open when the stream ends isn't given.
    """
    rows = timestamped(requests, at).withWatermark(at, late).select(F.col(key).cast("string").alias("key"), F.col(at).alias("at"))
    shape = "key string, session long, started timestamp, last_seen timestamp, requests long"
    return rows.groupBy("key").transformWithStateInPandas(_Sessions(ttl, sweep), shape, "Append", "EventTime")


def upsert_into(path: str, keys: list[str], at: str, part: str):
    """A function for foreachBatch that merges a batch into the Parquet table at path, partitioned by `part`: of each key the row with the latest `at` stays.

    Only partitions that the batch has rows of are read and written. Merging is the same however often a
    batch comes: a batch that runs again, or comes late, changes nothing that later rows have settled. `part` depends on keys alone.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = written(latest(batch, keys, at))
        touched = [r[0] for r in new.select(part).distinct().collect()]  # the partitions of one batch
        if not touched:
            return
        merged = new
        if exists(spark, path):
            old = spark.read.schema(new.schema).parquet(path).filter(F.col(part).isin(touched))
            merged = written(latest(new.unionByName(old), keys, at))
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)

    return merge


def latest(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Of each key the row with the latest `at`, of equal ones that with the largest other values."""
    rest = [c for c in rows.columns if c not in keys and c != at]
    best = rows.groupBy(*keys).agg(F.max(F.struct(at, *rest)).alias("__b"))
    return best.select(*[F.col(c) if c in keys else F.col(f"__b.{c}").alias(c) for c in rows.columns])


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at path, in any file system that the session knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def hourly_areas(points: DataFrame, areas: DataFrame, zone: str, at: str, fraction: str) -> DataFrame:
    """zone, hour, day, at, acres of a stream of burnt fractions: ceil(area * fraction / 1000) with the zone's own area (zone, area)."""
    rows = timestamped(points, at).join(areas, zone)
    hour = F.date_trunc("hour", F.col(at))
    return rows.select(zone, hour.alias("hour"), F.to_date(hour).alias("day"), F.col(at).alias("at"), F.ceil(F.col("area") * F.col(fraction) / 1000).cast("long").alias("acres"))
