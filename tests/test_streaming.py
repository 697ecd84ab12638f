"""Streams on the events table equal the batch forms on the same rows."""

import pytest
from pyspark.sql import functions as F

from pyrocast.operators import folds
from pyrocast.plans import streams
from pyrocast.streaming import keyed, requests


def run(spark, df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return spark.table(name)


def stream(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    path = str(tmp_path / "events")
    events.repartition(1).write.parquet(path)
    return events, spark.readStream.schema(events.schema).parquet(path)


def test_limiter(spark, sf_dir, tmp_path):
    events, source = stream(spark, sf_dir, tmp_path)
    got = run(spark, requests.limited(source, "user_id", "ts", "event_id", 2, 86400.0), "limited")
    want = folds.limit_rate(events, "user_id", "ts", "event_id", 2, 86400)
    assert {(r.request_id, r.allowed) for r in got.collect()} == {(r.event_id, r.allowed) for r in want.collect()}


def test_sessions_and_windows(spark, sf_dir, tmp_path):
    events, source = stream(spark, sf_dir, tmp_path)
    got = {(r.user_id, r.started, r.requests) for r in run(spark, requests.sessions(source, "user_id", "ts"), "sessions").collect()}
    batch = events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy("user_id", F.session_window("ts", "4 hours").alias("w")).agg(F.count("*").alias("n"))
    want = {(r.user_id, r.w.start, r.n) for r in batch.collect()}
    assert got <= want and len(got) > 0.8 * len(want)
    got = {(r.event_type, r.start, r.n) for r in run(spark, requests.windowed(source, "event_type", "ts", "value", "6 hours"), "windows").collect()}
    batch = events.groupBy("event_type", F.window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    want = {(r.event_type, r.w.start, r.n) for r in batch.collect()}
    assert {(a, c) for a, _, c in got} <= {(a, c) for a, _, c in want} and len(got) > 0.8 * len(want)


def in_order(spark, tmp_path, rows, by, parts=4):
    """rows as files of the order `by`, to be read one a batch."""
    path = tmp_path / "ordered"
    held = rows.orderBy(by).toPandas()
    step = -(-len(held) // parts)
    for i in range(parts):
        spark.createDataFrame(held[i * step : (i + 1) * step], rows.schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


@pytest.fixture
def stateful(spark):
    for k, v in keyed.STATE.items():
        spark.conf.set(k, v)
    yield spark
    for k in keyed.STATE:
        spark.conf.unset(k)


def test_chained_limits(stateful, sf_dir, tmp_path):
    """The stream of two limits equals the batch fold, over several batches; the address pays for what its sessions reject."""
    rows = streams.requests(stateful.read.parquet(f"{sf_dir}/events.parquet")).withColumn("ts", F.col("ts").cast("timestamp"))
    got = run(stateful, keyed.limited_twice(in_order(stateful, tmp_path, rows, "ts"), "event_id", "ts", "address", "session", 1, 86400.0), "twice")
    want = folds.limit_twice(rows, "event_id", "ts", "address", "session", 1, 86400)
    told = {(r.id, r.rejected_by, round(r.retry_after)) for r in want.collect()}
    assert {(r.id, r.rejected_by, round(r.retry_after)) for r in got.collect()} == told
    assert {x for _, x, _ in told} == {None, "address", "session"}


def test_swept_sessions(stateful, sf_dir, tmp_path):
    """Sessions of the stream equal those of the batch form, but for those that are still open."""
    rows = stateful.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    got = run(stateful, keyed.swept_sessions(in_order(stateful, tmp_path, rows, "ts", 5), "user_id", "ts", late="0 seconds"), "swept").collect()
    want = {(r.key, r.session, r.started, r.last_seen, r.requests) for r in folds.swept_sessions(rows, "user_id", "ts").collect()}
    found = [(r.key, r.session, r.started, r.last_seen, r.requests) for r in got]
    assert set(found) <= want and len(set(found)) == len(found) > 0.7 * len(want)
    last = max(x[3] for x in want)
    assert all((last - x[3]).total_seconds() < 86400 for x in want - set(found))


def test_sweeps(spark):
    """A request after the time to live, but before the sweep, finds its session; one after the sweep opens another."""
    start = 1_700_000_400 // 600 * 600  # of a sweep
    rows = [("a", 10), ("a", 10 + 14400 + 500), ("b", 10), ("b", 14400 + 600), ("c", 0), ("c", 14400 + 599), ("d", 0), ("d", 14400 + 600)]
    df = spark.createDataFrame([(k, start + s) for k, s in rows], "k string, s long").select("k", F.timestamp_seconds("s").alias("at"))
    got = folds.swept_sessions(df, "k", "at").groupBy("key").count().collect()
    assert {r.key: r["count"] for r in got} == {"a": 1, "b": 2, "c": 1, "d": 2}


def test_upsert_of_hourly_areas(spark, sf_dir, tmp_path):
    """A table merged batch by batch, out of order and with a batch that comes twice, equals the batch form."""
    orders, customers = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    points = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("zone"), F.timestamp_seconds(1_700_000_000 + F.pmod(F.col("o_orderkey") * 7919, F.lit(200_000))).alias("at"), (F.col("o_totalprice") / 500000).alias("fraction"))
    areas = customers.groupBy(F.col("c_nationkey").alias("zone")).agg((F.count("*") * 43560).alias("area"))
    path = str(tmp_path / "table")
    merge = keyed.upsert_into(path, ["zone", "hour", "day"], "at", "day")
    seen = []

    def both(batch, i):
        seen.append(i)
        merge(batch, i)
        if i == 1:
            merge(batch, i)

    stream = keyed.hourly_areas(in_order(spark, tmp_path, points, F.xxhash64("at")), areas, "zone", "at", "fraction")
    query = stream.writeStream.foreachBatch(both).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    want = keyed.latest(keyed.hourly_areas(points, areas, "zone", "at", "fraction"), ["zone", "hour", "day"], "at")
    key = lambda r: (r.zone, r.hour, r.day, r.at, r.acres)
    assert len(seen) == 4 and sorted(map(key, spark.read.parquet(path).collect())) == sorted(map(key, want.collect()))
