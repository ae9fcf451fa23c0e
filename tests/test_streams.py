"""Streams over hand-made files: late and repeated events, and the batch twins."""

import datetime as dt
import tempfile

from pyspark.sql import functions as F

from brandweave.streaming import events as op

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def at(text):
    return dt.datetime.fromisoformat(f"2024-01-{text}")


def folder_of(spark, *batches):
    folder = tempfile.mkdtemp(prefix="spark-events-")
    for rows in batches:
        spark.createDataFrame([(i, at(t), u, k, 1.0, "{}") for i, t, u, k in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    return folder


def test_late_events_are_left_out_and_windows_close(spark):
    # a batch is held against the watermark that the batch before the last one left
    folder = folder_of(spark, [(1, "01 10:00", 1, "view"), (2, "01 11:00", 1, "view")], [(3, "03 10:00", 1, "view")], [(5, "05 10:00", 1, "view")], [(4, "01 12:00", 1, "view"), (6, "05 11:00", 1, "view")])
    closed = op.run_stream(op.tumbling_counts(op.event_stream(spark, folder, per_trigger=1)))
    assert sorted((r.start.day, r.n) for r in closed.collect()) == [(1, 2), (3, 1)]


def test_repeats_are_dropped(spark):
    folder = folder_of(spark, [(1, "01 10:00", 1, "view"), (1, "01 10:00", 1, "view")], [(1, "01 10:00", 1, "view"), (2, "01 10:30", 1, "view")])
    assert sorted(r.event_id for r in op.run_stream(op.dedupe_stream(op.event_stream(spark, folder, per_trigger=1))).collect()) == [1, 2]


def test_sessions_include_a_gap_of_exactly_the_limit(spark):
    folder = folder_of(spark, [(1, "01 00:00", 1, "view"), (2, "01 03:59", 1, "view"), (3, "01 08:00", 1, "view"), (4, "01 00:00", 2, "view")])
    batch = spark.read.parquet(f"{folder}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted((r.user_id, r.n) for r in op.sessions(batch).collect()) == [(1, 1), (1, 2), (2, 1)]


def test_attribution_stream_equals_batch(spark, sf_dir):
    stream = op.run_stream(op.attributed_purchases(op.event_stream(spark, sf_dir)))
    batch = op.attributed_purchases(spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.collect()))


def test_spike_stream_equals_batch_but_for_open_windows(spark):
    rows, n = [], 0
    for day, count in enumerate([3, 4, 3, 4, 20, 3, 4], 1):
        for k in range(count):
            rows.append((n := n + 1, f"{day:02d} 10:{k:02d}", 1, "view"))
    rows.append((n + 1, "20 10:00", 1, "view"))
    folder = folder_of(spark, rows)
    batch = op.spikes(spark.read.parquet(f"{folder}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
    assert [(r.start.day, r.n) for r in batch.collect()] == [(5, 20)]
    stream = op.run_stream(op.spike_stream(op.event_stream(spark, folder)))
    assert [(r.start.day, r.n, r.mean) for r in stream.collect()] == [(5, 20, 3.5)]
