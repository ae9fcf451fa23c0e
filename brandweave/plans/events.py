"""Event jobs and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from brandweave.sources.tables import read
from brandweave.streaming import events as op


def _events(spark, d):
    return read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


QUERIES = {
    "tumbling_counts": lambda spark, d: op.run_stream(op.tumbling_counts(op.event_stream(spark, d)), "complete"),
    "sliding_counts": lambda spark, d: op.run_stream(op.sliding_counts(op.event_stream(spark, d)), "complete"),
    "sessions": lambda spark, d: op.sessions(_events(spark, d)),
    "session_stream": lambda spark, d: op.run_stream(op.sessions(op.event_stream(spark, d))),
    "attributed_purchases": lambda spark, d: op.run_stream(op.attributed_purchases(op.event_stream(spark, d))),
    "last_view_before": lambda spark, d: op.last_view_before(_events(spark, d)),
    "dedupe_stream": lambda spark, d: op.run_stream(op.dedupe_stream(op.event_stream(spark, d))).select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts")),
    "spikes": lambda spark, d: op.spikes(_events(spark, d)),
    "spike_stream": lambda spark, d: op.run_stream(op.spike_stream(op.event_stream(spark, d))).withColumn("start", F.col("start").cast("timestamp_ntz")),
}

_SESSIONS = """
        WITH marked AS (
          SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 4 HOURS, true)::INT AS opens FROM events),
        numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM marked)
        SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM numbered GROUP BY user_id, session"""
_SPIKES = """
        WITH counts AS (SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2),
        rated AS (
          SELECT *, count(*) OVER w AS seen, avg(n) OVER w AS mean, stddev_pop(n) OVER w AS deviation
          FROM counts WINDOW w AS (PARTITION BY event_type ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT start, event_type, n, round(mean, 6) AS mean, round(deviation, 6) AS deviation FROM rated WHERE seen >= 3 AND n > mean + 2 * deviation"""
#: What a stream in append mode leaves open at its end: what ends after the latest event less an hour.
_MARK = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"

ORACLES = {
    "tumbling_counts": """
        SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, sum(cast(value AS decimal(18,6)))::DOUBLE AS value
        FROM events GROUP BY 1, 2""",
    "sliding_counts": """
        SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 6 HOURS AS start, event_type, count(*) AS n,
               sum(cast(value AS decimal(18,6)))::DOUBLE AS value
        FROM events, (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY 1, 2""",
    "sessions": _SESSIONS,
    "session_stream": f"SELECT * FROM ({_SESSIONS}) WHERE last + INTERVAL 4 HOURS <= {_MARK}",
    "attributed_purchases": """
        SELECT p.event_id AS purchase_id, v.event_id AS view_id, p.user_id
        FROM events p JOIN events v ON p.user_id = v.user_id AND v.ts <= p.ts AND v.ts >= p.ts - INTERVAL 6 HOURS
        WHERE p.event_type = 'purchase' AND v.event_type = 'view'""",
    "last_view_before": """
        SELECT purchase_id, user_id, view_id, view_ts FROM (
          SELECT p.event_id AS purchase_id, p.user_id, v.event_id AS view_id, v.ts AS view_ts,
                 row_number() OVER (PARTITION BY p.event_id ORDER BY v.ts DESC NULLS LAST, v.event_id DESC) AS place
          FROM events p LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND v.ts <= p.ts
          WHERE p.event_type = 'purchase') WHERE place = 1""",
    "dedupe_stream": "SELECT DISTINCT event_id, user_id, event_type, ts FROM events",
    "spikes": _SPIKES,
    "spike_stream": f"SELECT * FROM ({_SPIKES}) WHERE start + INTERVAL 1 DAY <= {_MARK}",
}
