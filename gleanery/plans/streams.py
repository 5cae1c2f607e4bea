"""Streaming queries: each runs a stream over the table to its end and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.streaming import ingest as S


def stream_first_seen(spark, d):
    """Each URL of raw_pages once."""
    s = S.table_stream(spark, d, "raw_pages").select("url", "received_at")
    return S.run_to_table(S.first_seen(s, "url", "received_at", "3650 days"), "first-seen").select("url")


def stream_event_windows(spark, d):
    """Events by day and type."""
    s = S.table_stream(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    out = S.run_to_table(S.windowed_counts(s, "ts", ["event_type"], "1 day", delay="3650 days"), "event-windows", "complete")
    return out.select(F.unix_timestamp("w.start").alias("day"), "event_type", "n")


def stream_sessions(spark, d):
    """Sessions of users with gaps of 30 minutes at most."""
    s = S.table_stream(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    out = S.run_to_table(S.session_counts(s, "ts", "user_id", "30 minutes", "3650 days"), "sessions", "complete")
    return out.select("user_id", F.unix_micros("w.start").alias("start_us"), "n")


QUERIES = {f.__name__: f for f in (stream_first_seen, stream_event_windows, stream_sessions)}
SQL = {
    "stream_first_seen": "SELECT DISTINCT url FROM raw_pages",
    "stream_event_windows": "SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 1800000000 THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, k",
}
