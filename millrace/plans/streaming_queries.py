"""Streams over the events table, run to their end; results equal those of a batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import ingest
from ..streaming.retries import retries
from .base import Registry, table

registry = Registry()
query = registry.query


def events(spark, sf_dir):
    return ingest.stream_of(spark, sf_dir, table(spark, sf_dir, "events").schema, files="events*")


def finished(spark, rows, name):
    out = ingest.place(spark, name)
    ingest.append(rows, out, ingest.place(spark, f"{name}-state"))
    return spark.read.parquet(out)


@query("SELECT event_id, user_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-20'")
def stream_watermark_ingest(spark, sf_dir):
    rows = ingest.fresh(events(spark, sf_dir), "2024-01-20").select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    return finished(spark, rows, "stream-ingest")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    rows = ingest.once(events(spark, sf_dir), ["user_id", "event_type"], "60 days")
    return finished(spark, rows.select("user_id", "event_type", "ts"), "stream-dedup").select("user_id", "event_type")


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def stream_merge(spark, sf_dir):
    out = ingest.place(spark, "stream-merge")
    ingest.upsert(events(spark, sf_dir).select("user_id", "event_id", "value"), ["user_id"], "event_id", out, ingest.place(spark, "stream-merge-state"))
    return ingest.newest(spark, out)


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE ts < (SELECT date_trunc('day', max(ts)) FROM events) GROUP BY 1, 2")
def stream_daily_counts(spark, sf_dir):
    rows = ingest.windowed(events(spark, sf_dir), "event_type", "10 minutes")
    done = finished(spark, rows, "stream-daily")
    return done.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("""WITH f AS (SELECT DISTINCT user_id AS entity_id, CASE event_type WHEN 'error' THEN 'NETWORK_ERROR' WHEN 'view' THEN 'SELECTOR_MISMATCH' WHEN 'click' THEN 'NOT_FOUND' ELSE 'OTHER' END AS reason_code, CAST(ts AS DATE) AS day FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY entity_id, reason_code ORDER BY day) - 1 AS retry_count FROM f),
d AS (SELECT *, CASE reason_code WHEN 'NETWORK_ERROR' THEN CASE WHEN retry_count >= 5 THEN 'DROP' ELSE 'RETRY' END WHEN 'SELECTOR_MISMATCH' THEN 'REPROCESS' WHEN 'NOT_FOUND' THEN 'DROP' ELSE 'WARN' END AS action FROM n)
SELECT entity_id, reason_code, day, CAST(retry_count AS INTEGER) AS retry_count, action, CAST(CASE WHEN action = 'RETRY' THEN day + 1 ELSE day END AS DATE) AS queue_day FROM d
WHERE day + INTERVAL 1 DAY < (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE
QUALIFY coalesce(sum(CASE WHEN action = 'DROP' THEN 1 END) OVER (PARTITION BY entity_id, reason_code ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0""")
def retry_stream(spark, sf_dir):
    reason = F.expr("CASE event_type WHEN 'error' THEN 'NETWORK_ERROR' WHEN 'view' THEN 'SELECTOR_MISMATCH' WHEN 'click' THEN 'NOT_FOUND' ELSE 'OTHER' END")
    fails = events(spark, sf_dir).select(F.col("user_id").alias("entity_id"), reason.alias("reason_code"), "ts")
    return finished(spark, retries(fails), "retry-stream")


QUERIES, ORACLES = registry.queries, registry.oracles
