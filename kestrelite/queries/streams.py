"""Streaming runs over the event tables, checked against the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelite.queries.membership import _HEALTH
from kestrelite.streaming.pipelines import (
    GAP_STATE, GAPS, HEALTH, HEALTH_STATE, gap_fold, health_fold, replicate, run_append, run_complete, run_fan_out, run_folded, sessions, stream_table, topic_counts, tumbling_means,
)

QUERIES: dict = {}
ORACLE: dict = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@register("SELECT CASE WHEN span IS NOT NULL THEN 'spans' WHEN stats IS NOT NULL THEN 'metrics' ELSE 'cluster' END AS topic, count(*) AS n FROM node_events GROUP BY 1")
def stream_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_complete(topic_counts(stream_table(spark, sf_dir, "node_events")), "stream-topics")


#: What a stream that has ended has told: windows that end before the newest event less ten minutes.
@register("""SELECT date_trunc('hour', ts) AS begins, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2
    HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of an hour, each told once, when it is closed."""
    out = run_append(tumbling_means(stream_table(spark, sf_dir, "events"), "ts", "event_type", "value", "1 hour", "10 minutes"), "stream-tumbling")
    return out.withColumn("mean", F.round("mean", 6))


@register("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id, min(ts) AS begins, count(*) AS n FROM s GROUP BY user_id, session HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user, each told once, when it is over."""
    return run_append(sessions(stream_table(spark, sf_dir, "events"), "ts", "user_id", "30 minutes", "10 minutes"), "stream-session")


@register(f"WITH {_HEALTH} SELECT node, event_id, misses, state FROM h")
def stream_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = stream_table(spark, sf_dir, "events").select(F.col("user_id").alias("node"), F.col("ts").cast("timestamp").alias("ts"), "event_id", (F.col("event_type") != "error").alias("alive"))
    return run_folded(p, health_fold, HEALTH_STATE, HEALTH, "stream-health")


@register("""WITH e AS (SELECT lower(trim(node_id, chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))) AS node_id, batch_id, t_mono_ns, seq FROM node_events),
    g AS (SELECT node_id, seq, seq - lag(seq) OVER (PARTITION BY node_id ORDER BY batch_id, t_mono_ns, seq) - 1 AS dropped FROM e) SELECT node_id, seq, dropped FROM g WHERE dropped > 0""")
def stream_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over a folder of one file the stream is one batch, in which arrivals are in order as in the batch query; tests run several."""
    return run_folded(stream_table(spark, sf_dir, "node_events"), gap_fold, GAP_STATE, GAPS, "stream-gaps")


@register("""SELECT topic, node_id, seq FROM (SELECT CASE WHEN span IS NOT NULL THEN 'spans' WHEN stats IS NOT NULL THEN 'metrics' ELSE 'cluster' END AS topic, node_id, seq FROM node_events) WHERE topic IN ('spans', 'cluster')""")
def stream_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the subscribers of two topics get of one stream."""
    sent = run_fan_out(stream_table(spark, sf_dir, "node_events").select("node_id", "seq", "span", "stats"), ["spans", "cluster"], "stream-fan-out")
    spans, cluster = (sent[t].select(F.lit(t).alias("topic"), "node_id", "seq") for t in ("spans", "cluster"))
    return spans.union(cluster)


@register("SELECT event_id, user_id, event_type, value FROM events")
def stream_replication(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replicate(stream_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), "stream-replication")
