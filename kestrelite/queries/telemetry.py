"""Views of the event stream and of answered queries: topics, gaps, retention, rate caps, percentiles, layouts, joins.

Arrival order is (batch, monotonic time, sequence number). Copies of a delivery agree in all of these, so they may swap places without effect.
Running values over a node's events use ordered slices, as one node may have a third of all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrelite.functions.scalars import SPAN_ORDER, span_rank, topic_of, trace_hex, uniform_of
from kestrelite.operators.ordered import sliced, with_lag, with_number, with_running
from kestrelite.operators.redelivery import normalised_node
from kestrelite.operators.stream_views import element_at_rank, waterfall
from kestrelite.sources.tables import table

QUERIES: dict = {}
ORACLE: dict = {}
ARRIVAL = ["batch_id", "t_mono_ns", "seq"]


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_NODE = "lower(trim(node_id, chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)))"
_E = f"e AS (SELECT {_NODE} AS node_id, * EXCLUDE (node_id) FROM node_events)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "node_events").withColumn("node_id", normalised_node(F.col("node_id")))


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per span: a span that was delivered twice counts once."""
    s = _events(spark, sf_dir).where("span IS NOT NULL")
    return s.select("node_id", "seq", "t_mono_ns", trace_hex(F.col("span.trace_id")).alias("trace_id"), F.col("span.kind").alias("kind"), F.col("span.t_start_ns").alias("t0"), F.col("span.t_end_ns").alias("t1"), F.coalesce("span.shard_id", F.lit(0)).alias("shard_id")).distinct()


_S = f"""{_E}, s AS (SELECT DISTINCT node_id, seq, t_mono_ns, lower(hex(from_base64(span.trace_id))) AS trace_id, span.kind AS kind,
    span.t_start_ns AS t0, span.t_end_ns AS t1, coalesce(span.shard_id, 0) AS shard_id FROM e WHERE span IS NOT NULL)"""


@register(f"""WITH {_E} SELECT CASE WHEN span IS NOT NULL THEN 'spans' WHEN stats IS NOT NULL THEN 'metrics' ELSE 'cluster' END AS topic, count(*) AS n,
    count(DISTINCT node_id) AS nodes FROM e GROUP BY 1""")
def event_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return e.groupBy(topic_of(F.col("span"), F.col("stats")).alias("topic")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("node_id").alias("nodes"))


@register(f"""WITH {_E} SELECT node_id, seq, span.kind AS kind FROM e WHERE span IS NOT NULL""")
def topic_subscription(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a subscriber of the topic `spans` gets."""
    e = _events(spark, sf_dir)
    return e.where(topic_of(F.col("span"), F.col("stats")).isin("spans")).select("node_id", "seq", F.col("span.kind").alias("kind"))


@register(f"""WITH {_E}, g AS (SELECT node_id, seq, lag(seq) OVER (PARTITION BY node_id ORDER BY batch_id, t_mono_ns, seq) AS last FROM e)
    SELECT node_id, count(*) AS n, CAST(sum(greatest(coalesce(seq - last - 1, 0), 0)) AS BIGINT) AS dropped, count(*) FILTER (seq < last) AS restarts FROM g GROUP BY node_id""")
def seq_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers left out per node in order of arrival; a lower number resets the count and isn't a gap."""
    e = sliced(_events(spark, sf_dir).select("node_id", *ARRIVAL), ["node_id"], ARRIVAL)
    g = with_lag(e, ["node_id"], ARRIVAL, {"last": "seq"})
    gap = F.greatest(F.coalesce(F.col("seq") - F.col("last") - 1, F.lit(0)), F.lit(0))
    return g.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"), F.sum(gap).alias("dropped"), F.count_if(F.col("seq") < F.col("last")).alias("restarts"))


@register(f"WITH {_E} SELECT node_id, t_mono_ns, seq, row_number() OVER (PARTITION BY node_id ORDER BY t_mono_ns, seq) AS number FROM e")
def seq_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers 1, 2, ... per node in order of its own clock."""
    e = sliced(_events(spark, sf_dir).select("node_id", "t_mono_ns", "seq"), ["node_id"], ["t_mono_ns", "seq"])
    return with_number(e, ["node_id"], ["t_mono_ns", "seq"], "number").select("node_id", "t_mono_ns", "seq", "number")


_LATEST = f"""{_E}, l AS (SELECT node_id, arg_max(stats, (batch_id, t_mono_ns, seq)) AS s FROM e WHERE stats IS NOT NULL GROUP BY node_id)"""


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).where("stats IS NOT NULL")
    return e.groupBy("node_id").agg(F.max_by("stats", F.struct(*ARRIVAL)).alias("s"))


@register(f"""WITH {_LATEST} SELECT node_id, s.state AS state, coalesce(s.doc_count, 0) AS doc_count, coalesce(s.rss_bytes, 0) AS rss_bytes,
    coalesce(s.primary_seq, 0) - coalesce(s.applied_seq, 0) AS replication_lag FROM l""")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last writer wins, per node."""
    z = lambda c: F.coalesce(f"s.{c}", F.lit(0))
    return _latest(spark, sf_dir).select("node_id", "s.state", z("doc_count").alias("doc_count"), z("rss_bytes").alias("rss_bytes"), (z("primary_seq") - z("applied_seq")).alias("replication_lag"))


@register(f"""WITH {_LATEST} SELECT count(*) AS nodes, CAST(sum(coalesce(s.doc_count, 0)) AS BIGINT) AS docs, CAST(sum(coalesce(s.edge_count, 0)) AS BIGINT) AS edges,
    CAST(sum(coalesce(s.rss_bytes, 0)) AS BIGINT) AS rss FROM l""")
def cluster_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = lambda c: F.sum(F.coalesce(f"s.{c}", F.lit(0)))
    return _latest(spark, sf_dir).agg(F.count(F.lit(1)).alias("nodes"), z("doc_count").alias("docs"), z("edge_count").alias("edges"), z("rss_bytes").alias("rss"))


@register(f"""WITH {_E}, d AS (SELECT DISTINCT node_id, seq, t_mono_ns, coalesce(stats.rss_bytes, 0) AS rss FROM e WHERE stats IS NOT NULL)
    SELECT node_id, seq, t_mono_ns, rss FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY t_mono_ns DESC, seq DESC, rss DESC) AS r FROM d) WHERE r <= 60""")
def rss_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 60 memory samples of each node."""
    d = _events(spark, sf_dir).where("stats IS NOT NULL").select("node_id", "seq", "t_mono_ns", F.coalesce("stats.rss_bytes", F.lit(0)).alias("rss")).distinct()
    w = Window.partitionBy("node_id").orderBy(F.desc("t_mono_ns"), F.desc("seq"), F.desc("rss"))
    return d.withColumn("r", F.row_number().over(w)).where("r <= 60").drop("r")


@register(f"WITH {_E} SELECT batch_id, t_mono_ns, seq, node_id FROM e ORDER BY batch_id DESC, t_mono_ns DESC, seq DESC, node_id DESC LIMIT 5000")
def recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 5,000 events, what a bounded store keeps."""
    e = _events(spark, sf_dir).select("batch_id", "t_mono_ns", "seq", "node_id")
    return e.orderBy(*[F.desc(c) for c in e.columns]).limit(5000)


@register(f"""WITH {_S}, f AS (SELECT trace_id, min(t0) AS first_seen FROM s GROUP BY trace_id ORDER BY first_seen DESC, trace_id LIMIT 50)
    SELECT trace_id, count(*) AS spans, first_seen FROM s JOIN f USING (trace_id) GROUP BY trace_id, first_seen""")
def trace_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the 50 traces that appeared last."""
    s = _spans(spark, sf_dir)
    f = s.groupBy("trace_id").agg(F.min("t0").alias("first_seen")).orderBy(F.desc("first_seen"), "trace_id").limit(50)
    return s.join(F.broadcast(f), "trace_id").groupBy("trace_id", "first_seen").agg(F.count(F.lit(1)).alias("spans"))


@register(f"""WITH {_S}, b AS (SELECT node_id, trace_id, min(t1) AS t FROM s WHERE kind = 'SPAN_SHARD_SEARCH' GROUP BY node_id, trace_id)
    SELECT node_id, trace_id, t FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY t DESC, trace_id) AS r FROM b) WHERE r <= 16""")
def blob_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 16 traces that each node holds; of a trace the first write counts."""
    b = _spans(spark, sf_dir).where("kind = 'SPAN_SHARD_SEARCH'").groupBy("node_id", "trace_id").agg(F.min("t1").alias("t"))
    w = Window.partitionBy("node_id").orderBy(F.desc("t"), "trace_id")
    return b.withColumn("r", F.row_number().over(w)).where("r <= 16").drop("r")


@register(f"""WITH RECURSIVE {_S}, o AS (SELECT node_id, t0 AS t, row_number() OVER (PARTITION BY node_id ORDER BY t0) AS k FROM s WHERE kind = 'SPAN_SHARD_SEARCH'),
    r AS (SELECT node_id, k, [t] AS g, 1 AS granted FROM o WHERE k = 1
          UNION ALL
          SELECT o.node_id, o.k, CASE WHEN len(list_filter(r.g, lambda x: o.t - x <= 1000000000)) < 5 THEN list_append(list_filter(r.g, lambda x: o.t - x <= 1000000000), o.t)
                 ELSE list_filter(r.g, lambda x: o.t - x <= 1000000000) END, CASE WHEN len(list_filter(r.g, lambda x: o.t - x <= 1000000000)) < 5 THEN 1 ELSE 0 END
          FROM r JOIN o ON o.node_id = r.node_id AND o.k = r.k + 1)
    SELECT node_id, count(*) AS requests, CAST(sum(granted) AS BIGINT) AS granted FROM r GROUP BY node_id""")
def rate_cap_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most five grants within a second, per node. A pause of more than a second ends all grants, so each run between pauses is folded alone."""
    from kestrelite.operators.stream_views import grants_per_run

    return grants_per_run(_spans(spark, sf_dir).where("kind = 'SPAN_SHARD_SEARCH'"), "node_id", "t0", 5, 1_000_000_000)


@register(f"""WITH {_E}, d AS (SELECT DISTINCT node_id, t_mono_ns, seq, coalesce(stats.applied_seq, 0) AS total FROM e WHERE stats IS NOT NULL),
    l AS (SELECT *, lag(total) OVER w AS n0, lag(t_mono_ns) OVER w AS t0 FROM d WINDOW w AS (PARTITION BY node_id ORDER BY t_mono_ns, seq, total))
    SELECT node_id, t_mono_ns, seq, total, round((total - n0) / ((t_mono_ns - t0) / 1e9), 6) AS per_second FROM l WHERE t_mono_ns > t0 AND total >= n0""")
def rate_between_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a node's running total of applied messages grew by a second between two statistics ticks; a total that fell was started anew."""
    d = _events(spark, sf_dir).where("stats IS NOT NULL").select("node_id", "t_mono_ns", "seq", F.coalesce("stats.applied_seq", F.lit(0)).alias("total")).distinct()
    order = ["t_mono_ns", "seq", "total"]
    g = with_lag(sliced(d, ["node_id"], order), ["node_id"], order, {"n0": "total", "t0": "t_mono_ns"})
    return g.where("t_mono_ns > t0 AND total >= n0").select("node_id", *order, F.round((F.col("total") - F.col("n0")) / ((F.col("t_mono_ns") - F.col("t0")) / 1e9), 6).alias("per_second"))


_LAST = """l AS (SELECT node_id, timings.total_us AS us FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY answered_at DESC, trace_id, recorded_at) AS r
    FROM responses WHERE timings.total_us IS NOT NULL) WHERE r <= 1024)"""


@register(f"""WITH {_LAST}, o AS (SELECT node_id, list_sort(list(us)) AS v, count(*) AS n, quantile_cont(us, 0.5) AS p50_interpolated, quantile_cont(us, 0.99) AS p99_interpolated FROM l GROUP BY node_id)
    SELECT node_id, n, round(p50_interpolated, 6) AS p50_interpolated, round(p99_interpolated, 6) AS p99_interpolated,
           v[CAST(floor(0.5 * (n - 1)) AS INTEGER) + 1] AS p50_element, v[CAST(floor(0.99 * (n - 1)) AS INTEGER) + 1] AS p99_element,
           v[CAST(least(n - 1, floor(n * 0.99)) AS INTEGER) + 1] AS p99_capped FROM o""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three definitions of a percentile over each coordinator's last 1,024 answers."""
    w = Window.partitionBy("node_id").orderBy(F.desc("answered_at"), "trace_id", "recorded_at")
    r = table(spark, sf_dir, "responses").select("node_id", "answered_at", "trace_id", "recorded_at", F.col("timings.total_us").alias("us")).where("us IS NOT NULL")
    last = r.withColumn("r", F.row_number().over(w)).where("r <= 1024")
    g = last.groupBy("node_id").agg(F.sort_array(F.collect_list("us")).alias("v"), F.count(F.lit(1)).alias("n"), F.percentile("us", 0.5).alias("a"), F.percentile("us", 0.99).alias("b"))  # at most 1,024 a node
    n = F.col("n")
    return g.select(
        "node_id", "n", F.round("a", 6).alias("p50_interpolated"), F.round("b", 6).alias("p99_interpolated"),
        element_at_rank("v", F.floor(0.5 * (n - 1))).alias("p50_element"), element_at_rank("v", F.floor(0.99 * (n - 1))).alias("p99_element"),
        element_at_rank("v", F.least(n - 1, F.floor(n * 0.99))).alias("p99_capped"),
    )


_RANK = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(SPAN_ORDER)) + f" ELSE {len(SPAN_ORDER)} END"


@register(f"""WITH {_S}, b AS (SELECT trace_id, min(t0) AS a, greatest(1, max(t1) - min(t0)) AS span FROM s GROUP BY trace_id)
    SELECT trace_id, node_id, seq, kind, shard_id, CAST({_RANK} AS INTEGER) AS kind_rank, round((t0 - a) / span, 9) AS left_at, round(greatest(0.002, (t1 - t0) / span), 9) AS width, (t1 - t0) // 1000 AS us
    FROM s JOIN b USING (trace_id)""")
def waterfall_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place and width of each span of a trace, as fractions of the trace."""
    return waterfall(_spans(spark, sf_dir)).select("trace_id", "node_id", "seq", "kind", "shard_id", span_rank(F.col("kind")).alias("kind_rank"), F.round("left_at", 9).alias("left_at"), F.round("width", 9).alias("width"), F.expr("(t1 - t0) div 1000").alias("us"))


@register(f"""WITH {_S}, b AS (SELECT trace_id, min(t0) AS a FROM s GROUP BY trace_id) SELECT trace_id, count(*) FILTER ((t0 - a) // 1000 <= 2000) AS visible, count(*) AS spans FROM s JOIN b USING (trace_id) GROUP BY trace_id""")
def visible_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many spans of a trace have begun 2 ms after its start."""
    s = _spans(spark, sf_dir)
    b = s.groupBy("trace_id").agg(F.min("t0").alias("a"))
    return s.join(b, "trace_id").groupBy("trace_id").agg(F.count_if(F.expr("(t0 - a) div 1000 <= 2000")).alias("visible"), F.count(F.lit(1)).alias("spans"))


_PLAN = f"""{_E}, p AS (SELECT DISTINCT node_id, batch_id, t_mono_ns, seq, CAST(json_extract_string(span.detail_json, '$.epoch') AS BIGINT) AS epoch FROM e WHERE span.kind = 'SPAN_PLAN')"""


def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).where("span.kind = 'SPAN_PLAN'")
    return e.select("node_id", *ARRIVAL, F.get_json_object("span.detail_json", "$.epoch").cast("long").alias("epoch")).distinct()


@register(f"""WITH {_PLAN}, m AS (SELECT *, max(epoch) OVER (PARTITION BY node_id ORDER BY batch_id, t_mono_ns, seq, epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM p)
    SELECT node_id, batch_id, t_mono_ns, seq, epoch, seen, epoch < seen AS stale FROM m""")
def stale_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans made with an epoch below one that the node had seen before."""
    order = [*ARRIVAL, "epoch"]
    m = with_running(sliced(_plans(spark, sf_dir), ["node_id"], order), ["node_id"], order, "seen", F.col("epoch"), "max")
    return m.select("node_id", *order, "seen", (F.col("epoch") < F.col("seen")).alias("stale"))


@register(f"""WITH {_LATEST}, m AS (SELECT shard_id, primary_node, backup_node FROM shard_map WHERE epoch = (SELECT max(epoch) FROM shard_map))
    SELECT shard_id, primary_node, backup_node, greatest(coalesce(p.s.primary_seq, 0) - coalesce(b.s.applied_seq, 0), 0) AS behind
    FROM m LEFT JOIN l p ON p.node_id = primary_node LEFT JOIN l b ON b.node_id = backup_node WHERE backup_node IS NOT NULL""")
def replication_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each shard's backup is behind its primary, by their last statistics."""
    m = table(spark, sf_dir, "shard_map")
    m = m.join(F.broadcast(m.agg(F.max("epoch").alias("epoch"))), "epoch").where("backup_node IS NOT NULL").select("shard_id", "primary_node", "backup_node")
    last = _latest(spark, sf_dir)
    p = last.select(F.col("node_id").alias("primary_node"), F.col("s.primary_seq").alias("ahead"))
    b = last.select(F.col("node_id").alias("backup_node"), F.col("s.applied_seq").alias("applied"))
    out = m.join(p, "primary_node", "left").join(b, "backup_node", "left")
    return out.select("shard_id", "primary_node", "backup_node", F.greatest(F.coalesce("ahead", F.lit(0)) - F.coalesce("applied", F.lit(0)), F.lit(0)).alias("behind"))


@register(f"""WITH {_E}, l AS (SELECT node_id, max(emitted_at) AS last_seen FROM e GROUP BY node_id), n AS (SELECT max(last_seen) AS now FROM l)
    SELECT node_id, last_seen, date_diff('microsecond', last_seen, now) > 2500000 AS down, round(pow(0.5, date_diff('microsecond', last_seen, now) / 1000.0 / 1500), 9) AS glow FROM l, n WHERE last_seen IS NOT NULL""")
def member_liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node is down after 2.5 s of silence; its glow halves every 1.5 s."""
    last = _events(spark, sf_dir).groupBy("node_id").agg(F.max("emitted_at").cast("timestamp").alias("last_seen")).where("last_seen IS NOT NULL")
    now = last.agg(F.max("last_seen").alias("now"))  # one row
    silent = F.unix_micros("now") - F.unix_micros("last_seen")
    return last.join(F.broadcast(now)).select("node_id", F.col("last_seen").cast("timestamp_ntz").alias("last_seen"), (silent > 2_500_000).alias("down"), F.round(F.pow(F.lit(0.5), silent / 1000.0 / 1500), 9).alias("glow"))


@register(f"""WITH {_S}, o AS (SELECT trace_id, row_number() OVER (ORDER BY t_mono_ns, node_id, seq) - 1 AS idx, count(*) OVER () AS n FROM s)
    SELECT trace_id, max(idx) AS fires_at, round(max(idx) / max(n), 9) AS fraction FROM o GROUP BY trace_id""")
def replay_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When a replay shows each trace's result: at the index of its last span, as a fraction of all."""
    s = _spans(spark, sf_dir).select("trace_id", "t_mono_ns", "node_id", "seq")
    order = ["t_mono_ns", "node_id", "seq"]
    o = with_number(sliced(s, [], order), [], order, "number")
    n = s.count()
    return o.groupBy("trace_id").agg((F.max("number") - 1).alias("fires_at")).withColumn("fraction", F.round(F.col("fires_at") / F.lit(n), 9))


CHAPTERS = ((0, "warm-up"), (3_600_000, "steady"), (43_200_000, "failover"), (172_800_000, "recovery"))


@register("""WITH c AS (SELECT * FROM (VALUES (0, 'warm-up'), (3600000, 'steady'), (43200000, 'failover'), (172800000, 'recovery')) t(t_ms, label)),
    o AS (SELECT trace_id, recorded_at, date_diff('microsecond', (SELECT min(answered_at) FROM responses), answered_at) // 1000 AS at_ms FROM responses)
    SELECT trace_id, recorded_at, (SELECT arg_max(label, t_ms) FROM c WHERE t_ms <= at_ms) AS chapter FROM o""")
def chapter_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chapter that an answer falls in: the last one that began by then."""
    r = table(spark, sf_dir, "responses").select("trace_id", "recorded_at", F.unix_micros(F.col("answered_at").cast("timestamp")).alias("us"))
    at = r.join(F.broadcast(r.agg(F.min("us").alias("u0")))).withColumn("at_ms", F.expr("(us - u0) div 1000"))
    chapter = F.lit(None).cast("string")
    for t, label in CHAPTERS:
        chapter = F.when(F.col("at_ms") >= t, label).otherwise(chapter)
    return at.select("trace_id", "recorded_at", chapter.alias("chapter"))


@register(f"""WITH {_S}, a AS (SELECT trace_id, min(answered_at) AS answered_at FROM responses GROUP BY trace_id)
    SELECT trace_id, answered_at, count(*) AS spans, min(t0) AS first_ns FROM s JOIN a USING (trace_id) GROUP BY trace_id, answered_at""")
def trace_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded results with the spans of their trace."""
    a = table(spark, sf_dir, "responses").groupBy("trace_id").agg(F.min("answered_at").alias("answered_at"))
    s = _spans(spark, sf_dir).groupBy("trace_id").agg(F.count(F.lit(1)).alias("spans"), F.min("t0").alias("first_ns"))
    return a.join(s, "trace_id").select("trace_id", "answered_at", "spans", "first_ns")


@register(f"WITH {_S} SELECT DISTINCT trace_id, node_id, shard_id FROM s WHERE kind = 'SPAN_SHARD_SEARCH'")
def span_holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which node holds the trace of which shard."""
    return _spans(spark, sf_dir).where("kind = 'SPAN_SHARD_SEARCH'").select("trace_id", "node_id", "shard_id").distinct()


@register(f"""WITH {_E} SELECT DISTINCT node_id, seq, t_mono_ns, span.kind AS kind, CAST(json_extract_string(span.detail_json, '$.visited') AS BIGINT) AS visited,
    CAST(json_extract_string(span.detail_json, '$.k') AS BIGINT) AS k, CAST(json_extract_string(span.detail_json, '$.ef') AS BIGINT) AS ef, json_extract_string(span.detail_json, '$.status') AS status
    FROM e WHERE span IS NOT NULL""")
def json_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details of spans, however the JSON was written."""
    e = _events(spark, sf_dir).where("span IS NOT NULL")
    d = F.from_json("span.detail_json", "visited bigint, k bigint, ef bigint, status string")
    return e.select("node_id", "seq", "t_mono_ns", F.col("span.kind").alias("kind"), d.alias("d")).select("node_id", "seq", "t_mono_ns", "kind", "d.visited", "d.k", "d.ef", "d.status").distinct()


@register("""WITH g AS (SELECT coverage.probed AS probed, count(*) AS n, quantile_cont(timings.total_us, 0.5) AS p50, avg(coalesce(visited_total, 0)) AS visited FROM responses WHERE timings.total_us IS NOT NULL GROUP BY 1),
    b AS (SELECT p50 AS base FROM g ORDER BY probed DESC LIMIT 1)
    SELECT probed, n, round(p50, 6) AS p50, round(visited, 6) AS mean_visited, round(100 * (p50 - base) / base, 6) AS over_percent FROM g, b""")
def overhead_by_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median time per number of probed shards, and by how much it differs from probing all."""
    r = table(spark, sf_dir, "responses").where("timings.total_us IS NOT NULL")
    g = r.groupBy(F.col("coverage.probed").alias("probed")).agg(F.count(F.lit(1)).alias("n"), F.percentile("timings.total_us", 0.5).alias("p50"), F.avg(F.coalesce("visited_total", F.lit(0))).alias("visited"))
    base = g.orderBy(F.desc("probed")).limit(1).select(F.col("p50").alias("base"))
    return g.join(F.broadcast(base)).select("probed", "n", F.round("p50", 6).alias("p50"), F.round("visited", 6).alias("mean_visited"), F.round(100 * (F.col("p50") - F.col("base")) / F.col("base"), 6).alias("over_percent"))


@register("""WITH r AS (SELECT trace_id, min(answered_at) AS t, max(coverage.probed) AS probed, min(coverage.answered) AS answered, max(timings.total_us) AS us FROM responses GROUP BY trace_id),
    k AS (SELECT min(t) FILTER (answered < probed) AS kill, max(t) FILTER (answered < probed) AS heal, max(t) AS fin FROM r)
    SELECT count(*) AS queries, count(*) FILTER (t < kill) AS before, count(*) FILTER (answered < probed) AS degraded, count(*) FILTER (answered > probed) AS impossible,
           date_diff('microsecond', any_value(kill), any_value(heal)) AS recovery_us, max(us) FILTER (t > fin - INTERVAL 1 HOUR) AS tail_max_us FROM r, k""")
def failover_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run with failures in figures: degraded answers, time from the first to the last of them, the tail after."""
    r = table(spark, sf_dir, "responses").groupBy("trace_id").agg(F.min("answered_at").cast("timestamp").alias("t"), F.max("coverage.probed").alias("probed"), F.min("coverage.answered").alias("answered"), F.max("timings.total_us").alias("us"))
    part = F.col("answered") < F.col("probed")
    k = r.agg(F.min(F.when(part, F.col("t"))).alias("kill"), F.max(F.when(part, F.col("t"))).alias("heal"), F.max("t").alias("fin"))  # one row
    return r.join(F.broadcast(k)).agg(
        F.count(F.lit(1)).alias("queries"), F.count_if(F.col("t") < F.col("kill")).alias("before"), F.count_if(part).alias("degraded"), F.count_if(F.col("answered") > F.col("probed")).alias("impossible"),
        (F.unix_micros(F.max("heal")) - F.unix_micros(F.max("kill"))).alias("recovery_us"), F.max(F.when(F.col("t") > F.col("fin") - F.expr("INTERVAL 1 HOUR"), F.col("us"))).alias("tail_max_us"),
    )


def _uniform(*parts: str) -> str:
    return f"((CAST('0x' || substr(md5({' || chr(124) || '.join(parts)}), 1, 8) AS BIGINT) + 0.5) / 4294967296.0)"


@register(f"""WITH w AS (SELECT qid, CAST(floor(1e12 / pow(qid + 1, 1.1)) AS BIGINT) AS weight FROM queries),
    c AS (SELECT qid, sum(weight) OVER (ORDER BY qid ROWS UNBOUNDED PRECEDING) AS upto FROM w), t AS (SELECT sum(weight) AS total FROM w),
    d AS (SELECT qid AS draw, CAST(ceil({_uniform("'zipf'", "CAST(qid AS VARCHAR)")} * total) AS BIGINT) AS r FROM queries, t)
    SELECT draw, min(c.qid) AS picked FROM d ASOF JOIN c ON d.r <= c.upto GROUP BY draw""")
def zipf_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draw of a query per query, by Zipf weights: the first whose running weight reaches the drawn number."""
    from kestrelite.operators.stream_views import first_at_or_above

    w = table(spark, sf_dir, "queries").select("qid", F.floor(1e12 / F.pow(F.col("qid") + 1, F.lit(1.1))).cast("long").alias("weight"))
    c = with_running(sliced(w, [], ["qid"]), [], ["qid"], "upto", F.col("weight"), "sum").select("qid", "upto")
    total = w.agg(F.sum("weight")).first()[0] or 0
    d = table(spark, sf_dir, "queries").select(F.col("qid").alias("draw"), F.ceil(uniform_of(F.lit("zipf"), F.col("qid")) * F.lit(float(total))).cast("long").alias("r"))
    return first_at_or_above(d, "draw", "r", c, "qid", "upto").select("draw", F.col("qid").alias("picked"))


@register(f"""WITH a AS (SELECT qid, CAST(round(-ln(1 - {_uniform("'poisson'", 'CAST(qid AS VARCHAR)')}) / 20 * 1e6) AS BIGINT) AS gap_us FROM queries)
    SELECT qid, CAST(sum(gap_us) OVER (ORDER BY qid ROWS UNBOUNDED PRECEDING) AS BIGINT) AS at_us FROM a""")
def poisson_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrival times of queries at 20 a second, from exponential gaps in whole microseconds."""
    a = table(spark, sf_dir, "queries").select("qid", F.round(-F.log(1 - uniform_of(F.lit("poisson"), F.col("qid"))) / 20 * 1e6).cast("long").alias("gap_us"))
    return with_running(sliced(a, [], ["qid"]), [], ["qid"], "at_us", F.col("gap_us"), "sum").select("qid", "at_us")


@register(f"SELECT qid, md5(CAST(qid AS VARCHAR)) AS trace_id FROM queries WHERE {_uniform(chr(39) + 'fault' + chr(39), 'CAST(qid AS VARCHAR)')} >= 0.2")
def fault_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that get through a shard that drops a fifth of them, with their trace ids."""
    return table(spark, sf_dir, "queries").where(uniform_of(F.lit("fault"), F.col("qid")) >= 0.2).select("qid", F.md5(F.col("qid").cast("string")).alias("trace_id"))
