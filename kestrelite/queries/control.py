"""Control plane: storms and failovers, quorum and audits, members, stages, live frames. In `events` three users that follow each other are a group of members."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelite.functions.scalars import call_label
from kestrelite.operators import control
from kestrelite.queries.telemetry import _E, _S, ARRIVAL, _events, _spans, _uniform, blob_retention, span_holders
from kestrelite.queries.telemetry import ORACLE as TELEMETRY
from kestrelite.sources.tables import table

QUERIES: dict = {}
ORACLE: dict = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


TEXTS = ("dark matter halos", "graph neural networks", "protein folding", "prime gaps", "quantum error correction", "solar flares", "reinforcement learning", "gene regulation")
#: Seconds after the start, shard, kind, amount (ms, or a probability).
FAULTS = ((5.0, 1, "drop", 1.0), (7.5, 1, "clear", 0.0), (3.0, 0, "slow", 40.0), (4.0, 0, "clear", 0.0), (8.0, 2, "pause", 300.0), (6.0, 3, "drop", 0.25), (8.0, 3, "clear", 0.0))
QPS, SECONDS, STORM_SHARDS, KILL_AT = 20, 12, 4, 5.0
_FAULTS = ", ".join(f"({at}, {s}, '{k}', {a})" for at, s, k, a in FAULTS)
_TEXTS = "[" + ", ".join(f"'{t}'" for t in TEXTS) + "]"
_STORM = f"""q AS (SELECT i, CAST(i AS DOUBLE) / {QPS} AS t, {_TEXTS}[i % 8 + 1] AS text FROM range({QPS * SECONDS}) r(i)), f AS (SELECT CAST(since_s AS DOUBLE) AS since_s, shard_id, kind, CAST(amount AS DOUBLE) AS amount FROM (VALUES {_FAULTS}) v(since_s, shard_id, kind, amount)),
    a AS (SELECT i, t, text, CAST(s AS INTEGER) AS shard_id, (SELECT coalesce(max(since_s), -1) FROM f WHERE f.shard_id = s AND kind = 'clear' AND since_s <= t) AS since FROM q, range({STORM_SHARDS}) z(s)),
    l AS (SELECT *, (SELECT arg_max(since_s * 1000 + amount, since_s) FROM f WHERE f.shard_id = a.shard_id AND kind = 'pause' AND since_s <= t AND since_s > since) AS pause, (SELECT arg_max(amount, since_s) FROM f WHERE f.shard_id = a.shard_id AND kind = 'slow' AND since_s <= t AND since_s > since) AS slow,
          (SELECT arg_max(amount, since_s) FROM f WHERE f.shard_id = a.shard_id AND kind = 'drop' AND since_s <= t AND since_s > since) AS p FROM a),
    m AS (SELECT *, coalesce({_uniform("'fault'", "CAST(i AS VARCHAR)", "CAST(shard_id AS VARCHAR)")} < p, FALSE) AS lost, 8.0 + i % 5 + greatest(0, coalesce(pause - t * 1000, 0)) + coalesce(slow, 0) AS ms FROM l),
    s AS (SELECT i, t, text, count(*) AS probed, count(*) FILTER (NOT lost) AS answered, coalesce(list(shard_id ORDER BY shard_id) FILTER (lost), []) AS missing, coalesce(max(ms) FILTER (NOT lost), 8.0 + any_value(i) % 5) AS latency_ms FROM m GROUP BY i, t, text)"""


def _samples(spark: SparkSession) -> DataFrame:
    shards = spark.range(STORM_SHARDS).select(F.col("id").cast("int").alias("shard_id"))
    faults = spark.createDataFrame(FAULTS, "at double, shard_id int, kind string, amount double")
    return control.storm_samples(control.query_storm(spark, QPS, SECONDS, list(TEXTS)), shards, faults, F.lit(8.0) + F.col("i") % 5)


@register(f"WITH {_STORM} SELECT i, text, answered > 0 AS ok, probed, answered, array_to_string(missing, ',') AS missing, round(latency_ms, 6) AS latency_ms FROM s")
def query_storm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve seconds of queries at a fixed rate against four shards, one of which is lost and comes back, others slow, paused or lossy for a while."""
    s = _samples(spark)
    return s.select("i", "text", "ok", "probed", "answered", F.array_join(F.transform("missing", lambda x: x.cast("string")), ",").alias("missing"), F.round("latency_ms", 6).alias("latency_ms"))


@register(f"""WITH {_STORM}, o AS (SELECT *, row_number() OVER (PARTITION BY t < {KILL_AT} ORDER BY latency_ms) - 1 AS r, count(*) OVER (PARTITION BY t < {KILL_AT}) AS n FROM s),
    w AS (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) - 1 AS r, count(*) OVER () AS n FROM s WHERE t >= (SELECT max(t) FROM s) - 3)
    SELECT *, failed = 0 AND recovery_s < 5 AND tail_p99 <= greatest(50, 4 * before_p99) AS passed FROM (SELECT count(*) AS samples, count(*) FILTER (answered = 0) AS failed, count(*) FILTER (answered < probed AND t >= {KILL_AT}) AS degraded, round(max(t) FILTER (answered < probed AND t >= {KILL_AT}) - {KILL_AT}, 6) AS recovery_s,
           (SELECT latency_ms FROM o WHERE t < {KILL_AT} AND r = least(n - 1, n * 990 // 1000)) AS before_p99, (SELECT latency_ms FROM w WHERE r = least(n - 1, n * 990 // 1000)) AS tail_p99 FROM s)""")
def failover_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The storm judged: no failed query, exact coverage, recovery within five seconds, the tail as fast as before."""
    r = control.failover_report(_samples(spark), KILL_AT, STORM_SHARDS)
    return r.select("samples", "failed", "degraded", F.round("recovery_s", 6).alias("recovery_s"), "before_p99", "tail_p99", "passed")


_RAFT = """x AS (SELECT user_id // 3 AS grp, user_id AS member, ts, event_type, event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS epoch, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS index FROM events),
    e AS (SELECT *, CAST(extract(day FROM ts) AS BIGINT) AS term FROM x)"""


def _raft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grp, member, index, term, epoch, event_type): an event of a member is an entry of its log, the day its term."""
    from kestrelite.operators.ordered import sliced, with_number

    e = table(spark, sf_dir, "events")
    numbered = with_number(sliced(e, ["user_id"], ["ts", "event_id"]), ["user_id"], ["ts", "event_id"], "index")
    return numbered.select(F.expr("user_id div 3").alias("grp"), F.col("user_id").alias("member"), "index", F.dayofmonth("ts").cast("long").alias("term"), F.get_json_object("props", "$.k").cast("long").alias("epoch"), "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


@register(f"""WITH {_RAFT}, m AS (SELECT grp, member, max(index) AS match_index FROM e GROUP BY ALL), r AS (SELECT grp, list(match_index ORDER BY match_index DESC) AS v, arg_max(member, (match_index, -member)) AS leader FROM m GROUP BY grp),
    q AS (SELECT grp, leader, v[len(v) // 2 + 1] AS majority_index FROM r), t AS (SELECT grp, max(term) AS term FROM e JOIN q USING (grp) WHERE member = leader GROUP BY grp)
    SELECT q.grp AS grp, majority_index, coalesce(max(index) FILTER (index <= majority_index), 0) AS commit_index FROM q JOIN t USING (grp) JOIN e ON e.grp = q.grp AND e.member = q.leader AND e.term = t.term GROUP BY q.grp, majority_index""")
def raft_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each group's leader, its member with the longest log, may commit: the highest entry of its current term that a majority has."""
    e = _raft(spark, sf_dir)
    match = e.groupBy("grp", "member").agg(F.max("index").alias("match_index"))
    leader = match.groupBy("grp").agg(F.max_by("member", F.struct("match_index", -F.col("member"))).alias("member"))
    return control.quorum_commit(match, e.join(leader, ["grp", "member"]).select("grp", "index", "term"), "grp")


@register(f"""WITH {_RAFT}, l AS (SELECT 'leaders' AS rule, grp, term AS place FROM e WHERE event_type = 'purchase' GROUP BY grp, term HAVING count(DISTINCT member) > 1),
    p AS (SELECT a.grp AS grp, a.member AS a, b.member AS b, min(a.index) FILTER (a.term <> b.term) AS d, max(a.index) FILTER (a.term = b.term) AS g FROM e a JOIN e b ON a.grp = b.grp AND a.index = b.index AND a.member < b.member GROUP BY ALL),
    c AS (SELECT 'committed' AS rule, grp, index AS place FROM e WHERE event_type = 'view' GROUP BY grp, index HAVING count(DISTINCT (term, epoch)) > 1)
    SELECT rule, grp, count(*) AS violations FROM (SELECT * FROM l UNION ALL SELECT 'matching', grp, d FROM p WHERE g > d UNION ALL SELECT * FROM c) GROUP BY rule, grp""")
def raft_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of the three rules of a replicated log: one leader a term (purchases are claims), matching logs, committed entries that stay (views)."""
    e = _raft(spark, sf_dir)
    rule = lambda df, name: df.select(F.lit(name).alias("rule"), "grp")
    broken = rule(control.leader_conflicts(e.where("event_type = 'purchase'"), "grp"), "leaders").union(rule(control.log_mismatches(e, "grp"), "matching"))
    return broken.union(rule(control.commit_conflicts(e.where("event_type = 'view'"), "grp"), "committed")).groupBy("rule", "grp").agg(F.count(F.lit(1)).alias("violations"))


@register("""WITH r AS (SELECT user_id // 3 AS grp, user_id AS member, CASE WHEN event_type IN ('purchase', 'signup') THEN 'leader' ELSE 'follower' END AS role, CAST(extract(day FROM ts) AS BIGINT) AS term, epoch_us(ts) AS seen FROM events),
    l AS (SELECT grp, member, arg_max({'role': role, 'term': term}, (seen, term, role)) AS x, max(seen) AS seen FROM r GROUP BY grp, member), n AS (SELECT *, max(seen) OVER (PARTITION BY grp) - seen > 21600000000 AS down FROM l),
    t AS (SELECT *, max(CASE WHEN NOT down THEN x.term END) OVER (PARTITION BY grp) AS top FROM n)
    SELECT grp, member, x.role AS role, x.term AS term, down, coalesce(NOT down AND x.role = 'leader' AND x.term = top, FALSE) AS leads FROM t""")
def member_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of each group by their last report: who is down after six hours of silence, and who leads."""
    e = table(spark, sf_dir, "events")
    role = F.when(F.col("event_type").isin("purchase", "signup"), "leader").otherwise("follower")
    r = e.select(F.expr("user_id div 3").alias("grp"), F.col("user_id").alias("member"), role.alias("role"), F.dayofmonth("ts").cast("long").alias("term"), F.unix_micros(F.col("ts").cast("timestamp")).alias("seen"))
    return control.member_panel(r, "grp", 21_600_000_000).select("grp", "member", "role", "term", "down", F.coalesce("leads", F.lit(False)).alias("leads"))


_LEVEL = "CASE qid % 3 WHEN 0 THEN 'TRACE_NONE' WHEN 1 THEN 'TRACE_SPANS' ELSE 'TRACE_FULL' END"


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "responses").where("qid IS NOT NULL").withColumn("level", F.expr(_LEVEL))


@register(f"""WITH l AS (SELECT trace_id, coalesce(timings.embed_us, 0) AS e, coalesce(timings.plan_us, 0) AS p, coalesce(timings.fanout_us, 0) AS f, coalesce(timings.merge_us, 0) AS m, coalesce(timings.total_us, 0) AS t FROM responses WHERE qid IS NOT NULL AND {_LEVEL} <> 'TRACE_NONE')
    SELECT trace_id, 'SPAN_QUERY_RECEIVED' AS kind, CAST(0 AS BIGINT) AS t_start_us, CAST(0 AS BIGINT) AS t_end_us FROM l UNION ALL SELECT trace_id, 'SPAN_EMBED', 0, e FROM l UNION ALL SELECT trace_id, 'SPAN_PLAN', e, e + p FROM l
    UNION ALL SELECT trace_id, 'SPAN_SHARD_RPC', e + p, e + p + f FROM l UNION ALL SELECT trace_id, 'SPAN_MERGE', e + p + f, e + p + f + m FROM l UNION ALL SELECT trace_id, 'SPAN_QUERY_DONE', 0, t FROM l""")
def stage_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans that answered queries emit by their trace level: none for a third of them."""
    return control.stage_spans(_levels(spark, sf_dir))


@register(f"""WITH g AS (SELECT {_LEVEL} AS level, count(timings.total_us) AS n, quantile_cont(timings.total_us, 0.5) AS p50 FROM responses WHERE qid IS NOT NULL GROUP BY 1)
    SELECT level, n, round(p50, 6) AS p50_us, round(100 * (p50 - (SELECT p50 FROM g WHERE level = 'TRACE_NONE')) / (SELECT p50 FROM g WHERE level = 'TRACE_NONE'), 6) AS over_percent FROM g""")
def overhead_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median time by trace level, and what a level costs over none."""
    o = control.overhead_by_level(_levels(spark, sf_dir).select("level", F.col("timings.total_us").alias("us")))
    return o.select("level", "n", F.round("p50_us", 6).alias("p50_us"), F.round("over_percent", 6).alias("over_percent"))


@register(f"""WITH {_E}, w AS (SELECT node_id, t_mono_ns // 50000000 AS win, (row_number() OVER (PARTITION BY node_id, t_mono_ns // 50000000 ORDER BY batch_id, t_mono_ns, seq) - 1) // 512 AS batch FROM e),
    b AS (SELECT node_id, win, batch, count(*) AS n FROM w GROUP BY ALL) SELECT node_id, count(*) AS batches, max(n) AS largest, CAST(sum(n) AS BIGINT) AS events FROM b GROUP BY node_id""")
def publish_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches in which each node publishes its events: every 50 ms of its clock, at most 512 at once."""
    b = control.publish_batches(_events(spark, sf_dir).select("node_id", *ARRIVAL), "node_id", "t_mono_ns", ARRIVAL)
    n = b.groupBy("node_id", "window", "batch").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("node_id").agg(F.count(F.lit(1)).alias("batches"), F.max("n").alias("largest"), F.sum("n").alias("events"))


@register(f"""WITH {_E}, w AS (SELECT node_id, row_number() OVER (PARTITION BY node_id, t_mono_ns // 60000000000 ORDER BY batch_id, t_mono_ns, seq) AS i FROM e)
    SELECT node_id, count(*) FILTER (i <= 8) AS kept, count(*) FILTER (i > 8) AS dropped FROM w GROUP BY node_id""")
def ring_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a buffer of eight events, emptied every minute of a node's clock here, would have let through."""
    return control.ring_drops(_events(spark, sf_dir).select("node_id", *ARRIVAL), "node_id", "t_mono_ns", ARRIVAL, 7, 60_000)


_CAP, _FLUSH = 40, 600_000


@register(f"""WITH {_E}, b AS (SELECT epoch_ms(received_at) AS at_ms, CASE WHEN span IS NOT NULL THEN 'spans' WHEN stats IS NOT NULL THEN 'metrics' ELSE 'cluster' END AS topic, batch_id, node_id, t_mono_ns, seq FROM e WHERE received_at IS NOT NULL),
    g AS (SELECT at_ms, topic, count(*) AS events FROM b WHERE topic IN ('spans', 'cluster') GROUP BY ALL),
    n AS (SELECT *, at_ms // {_FLUSH} AS flush, row_number() OVER (PARTITION BY at_ms // {_FLUSH} ORDER BY at_ms, topic) AS i, count(*) OVER (PARTITION BY at_ms // {_FLUSH}) AS n FROM g)
    SELECT flush, topic, CAST(sum(events) AS BIGINT) AS events, CAST(0 AS BIGINT) AS dropped FROM n WHERE i > n - {_CAP} GROUP BY flush, topic
    UNION ALL SELECT DISTINCT flush, 'meta', CAST(0 AS BIGINT), n - {_CAP} FROM n WHERE n > {_CAP}""")
def live_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a subscriber of spans and cluster changes: flushed every ten minutes here, with a queue of forty batches."""
    from kestrelite.functions.scalars import topic_of

    e = _events(spark, sf_dir).where("received_at IS NOT NULL").select(F.unix_millis(F.col("received_at").cast("timestamp")).alias("at_ms"), topic_of(F.col("span"), F.col("stats")).alias("topic"))
    b = e.where(F.col("topic").isin("spans", "cluster")).groupBy("at_ms", "topic").agg(F.count(F.lit(1)).alias("events"))
    return control.live_frames(b, "at_ms", ["at_ms", "topic"], _FLUSH, _CAP)


@register(f"""WITH {_E}, t AS (SELECT node_id, {{'batch_id': batch_id, 't_mono_ns': t_mono_ns, 'seq': seq}} AS pos, stats.state AS s, state_change.to_state AS c FROM e),
    g AS (SELECT node_id, arg_max(coalesce(s, c), pos) FILTER (coalesce(s, c) IS NOT NULL) AS state, max(pos) FILTER (s = 'NODE_STATE_LOADING') AS build, max(pos) FILTER (coalesce(c, s) = 'NODE_STATE_SERVING') AS serving FROM t GROUP BY node_id)
    SELECT node_id, state, build IS NOT NULL AND (serving IS NULL OR build > serving) AS building FROM g""")
def live_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each node, and whether it is still building: serving ends a build."""
    e = _events(spark, sf_dir).select("node_id", *ARRIVAL, F.col("stats.state").alias("stats_state"), F.col("state_change.to_state").alias("to_state"))
    return control.live_nodes(e, "node_id", ARRIVAL)


@register("""WITH n AS (SELECT label AS shard_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS inserted, count(*) OVER (PARTITION BY label) AS total FROM embeddings)
    SELECT shard_id, inserted, total FROM n WHERE inserted % 16 = 0 OR inserted = total""")
def build_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of shards that are loaded, one in every 16 rows here."""
    return control.build_progress(table(spark, sf_dir, "embeddings").withColumnRenamed("label", "shard_id"), "shard_id", ["vec_id"], 16)


@register(f"""WITH {_S}, w AS (SELECT DISTINCT trace_id FROM responses WHERE qid % 100 = 0) SELECT trace_id, node_id, kind, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY t_mono_ns, node_id, seq) AS INTEGER) AS place FROM s JOIN w USING (trace_id)""")
def trace_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of the traces of some queries (id divisible by 100), oldest first."""
    wanted = table(spark, sf_dir, "responses").where("qid % 100 = 0").select("trace_id")
    return control.trace_lookup(_spans(spark, sf_dir), wanted, ["t_mono_ns", "node_id", "seq"]).select("trace_id", "node_id", "kind", "place")


@register(f"SELECT h.trace_id AS trace_id, h.node_id AS node_id, shard_id, t FROM ({TELEMETRY['span_holders']}) h JOIN ({TELEMETRY['blob_retention']}) b ON b.trace_id = h.trace_id AND b.node_id = h.node_id")
def trace_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The traces that the nodes which searched still hold; what a node has dropped is left out."""
    return span_holders(spark, sf_dir).join(blob_retention(spark, sf_dir), ["trace_id", "node_id"]).select("trace_id", "node_id", "shard_id", "t")


@register("""SELECT status, CASE status WHEN 'OK' THEN 'OK' WHEN 'DEADLINE_EXCEEDED' THEN 'DEADLINE' WHEN 'UNAVAILABLE' THEN 'UNAVAILABLE' WHEN 'FAILED_PRECONDITION' THEN 'STALE_EPOCH' ELSE 'ERROR' END AS label,
    CAST(CASE status WHEN 'OK' THEN 200 WHEN 'INVALID_ARGUMENT' THEN 400 WHEN 'NOT_FOUND' THEN 404 WHEN 'FAILED_PRECONDITION' THEN 409 WHEN 'DEADLINE_EXCEEDED' THEN 504 WHEN 'UNAVAILABLE' THEN 503 ELSE 500 END AS INTEGER) AS http
    FROM (VALUES ('OK'), ('INVALID_ARGUMENT'), ('NOT_FOUND'), ('FAILED_PRECONDITION'), ('DEADLINE_EXCEEDED'), ('UNAVAILABLE'), ('INTERNAL'), ('CANCELLED')) v(status)""")
def status_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label and HTTP code of call statuses."""
    from kestrelite.functions.scalars import http_status

    s = spark.createDataFrame([(x,) for x in ("OK", "INVALID_ARGUMENT", "NOT_FOUND", "FAILED_PRECONDITION", "DEADLINE_EXCEEDED", "UNAVAILABLE", "INTERNAL", "CANCELLED")], "status string")
    return s.select("status", call_label(F.col("status")).alias("label"), http_status(F.col("status")).alias("http"))
