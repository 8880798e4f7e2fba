"""Health, failover, membership and log replay. In `events` a user stands for a node and an error for a missed heartbeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelite.operators.membership import apply_commands, fold_failovers, health_states, map_changes, replay_cas
from kestrelite.operators.redelivery import normalised_node
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


_HEALTH = """p AS (SELECT user_id AS node, ts, event_id, event_type <> 'error' AS alive, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    m AS (SELECT *, k - max(CASE WHEN alive THEN k ELSE 0 END) OVER (PARTITION BY node ORDER BY k) AS misses, max(CASE WHEN alive THEN k ELSE 0 END) OVER (PARTITION BY node ORDER BY k) > 0 AS ever_healthy FROM p),
    s AS (SELECT *, CASE WHEN misses >= 5 THEN 'DOWN' WHEN misses >= 2 THEN 'SUSPECT' ELSE 'HEALTHY' END AS state FROM m),
    h AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY node ORDER BY k), 'HEALTHY') AS before FROM s)"""


def _health(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "events").select(F.col("user_id").alias("node"), "ts", "event_id", (F.col("event_type") != "error").alias("alive"))
    return health_states(p, "node", ["ts", "event_id"], "alive")


@register(f"WITH {_HEALTH} SELECT node, event_id, misses, state, before <> state AS changed FROM h")
def node_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of each node after each probe."""
    return _health(spark, sf_dir).select("node", "event_id", "misses", "state", (F.col("before") != F.col("state")).alias("changed"))


@register(f"""WITH RECURSIVE {_HEALTH}, c AS (SELECT node // 2 AS shard_id, row_number() OVER (PARTITION BY node // 2 ORDER BY ts, event_id) AS k, node % 2 = 0 AS is_a, state, ever_healthy FROM h WHERE before <> state),
    r AS (SELECT shard_id, CAST(0 AS BIGINT) AS k, TRUE AS a_first, 'HEALTHY' AS a, 'HEALTHY' AS b, 0 AS n FROM (SELECT DISTINCT shard_id FROM c)
          UNION ALL
          SELECT c.shard_id, c.k, CASE WHEN c.state = 'DOWN' AND c.ever_healthy AND c.is_a = r.a_first AND (CASE WHEN c.is_a THEN r.b ELSE r.a END) = 'HEALTHY' THEN NOT r.a_first ELSE r.a_first END,
                 CASE WHEN c.is_a THEN c.state ELSE r.a END, CASE WHEN c.is_a THEN r.b ELSE c.state END,
                 r.n + CASE WHEN c.state = 'DOWN' AND c.ever_healthy AND c.is_a = r.a_first AND (CASE WHEN c.is_a THEN r.b ELSE r.a END) = 'HEALTHY' THEN 1 ELSE 0 END
          FROM r JOIN c ON c.shard_id = r.shard_id AND c.k = r.k + 1)
    SELECT shard_id, CASE WHEN a_first THEN 'a' ELSE 'b' END AS "primary", CASE WHEN a_first THEN 'b' ELSE 'a' END AS backup, n + 1 AS epoch, n AS failovers
    FROM r WHERE k = (SELECT max(k) FROM r r2 WHERE r2.shard_id = r.shard_id)""")
def failover_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of each shard after all failovers; nodes 2 s and 2 s + 1 serve shard s."""
    c = _health(spark, sf_dir).where("before <> state")
    c = c.select(F.expr("node div 2").alias("shard_id"), F.struct("ts", "event_id").alias("at"), (F.col("node") % 2 == 0).alias("is_a"), "state", "ever_healthy")
    return fold_failovers(c)


@register("""WITH RECURSIVE o AS (SELECT user_id AS log, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 AS e FROM events),
    r AS (SELECT log, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS v, CAST(0 AS BIGINT) AS n FROM (SELECT DISTINCT log FROM o)
          UNION ALL SELECT o.log, o.k, CASE WHEN r.v = o.e THEN (o.e + 1) % 4 ELSE r.v END, r.n + CASE WHEN r.v = o.e THEN 1 ELSE 0 END FROM r JOIN o ON o.log = r.log AND o.k = r.k + 1)
    SELECT log, k AS entries, n AS applied, v AS value FROM r WHERE k = (SELECT max(k) FROM r r2 WHERE r2.log = r.log)""")
def cas_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compare-and-set entries of each log replayed in order."""
    e = (F.get_json_object("props", "$.k").cast("long") % 4).alias("e")
    o = table(spark, sf_dir, "events").select(F.col("user_id").alias("log"), F.struct("ts", "event_id").alias("at"), e).withColumn("p", (F.col("e") + 1) % 4)
    return replay_cas(o, "log", "at", "e", "p", 0)


@register("""SELECT epoch, count(DISTINCT shard_id) AS shards, count(*) FILTER (primary_node = backup_node) AS self_backed,
    count(*) - count(DISTINCT (shard_id)) AS doubled, count(*) FILTER (backup_node IS NULL) AS unbacked FROM shard_map GROUP BY epoch""")
def map_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that a committed map keeps: one row a shard, no node backing up itself."""
    m = table(spark, sf_dir, "shard_map")
    return m.groupBy("epoch").agg(
        F.countDistinct("shard_id").alias("shards"), F.count_if(F.col("primary_node") == F.col("backup_node")).alias("self_backed"),
        (F.count(F.lit(1)) - F.countDistinct("shard_id")).alias("doubled"), F.count_if(F.col("backup_node").isNull()).alias("unbacked"),
    )


@register("""WITH e AS (SELECT epoch, lag(epoch) OVER (ORDER BY epoch) AS before FROM (SELECT DISTINCT epoch FROM shard_map WHERE epoch IS NOT NULL))
    SELECT b.epoch AS epoch, b.shard_id AS shard_id, a.primary_node AS was, b.primary_node AS "now", b.primary_node = a.backup_node AS swapped FROM e JOIN shard_map b ON b.epoch = e.epoch JOIN shard_map a ON a.epoch = e.before AND a.shard_id = b.shard_id
    WHERE a.primary_node IS DISTINCT FROM b.primary_node OR a.backup_node IS DISTINCT FROM b.backup_node""")
def map_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a watcher of the map, who has seen the first one, learns from each later epoch, in turn."""
    return map_changes(table(spark, sf_dir, "shard_map")).select("epoch", "shard_id", "was", "now", "swapped")


@register("""WITH s AS (SELECT max(CAST(json_extract_string(span.detail_json, '$.epoch') AS BIGINT)) AS seen FROM node_events WHERE span.kind = 'SPAN_PLAN'), m AS (SELECT max(epoch) AS mapped FROM shard_map)
    SELECT mapped, seen, greatest(mapped, coalesce(seen, 0)) AS epoch FROM s, m""")
def epoch_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The epoch to start from: the largest of the map's and of any that was seen."""
    e = table(spark, sf_dir, "node_events").where("span.kind = 'SPAN_PLAN'").agg(F.max(F.get_json_object("span.detail_json", "$.epoch").cast("long")).alias("seen"))
    m = table(spark, sf_dir, "shard_map").agg(F.max("epoch").alias("mapped"))  # one row each
    return m.join(F.broadcast(e)).select("mapped", "seen", F.greatest("mapped", F.coalesce("seen", F.lit(0))).alias("epoch"))


@register("""WITH e AS (SELECT lower(trim(node_id, chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))) AS node, max(coalesce(stats.applied_seq, 0)) AS applied FROM node_events WHERE stats IS NOT NULL GROUP BY 1),
    m AS (SELECT * FROM shard_map WHERE epoch = (SELECT max(epoch) FROM shard_map)), n AS (SELECT shard_id, primary_node AS node FROM m UNION ALL SELECT shard_id, backup_node FROM m WHERE backup_node IS NOT NULL)
    SELECT shard_id, count(*) AS replicas, list(coalesce(applied, 0) ORDER BY coalesce(applied, 0) DESC)[count(*) // 2 + 1] AS committed FROM n LEFT JOIN e USING (node) GROUP BY shard_id""")
def quorum_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest number that a majority of each shard's replicas has applied, in the newest map."""
    e = table(spark, sf_dir, "node_events").where("stats IS NOT NULL").groupBy(normalised_node(F.col("node_id")).alias("node")).agg(F.max(F.coalesce("stats.applied_seq", F.lit(0))).alias("applied"))
    m = table(spark, sf_dir, "shard_map")
    m = m.join(F.broadcast(m.agg(F.max("epoch").alias("epoch"))), "epoch")  # one row
    n = m.select("shard_id", F.col("primary_node").alias("node")).union(m.where("backup_node IS NOT NULL").select("shard_id", "backup_node"))
    held = n.join(e, "node", "left").groupBy("shard_id").agg(F.count(F.lit(1)).alias("replicas"), F.sort_array(F.collect_list(F.coalesce("applied", F.lit(0))), asc=False).alias("v"))  # a shard's replicas
    return held.select("shard_id", "replicas", F.element_at("v", (F.size("v") / 2).cast("int") + 1).alias("committed"))


COMMANDS = ((1, 3, "add", "shard-3c"), (2, 21, "add", "shard-21c"), (3, 21, "add", "shard-21d"), (4, 21, "remove", "shard-21c"), (5, 5, "remove", "shard-5a"), (6, 99, "add", "shard-99b"), (7, 21, "add", "shard-21a"))


_COMMANDS = ", ".join(f"({at}, {s}, '{v}', '{n}')" for at, s, v, n in COMMANDS)


@register(f"""WITH RECURSIVE c AS (SELECT CAST(k AS BIGINT) AS k, CAST(shard AS INTEGER) AS shard, verb, node FROM (VALUES {_COMMANDS}) v(k, shard, verb, node)), m AS (SELECT * FROM shard_map WHERE epoch = (SELECT max(epoch) FROM shard_map)),
    r AS (SELECT CAST(0 AS BIGINT) AS k, CAST(-1 AS INTEGER) AS shard, '' AS verb, '' AS node, FALSE AS ok, (SELECT max(epoch) FROM m) AS epoch, (SELECT list({{'s': shard_id, 'p': primary_node, 'b': coalesce(backup_node, '')}}) FROM m) AS held
          UNION ALL
          SELECT x.k, x.shard, x.verb, x.node, x.ok, x.epoch + CASE WHEN x.ok THEN 1 ELSE 0 END, CASE WHEN x.ok THEN list_transform(x.held, lambda e: CASE WHEN e.s = x.shard THEN {{'s': e.s, 'p': e.p, 'b': CASE WHEN x.verb = 'add' THEN x.node ELSE '' END}} ELSE e END) ELSE x.held END
          FROM (SELECT c.*, r.epoch, r.held, len(list_filter(r.held, lambda e: e.s = c.shard AND CASE WHEN c.verb = 'add' THEN e.b = '' AND e.p <> c.node ELSE e.b = c.node END)) > 0 AS ok FROM r JOIN c ON c.k = r.k + 1) x)
    SELECT k AS "at", shard AS shard_id, verb, node, ok, epoch FROM r WHERE k > 0""")
def membership_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few commands to add and remove replicas, with their outcome."""
    m = table(spark, sf_dir, "shard_map")
    newest = m.join(F.broadcast(m.agg(F.max("epoch").alias("epoch"))), "epoch")
    return apply_commands(newest, spark.createDataFrame(COMMANDS, "at long, shard_id int, verb string, node string"))
