"""Partitioning: centres, assignment, balance, labels, replicas, node names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelite.functions.scalars import bucket_of, node_number, node_replica, node_role, shard_port
from kestrelite.operators.ordered import sliced, with_number
from kestrelite.operators.partitioning import balanced_assignment, kmeans, nearest_centre, ranked_shards, shard_labels
from kestrelite.operators.redelivery import normalised_node
from kestrelite.queries.search import _IVF, _centroids
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


def _fixed_centres(spark: SparkSession, sf_dir: str) -> list:
    return [c for _, c in _centroids(spark, sf_dir)]


_STEP = f"""{_IVF}, k AS (SELECT row_number() OVER (ORDER BY shard_id) - 1 AS centre, c FROM c),
    d AS (SELECT vec_id, centre, -2.0 * list_inner_product(CAST(embedding AS DOUBLE[]), c) + list_inner_product(c, c) AS distance FROM embeddings, k)"""


@register(f"""WITH {_STEP} SELECT vec_id, CAST(centre AS INTEGER) AS centre, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, centre) AS r FROM d) WHERE r = 1""")
def kmeans_assign_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of a set of fixed centres for each vector."""
    near = nearest_centre(F.col("embedding"), _fixed_centres(spark, sf_dir))
    return table(spark, sf_dir, "embeddings").select("vec_id", near.alias("n")).select("vec_id", "n.centre", F.round("n.distance", 6).alias("distance"))


@register(f"""WITH {_STEP}, near AS (SELECT vec_id, centre FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, centre) AS r FROM d) WHERE r = 1),
    x AS (SELECT centre, i AS dim, round(CAST(embedding[i + 1] AS DOUBLE) * 1e9) AS v FROM near JOIN embeddings USING (vec_id), range(64) r(i))
    SELECT CAST(centre AS INTEGER) AS centre, CAST(dim AS INTEGER) AS dim, count(*) AS n, round(CAST(sum(CAST(v AS BIGINT)) AS DOUBLE) / count(*) / 1e9, 6) AS mean FROM x GROUP BY centre, dim""")
def kmeans_update_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of each centre's vectors, in integer billionths, so that the order of addition doesn't matter."""
    near = nearest_centre(F.col("embedding"), _fixed_centres(spark, sf_dir))
    x = table(spark, sf_dir, "embeddings").select(near.alias("n"), "embedding").select("n.centre", F.posexplode("embedding").alias("dim", "x"))
    x = x.withColumn("v", F.round(F.col("x").cast("double") * 1e9).cast("long"))
    return x.groupBy("centre", "dim").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s")).select("centre", "dim", "n", F.round(F.col("s").cast("double") / F.col("n") / 1e9, 6).alias("mean"))


@register()
def kmeans_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four centres by Lloyd steps over all vectors."""
    centres = kmeans(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), 4, 64)
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "centre int, vector array<double>")


def _balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    centres = _fixed_centres(spark, sf_dir)[:4]
    ranked = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), ranked_shards(F.col("embedding"), centres).alias("shards"))
    return balanced_assignment(ranked, 4)


_BALANCED = """RECURSIVE c AS (SELECT row_number() OVER (ORDER BY label) - 1 AS shard, CAST(arg_min(embedding, vec_id) AS DOUBLE[]) AS c FROM embeddings GROUP BY label ORDER BY label LIMIT 4),
    p AS (SELECT vec_id, list(shard ORDER BY list_inner_product(CAST(embedding AS DOUBLE[]), c) DESC, shard) AS prefs FROM embeddings, c GROUP BY vec_id),
    o AS (SELECT *, row_number() OVER (ORDER BY vec_id) AS k, (1300 * count(*) OVER () + 3999) // 4000 AS room FROM p),
    r AS (SELECT CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS vec_id, CAST(-1 AS BIGINT) AS shard, CAST(-1 AS BIGINT) AS rank, [CAST(0 AS BIGINT), 0, 0, 0] AS held
          UNION ALL
          SELECT o.k, o.vec_id, list_filter(o.prefs, lambda s: r.held[s + 1] < o.room)[1] AS shard,
                 list_position(o.prefs, list_filter(o.prefs, lambda s: r.held[s + 1] < o.room)[1]) - 1 AS rank,
                 list_transform(range(4), lambda s: r.held[s + 1] + CASE WHEN s = list_filter(o.prefs, lambda t: r.held[t + 1] < o.room)[1] THEN 1 ELSE 0 END) AS held
          FROM r JOIN o ON o.k = r.k + 1)"""


@register(f"WITH {_BALANCED} SELECT vec_id AS doc_id, CAST(shard AS INTEGER) AS shard_id, CAST(rank AS INTEGER) AS rank FROM r WHERE k > 0")
def balanced_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four shards with room for 1.3 times the mean each."""
    return _balanced(spark, sf_dir)


@register(f"WITH {_BALANCED} SELECT CAST(shard AS INTEGER) AS shard_id, count(*) AS n, count(*) FILTER (rank > 0) AS spilled FROM r WHERE k > 0 GROUP BY shard")
def partition_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and spills of the balanced partitioning."""
    return _balanced(spark, sf_dir).groupBy("shard_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rank") > 0).alias("spilled"))


_BUCKET = """CASE WHEN c LIKE 'cs.%' THEN 'cs' WHEN c LIKE 'math.%' THEN 'math' WHEN c LIKE 'q-bio%' THEN 'q-bio'
    WHEN regexp_matches(c, '^(hep-|astro-ph|cond-mat|gr-qc|nucl-|quant-ph|physics|math-ph|nlin)') THEN 'physics' ELSE 'other' END"""


@register(f"""WITH d AS (SELECT shard_id, coalesce(regexp_extract(category, '^\\s*(\\S+)', 1), '') AS c FROM docs), b AS (SELECT shard_id, {_BUCKET} AS bucket, count(*) AS n FROM d GROUP BY ALL),
    t AS (SELECT *, sum(n) OVER (PARTITION BY shard_id) AS total, row_number() OVER (PARTITION BY shard_id ORDER BY n DESC, bucket) AS r FROM b)
    SELECT shard_id, CAST(total AS BIGINT) AS n, bucket || '.*(' || CAST(CAST(round_even(100.0 * n / total, 0) AS INTEGER) AS VARCHAR) || '%)' AS label FROM t WHERE r = 1""")
def shard_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each shard is mostly about."""
    code = F.coalesce(F.regexp_extract("category", r"^\s*(\S+)", 1), F.lit(""))
    return shard_labels(table(spark, sf_dir, "docs").select("shard_id", bucket_of(code).alias("bucket")), "shard_id", "bucket")


_MAP = "m AS (SELECT * FROM shard_map WHERE epoch = (SELECT max(epoch) FROM shard_map))"
_HEALTH = """h AS (SELECT lower(trim(node_id, chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))) AS node, arg_max(state_change.health, (batch_id, t_mono_ns, seq)) AS health
    FROM node_events WHERE state_change IS NOT NULL AND state_change.health IS NOT NULL GROUP BY 1)"""


def _map(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "shard_map")
    return m.join(F.broadcast(m.agg(F.max("epoch").alias("epoch"))), "epoch")  # one row


def _health(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "node_events").where("state_change.health IS NOT NULL")
    return e.groupBy(normalised_node(F.col("node_id")).alias("node")).agg(F.max_by("state_change.health", F.struct("batch_id", "t_mono_ns", "seq")).alias("health"))


@register(f"""WITH {_MAP}, {_HEALTH} SELECT shard_id, primary_node, backup_node, coalesce(p.health, 'HEALTH_HEALTHY') AS primary_health, CASE WHEN backup_node IS NULL THEN NULL ELSE coalesce(b.health, 'HEALTH_HEALTHY') END AS backup_health
    FROM m LEFT JOIN h p ON p.node = primary_node LEFT JOIN h b ON b.node = backup_node""")
def shard_map_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest shard map with the health of its nodes; a node never heard of counts as healthy."""
    h = _health(spark, sf_dir)
    p, b = (h.select(F.col("node").alias(f"{x}_node"), F.col("health").alias(f"{x}_h")) for x in ("primary", "backup"))
    out = _map(spark, sf_dir).join(p, "primary_node", "left").join(b, "backup_node", "left")
    ok = F.lit("HEALTH_HEALTHY")
    return out.select("shard_id", "primary_node", "backup_node", F.coalesce("primary_h", ok).alias("primary_health"), F.when(F.col("backup_node").isNotNull(), F.coalesce("backup_h", ok)).alias("backup_health"))


@register(f"""WITH {_MAP}, {_HEALTH}, n AS (SELECT shard_id, 0 AS place, primary_node AS node FROM m UNION ALL SELECT shard_id, 1, backup_node FROM m WHERE backup_node IS NOT NULL),
    l AS (SELECT shard_id, list(n.node ORDER BY place) AS live FROM n LEFT JOIN h ON h.node = n.node WHERE coalesce(health, 'HEALTH_HEALTHY') = 'HEALTH_HEALTHY' GROUP BY shard_id),
    q AS (SELECT trace_id, node_id, min(answered_at) AS t, max(coverage.probed) AS probed FROM responses WHERE coverage IS NOT NULL GROUP BY trace_id, node_id),
    s AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY t, trace_id) - 1 AS qseq FROM q)
    SELECT trace_id, s.node_id AS coordinator, m.shard_id AS shard_id, live[(qseq + m.shard_id) % len(live) + 1] AS replica FROM s JOIN m ON m.shard_id < probed LEFT JOIN l ON l.shard_id = m.shard_id""")
def replica_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replica that each probed shard of each answered query is read from: healthy ones in turn, by the coordinator's query count."""
    m = _map(spark, sf_dir)
    nodes = m.select("shard_id", F.lit(0).alias("place"), F.col("primary_node").alias("node")).union(m.where("backup_node IS NOT NULL").select("shard_id", F.lit(1), "backup_node"))
    live = nodes.join(_health(spark, sf_dir), "node", "left").where("coalesce(health, 'HEALTH_HEALTHY') = 'HEALTH_HEALTHY'")
    live = live.groupBy("shard_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "node"))), lambda x: x["node"]).alias("live"))  # two replicas at most
    plan = F.broadcast(m.select("shard_id").join(live, "shard_id", "left"))  # a row per shard of the map
    q = table(spark, sf_dir, "responses").where("coverage IS NOT NULL").groupBy("trace_id", "node_id").agg(F.min("answered_at").alias("t"), F.max("coverage.probed").alias("probed"))
    s = with_number(sliced(q, ["node_id"], ["t", "trace_id"]), ["node_id"], ["t", "trace_id"], "number")
    both = s.join(plan, F.col("shard_id") < F.col("probed"))
    at = F.pmod(F.col("number") - 1 + F.col("shard_id"), F.greatest(F.size("live"), F.lit(1))).cast("int") + 1
    return both.select("trace_id", F.col("node_id").alias("coordinator"), "shard_id", F.try_element_at("live", at).alias("replica"))


_NODES = """n AS (SELECT DISTINCT lower(trim(node_id, chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))) AS node FROM node_events
    UNION SELECT primary_node FROM shard_map WHERE primary_node IS NOT NULL UNION SELECT backup_node FROM shard_map WHERE backup_node IS NOT NULL)"""


@register(f"""WITH {_NODES} SELECT node, CASE WHEN regexp_matches(node, '^shard-[0-9]+[ab]$') THEN 'shard' ELSE nullif(regexp_extract(node, '^(coord|embed|collector|member)-[0-9]+$', 1), '') END AS role,
    TRY_CAST(nullif(regexp_extract(node, '^(?:shard|coord|embed|collector|member)-([0-9]+)[ab]?$', 1), '') AS INTEGER) AS number, nullif(regexp_extract(node, '^shard-[0-9]+([ab])$', 1), '') AS replica,
    CASE WHEN regexp_matches(node, '^shard-[0-9]+[ab]$') THEN CAST(7100 + 10 * CAST(regexp_extract(node, '^shard-([0-9]+)[ab]$', 1) AS INTEGER) + CASE WHEN node LIKE '%a' THEN 0 ELSE 1 END AS INTEGER) END AS port FROM n""")
def cluster_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes that were heard of or are in a shard map, with what their names say."""
    m = table(spark, sf_dir, "shard_map")
    n = table(spark, sf_dir, "node_events").select(normalised_node(F.col("node_id")).alias("node")).union(m.select("primary_node")).union(m.select("backup_node")).where("node IS NOT NULL").distinct()
    role, number, replica = node_role(F.col("node")), node_number(F.col("node")), node_replica(F.col("node"))
    return n.select("node", role.alias("role"), number.alias("number"), replica.alias("replica"), F.when(replica.isNotNull(), shard_port(7100, number, replica)).alias("port"))
