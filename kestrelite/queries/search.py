"""Search over `embeddings` and `docs`: exact, per shard and merged, probed, hydrated; coverage and recall.

Query vectors are the rows whose id is divisible by 100, searched in all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelite.functions.scalars import http_status, shard_of, unsigned
from kestrelite.functions.vectors import norm, normalised
from kestrelite.operators.embed import hash_embedding
from kestrelite.operators.search import CENTROIDS, Route, admitted, coverage, guarded, merge_top_k, per_shard_top_k, plan_probes, probe_recall, score_shards, shard_hits
from kestrelite.plans.gates import recall_gates
from kestrelite.scratch import materialize, scratch_path, stored
from kestrelite.sources.sealed import read_sealed, write_sealed
from kestrelite.sources.tables import table

K, SHARDS, DIM = 10, 4, 64
#: Shards that don't answer in the coverage queries.
DOWN = (2,)

QUERIES: dict = {}
ORACLE: dict = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), shard_of(F.col("vec_id"), SHARDS).alias("shard_id"), F.col("embedding").alias("vector"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))


_SHARD = f"CAST(CAST('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 8) AS BIGINT) % {SHARDS} AS INTEGER)"
_ALL = f"""
    q AS (SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 100 = 0),
    e AS (SELECT vec_id AS doc_id, {_SHARD} AS shard_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    s AS (SELECT qid, doc_id, shard_id, list_inner_product(q.v, e.v) AS score FROM q, e)"""


@register(f"""WITH {_ALL} SELECT qid, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= {K}""")
def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact top-k of each query."""
    hits = shard_hits(_vectors(spark, sf_dir).withColumn("shard_id", F.lit(0)), _asked(spark, sf_dir), K, DIM)
    return merge_top_k(hits, K).select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


@register(f"""WITH {_ALL} SELECT qid, shard_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY qid, shard_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= {K}""")
def knn_per_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each shard returns of a scatter: its own top-k."""
    hits = per_shard_top_k(shard_hits(_vectors(spark, sf_dir), _asked(spark, sf_dir), K, DIM), K)
    return hits.select("qid", "shard_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@register(f"""WITH {_ALL} SELECT qid, shard_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= {K}""")
def knn_shard_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-k per shard, merged: equal to the global top-k."""
    hits = per_shard_top_k(shard_hits(_vectors(spark, sf_dir), _asked(spark, sf_dir), K, DIM), K).drop("rank")
    return merge_top_k(hits, K).select("qid", "shard_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@register(f"SELECT vec_id, {_SHARD} AS shard_id FROM embeddings")
def shard_assign_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", shard_of(F.col("vec_id"), SHARDS).alias("shard_id"))


@register(f"SELECT {_SHARD} AS shard_id, count(*) AS n FROM embeddings GROUP BY 1")
def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).groupBy("shard_id").agg(F.count(F.lit(1)).alias("n"))


@register("""WITH q AS (SELECT vec_id AS qid FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT unnest(range(4)) AS shard_id),
    p AS (SELECT qid, shard_id, row_number() OVER (PARTITION BY qid ORDER BY shard_id) <= 3 AS probed, shard_id <> 2 AS answers FROM q, s)
    SELECT qid, count(*) FILTER (probed) AS probed, count(*) FILTER (probed AND answers) AS answered,
           coalesce(string_agg(CAST(shard_id AS VARCHAR), ',' ORDER BY shard_id) FILTER (probed AND NOT answers), '') AS missing_shards,
           coalesce(string_agg(CAST(shard_id AS VARCHAR), ',' ORDER BY shard_id) FILTER (NOT probed), '') AS unprobed_shards
    FROM p GROUP BY qid""")
def probe_hash_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash routing has no scores: the lowest shards are probed. One shard is down; it shows as missing."""
    scored = _asked(spark, sf_dir).select("qid", F.explode(F.sequence(F.lit(0), F.lit(SHARDS - 1))).alias("shard_id"), F.lit(0.0).alias("cscore"))
    health = spark.createDataFrame([(s, s not in DOWN) for s in range(SHARDS)], "shard_id int, answers boolean")
    return coverage(plan_probes(scored, 3), health)


# Routing by centroid: one fixed row of each label stands for a shard.
_IVF = f"""
    c AS (SELECT label AS shard_id, CAST(arg_min(embedding, vec_id) AS DOUBLE[]) AS c FROM embeddings GROUP BY label),
    q AS (SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 100 = 0),
    a AS (SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS v, shard_id,
                 row_number() OVER (PARTITION BY vec_id ORDER BY list_inner_product(CAST(embedding AS DOUBLE[]), c) DESC, shard_id) AS r FROM embeddings, c),
    p AS (SELECT qid, v, shard_id, row_number() OVER (PARTITION BY qid ORDER BY list_inner_product(v, c) DESC, shard_id) AS position FROM q, c),
    s AS (SELECT qid, a.shard_id, doc_id, position, list_inner_product(p.v, a.v) AS score FROM p JOIN a ON a.shard_id = p.shard_id AND a.r = 1)"""


def _centroids(spark: SparkSession, sf_dir: str) -> list[tuple[int, list[float]]]:
    """(shard, vector): the first row of each label. Labels are few; more than a task can hold are an error."""
    rows = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("c")).orderBy("label").limit(CENTROIDS + 1).collect()
    if len(rows) > CENTROIDS:
        raise ValueError(f"more than {CENTROIDS} labels")
    return [(r["label"], [float(x) for x in r["c"]]) for r in rows]


#: Centroids by session and folder: a bounded number, kept with the table that was partitioned by them.
_CENTROIDS: dict[tuple[str, str], list] = {}


def ivf_store(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list]:
    """(vectors, centroids): the vectors in a table partitioned by the shard of their nearest centroid, written once in a session."""
    centroids = _CENTROIDS.setdefault((spark.sparkContext.applicationId, sf_dir), []) or _centroids(spark, sf_dir)
    _CENTROIDS[spark.sparkContext.applicationId, sf_dir] = centroids

    def build(path: str) -> None:
        e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), F.col("embedding").alias("_v"))
        near = score_shards(e, centroids, DIM, "_v", best=1)
        near.select("doc_id", "vector", "shard_id").write.partitionBy("shard_id").parquet(path)

    path = stored(spark, ("ivf", sf_dir), build)
    return spark.read.schema("doc_id long, vector array<float>, shard_id int").parquet(path), centroids


def _routed(spark: SparkSession, sf_dir: str, probe: int) -> DataFrame:
    """Hits of the probed shards: a query meets only the shards of its plan, and no others are read."""
    vectors, centroids = ivf_store(spark, sf_dir)
    return shard_hits(vectors, _asked(spark, sf_dir), K, DIM, Route(centroids, probe) if probe else None)


@register(f"WITH {_IVF} SELECT qid, shard_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s WHERE position <= 3) WHERE rank <= {K}")
def knn_ivf_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three shards with the nearest centroids are probed."""
    return merge_top_k(_routed(spark, sf_dir, 3), K).select("qid", "shard_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@register(f"WITH {_ALL} SELECT qid, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= {K}")
def knn_ivf_full_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probing all shards gives the exact result."""
    return merge_top_k(_routed(spark, sf_dir, 0), K).select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


@register(f"WITH {_IVF} SELECT qid, shard_id, round(list_inner_product(q.v, c.c), 6) AS cscore FROM q, c")
def centroid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_shards(_asked(spark, sf_dir), _centroids(spark, sf_dir), DIM).select("qid", "shard_id", F.round("cscore", 6).alias("cscore"))


@register(f"""WITH {_IVF}, t AS (SELECT qid, doc_id FROM (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS r FROM s) WHERE r <= {K}),
    g AS (SELECT probe, qid, doc_id FROM (SELECT probe, qid, doc_id, row_number() OVER (PARTITION BY probe, qid ORDER BY score DESC, doc_id) AS r
          FROM s, (SELECT unnest([1, 2, 4, 8]) AS probe) WHERE position <= probe) WHERE r <= {K})
    SELECT CAST(probe AS INTEGER) AS probe, count(*) AS found, round(count(*) / ((SELECT count(DISTINCT qid) FROM t) * {K}.0), 9) AS recall
    FROM g JOIN t USING (qid, doc_id) GROUP BY probe""")
def recall_by_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall against the exact result for 1, 2, 4 and 8 probed shards, from one scan of the vectors."""
    hits, plan = _routed(spark, sf_dir, 0), score_shards(_asked(spark, sf_dir), ivf_store(spark, sf_dir)[1], DIM)
    hits = materialize(hits.join(plan.select("qid", "shard_id", "position"), ["qid", "shard_id"]), "probe-hits")
    return probe_recall(hits, merge_top_k(hits, K), K, [1, 2, 4, 8])


@register(ORACLE["recall_by_probe"].replace("WITH", "WITH", 1).replace("    SELECT CAST(probe AS INTEGER)", "    , b AS (SELECT CAST(probe AS INTEGER)", 1) + """)
    SELECT probe, recall, coalesce(recall >= lag(recall) OVER (ORDER BY probe) - 0.02, TRUE) AS monotone, probe < max(probe) OVER () OR recall >= 0.9 AS above_floor FROM b""")
def bench_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether recall grows with the number of probed shards and reaches 0.9."""
    return recall_gates(recall_by_probe(spark, sf_dir), "probe", "recall", 0.9).select("probe", "recall", "monotone", "above_floor")


@register(f"SELECT {_SHARD} AS shard_id, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS ids FROM embeddings GROUP BY 1")
def sealed_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors sealed by shard, verified against the manifest and read back."""
    path = scratch_path(spark, "sealed")
    write_sealed(_vectors(spark, sf_dir), path, "shard_id")
    back = read_sealed(spark, path, "shard_id")
    return back.groupBy("shard_id").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


@register("SELECT vec_id, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm, len(embedding) = 64 AND abs(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) - 1) <= 0.001 AS usable FROM embeddings")
def vector_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and norm of each vector, and whether an index would take it."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(norm(e), 6).alias("norm"), ((F.size(e) == DIM) & (F.abs(norm(e) - 1) <= 0.001)).alias("usable"))


@register("WITH n AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, coalesce(nullif(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 0), 1) AS n FROM embeddings) SELECT vec_id, CAST(i AS INTEGER) AS dim, round(v[i + 1] / n, 6) AS x FROM n, range(64) r(i)")
def vector_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(normalised(F.col("embedding"))).alias("dim", "x"))
    return v.select("vec_id", "dim", F.round("x", 6).alias("x"))


@register("""WITH h AS (SELECT trace_id, answered_at, recorded_at, unnest(hits) AS h, generate_subscripts(hits, 1) AS place FROM responses),
    d AS (SELECT doc_id, min(title) AS title, min(substr(snippet, 1, 400)) AS snippet FROM docs GROUP BY doc_id)
    SELECT h.trace_id, h.recorded_at, CAST(place AS INTEGER) AS place, h.h.doc_id AS doc_id, coalesce(h.h.shard_id, 0) AS shard_id, title, snippet
    FROM h LEFT JOIN d ON d.doc_id = h.h.doc_id""")
def hits_hydrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and snippets fetched for hits only, after the cut to k."""
    hits = table(spark, sf_dir, "responses").select("trace_id", "recorded_at", F.posexplode("hits").alias("p", "h"))
    hits = hits.select("trace_id", "recorded_at", (F.col("p") + 1).alias("place"), "h.doc_id", F.coalesce("h.shard_id", F.lit(0)).alias("shard_id"))
    wanted = hits.select("doc_id").distinct()
    docs = table(spark, sf_dir, "docs").join(wanted, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("title").alias("title"), F.min(F.substring("snippet", 1, 400)).alias("snippet"))
    return hits.join(docs, "doc_id", "left").select("trace_id", "recorded_at", "place", "doc_id", "shard_id", "title", "snippet")


@register("""WITH h AS (SELECT DISTINCT trace_id, unnest(hits) AS h FROM responses)
    SELECT trace_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT trace_id, h.doc_id AS doc_id, h.score AS score,
      row_number() OVER (PARTITION BY trace_id ORDER BY h.score DESC, CASE WHEN h.doc_id < 0 THEN 1 ELSE 0 END, h.doc_id) AS rank
      FROM (SELECT DISTINCT trace_id, {'doc_id': h.doc_id, 'score': h.score} AS h FROM h)) WHERE rank <= 3""")
def merge_recorded_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best recorded hits of each answered query; ties by the id as an unsigned number."""
    hits = table(spark, sf_dir, "responses").select("trace_id", F.explode("hits").alias("h")).select(F.col("trace_id").alias("qid"), "h.doc_id", "h.score").distinct()
    return merge_top_k(hits, 3, unsigned(F.col("doc_id"))).select(F.col("qid").alias("trace_id"), "doc_id", "score", "rank")


@register("""WITH q AS (SELECT qid, text, CASE WHEN qid % 7 = 3 THEN CAST(qid % 64 AS INTEGER) ELSE 0 END AS k, CASE WHEN qid % 5 = 2 THEN CAST(40 + qid % 100 AS INTEGER) ELSE 0 END AS ef FROM queries)
    SELECT qid, CASE WHEN trim(coalesce(text, '')) = '' THEN 'INVALID_ARGUMENT' ELSE 'OK' END AS status, CASE WHEN k = 0 THEN 10 ELSE k END AS k, CASE WHEN ef = 0 THEN 100 ELSE ef END AS ef,
    CAST(CASE WHEN trim(coalesce(text, '')) = '' THEN 400 ELSE 200 END AS INTEGER) AS http_status FROM q""")
def query_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests as they enter, some with k and ef of their own: empty text is refused, 0 stands for the default."""
    q = table(spark, sf_dir, "queries")
    asked = q.select("qid", "text", F.when(F.col("qid") % 7 == 3, F.col("qid") % 64).otherwise(0).cast("int").alias("k"), F.when(F.col("qid") % 5 == 2, 40 + F.col("qid") % 100).otherwise(0).cast("int").alias("ef"))
    return admitted(asked).select("qid", "status", "k", "ef", http_status(F.col("status")).alias("http_status"))


@register(f"""WITH q AS (SELECT vec_id AS qid, CAST(vec_id % 4 AS INTEGER) AS shard_id, CASE WHEN vec_id % 11 = 0 THEN 0 ELSE 10 END AS k, CASE WHEN vec_id % 13 = 0 THEN 63 ELSE len(embedding) END AS dim, vec_id % 9 AS epoch FROM embeddings),
    r AS (SELECT *, CASE WHEN shard_id = 2 THEN 'shard not SERVING' WHEN k = 0 THEN 'k must be > 0' WHEN dim <> {DIM} THEN 'vector dim mismatch' END AS broken FROM q),
    s AS (SELECT *, max(CASE WHEN broken IS NULL THEN epoch END) OVER (PARTITION BY shard_id ORDER BY qid ROWS UNBOUNDED PRECEDING) AS seen FROM r)
    SELECT qid, shard_id, CASE WHEN broken = 'shard not SERVING' THEN 'FAILED_PRECONDITION' WHEN broken IS NOT NULL THEN 'INVALID_ARGUMENT' WHEN epoch < seen THEN 'FAILED_PRECONDITION' ELSE 'OK' END AS status,
           coalesce(broken, CASE WHEN epoch < seen THEN 'stale shard map epoch' END) AS reason FROM s""")
def shard_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests at four shards, one of which isn't serving; some ask for no hits, have a vector of another length, or were planned with an old map."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.select(F.col("vec_id").alias("qid"), (F.col("vec_id") % 4).cast("int").alias("shard_id"), F.when(F.col("vec_id") % 11 == 0, 0).otherwise(10).alias("k"), F.when(F.col("vec_id") % 13 == 0, 63).otherwise(F.size("embedding")).alias("dim"), (F.col("vec_id") % 9).alias("epoch"))
    state = F.when(F.col("shard_id") == DOWN[0], "LOADING").otherwise("SERVING")
    return guarded(asked.withColumn("state", state), DIM, ["qid"]).select("qid", "shard_id", "status", "reason")


@register("""WITH h AS (SELECT trace_id, coverage.probed AS probed, coverage.answered AS answered, coverage.missing_shards AS missing FROM responses WHERE coverage IS NOT NULL)
    SELECT probed, answered, count(*) AS n, count(*) FILTER (answered > probed) AS impossible, count(*) FILTER (answered < probed AND coalesce(len(missing), 0) = 0) AS unnamed, count(*) FILTER (answered = probed AND len(missing) > 0) AS contradicted FROM h GROUP BY probed, answered""")
def coverage_exactness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether recorded coverage is exact: never more answers than probes, a shortfall names its shards, full coverage names none."""
    c = table(spark, sf_dir, "responses").where("coverage IS NOT NULL").select(F.col("coverage.probed").alias("probed"), F.col("coverage.answered").alias("answered"), F.coalesce(F.size("coverage.missing_shards"), F.lit(0)).alias("missing"))
    n = F.when(F.col("missing") < 0, 0).otherwise(F.col("missing"))
    less, full = F.col("answered") < F.col("probed"), F.col("answered") == F.col("probed")
    return c.groupBy("probed", "answered").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("answered") > F.col("probed")).alias("impossible"), F.count_if(less & (n == 0)).alias("unnamed"), F.count_if(full & (n > 0)).alias("contradicted"))


@register()
def embed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic embedding of query texts."""
    return table(spark, sf_dir, "queries").select("qid", hash_embedding(DIM)(F.col("text")).alias("vector"))


@register(f"SELECT qid, CAST({DIM} AS INTEGER) AS dim, TRUE AS unit, TRUE AS same_for_same_text FROM queries")
def embed_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query: the length of its vector, whether its norm is 1, and whether all queries of the same text have the same."""
    q = table(spark, sf_dir, "queries").select("qid", F.coalesce("text", F.lit("")).alias("text"))
    v = q.select("qid", "text", hash_embedding(DIM)(F.col("text")).alias("vector"))
    kinds = v.groupBy("text").agg(F.countDistinct("vector").alias("kinds"))
    return v.join(kinds, "text").select("qid", F.size("vector").alias("dim"), (F.abs(norm(F.col("vector")) - 1) <= 1e-5).alias("unit"), (F.col("kinds") == 1).alias("same_for_same_text"))
