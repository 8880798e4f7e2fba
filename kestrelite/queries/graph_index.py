"""Graph search per shard of `embeddings`, its recall, traces, statistics and projections.

Graphs are built once a session and scheme of partitioning and kept as tables partitioned by shard; a search reads the shards it probes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelite.functions.scalars import shard_of
from kestrelite.operators.graph_index import RESULT, VISIT, build_graphs, hops, inspector_buffers, projections, search_graphs, walk_digest
from kestrelite.operators.partitioning import balanced_assignment, kmeans, ranked_shards
from kestrelite.operators.search import Route, merge_top_k
from kestrelite.plans.gates import sweep_gates
from kestrelite.plans.sweep import run_sweep
from kestrelite.queries.search import _ALL, DIM, K
from kestrelite.scratch import materialize, stored
from kestrelite.sources.tables import table

#: Vectors of one shard, at most about; below FEWEST shards there are FEWEST.
SHARD_ROWS, FEWEST = 50_000, 4

QUERIES: dict = {}
ORACLE: dict = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _shards(rows: int) -> int:
    return max(FEWEST, -(-rows // SHARD_ROWS))


def graph_store(spark: SparkSession, sf_dir: str, scheme: str = "hash") -> tuple[DataFrame, DataFrame, list]:
    """(vectors, edges, centroids) of the graphs of a scheme, hash or semantic, both tables partitioned by shard; hash has no centroids."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    centroids: list = []

    def partition(path: str) -> None:
        shards = _shards(v.count())
        if scheme == "hash":
            placed = v.withColumn("shard_id", shard_of(F.col("doc_id"), shards))
        else:
            centres = [c / max(float((c * c).sum()) ** 0.5, 1e-12) for c in kmeans(v, shards, DIM)]
            spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "shard_id int, centroid array<double>").write.parquet(f"{path}-centroids")
            ranked = v.select("doc_id", ranked_shards(F.col("vector"), centres).alias("shards"))
            placed = v.join(balanced_assignment(ranked, len(centres)).select("doc_id", "shard_id"), "doc_id")
        placed.select("doc_id", "vector", "shard_id").write.partitionBy("shard_id").parquet(path)

    def index(path: str) -> None:
        held = spark.read.schema("doc_id long, vector array<float>, shard_id int").parquet(vectors)
        # A task a shard: a graph is worth one, however few bytes it has.
        tasks = held.repartition(_shards(v.count()), "shard_id")
        build_graphs(tasks, DIM).write.partitionBy("shard_id").parquet(path)

    vectors = stored(spark, (f"graph-{scheme}", sf_dir), partition)
    edges = stored(spark, (f"edges-{scheme}", sf_dir), index)
    if scheme != "hash":
        centroids = [(r["shard_id"], list(r["centroid"])) for r in spark.read.parquet(f"{vectors}-centroids").collect()]  # a row a shard
    back = spark.read.schema("doc_id long, vector array<float>, shard_id int").parquet(vectors)
    return back, spark.read.schema("layer int, row int, doc_id long, neighbours array<int>, shard_id int").parquet(edges), centroids


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries: those whose id is divisible by 100."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))


def _walked(spark: SparkSession, sf_dir: str, ef: int, traced: bool) -> DataFrame:
    v, edges, _ = graph_store(spark, sf_dir)
    return search_graphs(v, edges, _asked(spark, sf_dir), DIM, K, ef, traced=traced)


@register(f"""WITH {_ALL} SELECT qid, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= {K}""")
def hnsw_search_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph search with a beam as wide as a shard: it reaches every vector, so the merged result is the exact one."""
    v, _, _ = graph_store(spark, sf_dir)
    widest = v.groupBy("shard_id").count().agg(F.max("count")).first()[0] or 1
    hits = _walked(spark, sf_dir, widest, False).select("qid", "shard_id", "doc_id", "score")
    return merge_top_k(hits, K).select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


@register()
def hnsw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph search with beam 100, merged over shards, with the distances evaluated."""
    hits = _walked(spark, sf_dir, 100, False)
    visited = hits.groupBy("qid", "shard_id").agg(F.max("visited").alias("v")).groupBy("qid").agg(F.sum("v").alias("visited_total"))
    return merge_top_k(hits.select("qid", "shard_id", "doc_id", "score"), K).join(visited, "qid").select("qid", "doc_id", F.round("score", 6).alias("score"), "rank", "visited_total")


@register()
def hnsw_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph search with beam 100 in the half of the shards whose centroid is nearest: no others are read."""
    v, edges, centroids = graph_store(spark, sf_dir, "semantic")
    hits = search_graphs(v, edges, _asked(spark, sf_dir), DIM, K, 100, plan=Route(centroids, max(1, len(centroids) // 2)))
    return merge_top_k(hits.select("qid", "shard_id", "doc_id", "score"), K).select("qid", "shard_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@register()
def hnsw_graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, edges and degrees by shard and layer."""
    _, e, _ = graph_store(spark, sf_dir)
    return e.groupBy("shard_id", "layer").agg(F.count(F.lit(1)).alias("nodes"), F.sum(F.size("neighbours")).alias("edges"), F.max(F.size("neighbours")).alias("most"))


@register()
def hnsw_trace_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per walk: layers, distances evaluated and their part of the shard, results, how long it took, and its digest."""
    h = materialize(hops(_walked(spark, sf_dir, 100, True)), "graph-hops")
    stats = h.groupBy("qid", "shard_id").agg(
        F.max("layer").alias("top_layer"), F.count_if(F.col("kind") == VISIT).alias("visits"), F.count_if(F.col("kind") == RESULT).alias("results"), F.max("offset").alias("duration_us")
    )
    size = graph_store(spark, sf_dir)[0].groupBy("shard_id").agg(F.count(F.lit(1)).alias("n"))
    stats = stats.join(size, "shard_id").withColumn("shard_permille", F.expr("visits * 1000 div n")).drop("n")
    return stats.join(walk_digest(h), ["qid", "shard_id"])


def sweep(spark: SparkSession, sf_dir: str, scheme: str) -> DataFrame:
    v, edges, centroids = graph_store(spark, sf_dir, scheme)
    return run_sweep(v, edges, centroids, _asked(spark, sf_dir), scheme, DIM, K)


@register()
def recall_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, distances evaluated and times by (partitioning, probe, ef), of both schemes."""
    return sweep(spark, sf_dir, "hash").union(sweep(spark, sf_dir, "semantic"))


@register("""SELECT gate, partitioning, CAST(ef AS INTEGER) AS ef, TRUE AS passed FROM (SELECT unnest(['hash', 'semantic']) AS partitioning),
    (VALUES ('floor', 100), ('monotone', 10), ('monotone', 50), ('monotone', 100), ('monotone', 200)) g(gate, ef)""")
def recall_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall 0.95 at ef 100 over all shards, and none lost as ef grows: the SQL says that every gate is passed."""
    return sweep_gates(recall_sweep(spark, sf_dir))


@register()
def pca_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projections(graph_store(spark, sf_dir)[0], DIM)


@register()
def inspector_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hop of every walk, placed in the projection of its shard."""
    return inspector_buffers(hops(_walked(spark, sf_dir, 100, True)), projections(graph_store(spark, sf_dir)[0], DIM))


_SHARDS = f"CAST(CAST('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 8) AS BIGINT) % {FEWEST} AS INTEGER)"


@register(f"SELECT {_SHARDS} AS shard_id, count(*) AS nodes, TRUE AS within_bounds FROM embeddings GROUP BY 1")
def hnsw_graph_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per shard: how many rows the bottom layer has, and whether no row has more links than its layer allows. The SQL is that of up to FEWEST shards."""
    _, e, _ = graph_store(spark, sf_dir)
    fits = F.size("neighbours") <= F.when(F.col("layer") == 0, 32).otherwise(16)
    return e.groupBy("shard_id").agg(F.count_if(F.col("layer") == 0).alias("nodes"), F.bool_and(fits).alias("within_bounds"))


@register(f"SELECT vec_id AS qid, CAST(s AS INTEGER) AS shard_id, CAST({K} AS BIGINT) AS results, TRUE AS descends FROM embeddings, range({FEWEST}) r(s) WHERE vec_id % 100 = 0")
def hnsw_trace_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per walk: how many results it has, and whether it starts at the top layer and never climbs."""
    h = hops(_walked(spark, sf_dir, 100, True)).groupBy("qid", "shard_id").agg(F.array_sort(F.collect_list(F.struct("hop", "layer"))).alias("w"), F.count_if(F.col("kind") == RESULT).alias("results"))
    layers = F.transform("w", lambda x: x["layer"])
    return h.select("qid", "shard_id", "results", (F.array_sort(layers) == F.reverse(layers)).alias("descends"))


@register(f"SELECT {_SHARDS} AS shard_id, count(*) AS n, TRUE AS centred, TRUE AS scaled, TRUE AS first_axis_widest FROM embeddings GROUP BY 1")
def pca_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per shard: how many points there are, whether both axes are centred and reach 1, and whether the first explains at least as much as the second."""
    p = pca_projection(spark, sf_dir)
    v = graph_store(spark, sf_dir)[0].select("shard_id", "doc_id", "vector")
    # What an axis explains is the sum over the coordinates of covariance squared, by the axis's own variance: scaling leaves it as it is.
    one = p.groupBy("shard_id").agg(F.count(F.lit(1)).alias("n"), ((F.abs(F.avg("x")) < 0.2) & (F.abs(F.avg("y")) < 0.2)).alias("centred"), ((F.abs(F.max(F.abs("x")) - 1) < 1e-6) & (F.abs(F.max(F.abs("y")) - 1) < 1e-6)).alias("scaled"))
    each = v.join(p, ["shard_id", "doc_id"]).select("shard_id", "x", "y", F.posexplode("vector").alias("i", "c"))
    held = each.groupBy("shard_id", "i").agg(F.covar_pop("x", "c").alias("cx"), F.covar_pop("y", "c").alias("cy"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"))
    told = held.groupBy("shard_id").agg((F.sum(F.col("cx") * F.col("cx") / F.col("vx")) >= F.sum(F.col("cy") * F.col("cy") / F.col("vy"))).alias("first_axis_widest"))
    return one.join(told, "shard_id").select("shard_id", "n", "centred", "scaled", "first_axis_widest")
