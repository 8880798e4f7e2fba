"""Recall and cost of graph search by number of probed shards and beam."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelite.operators.graph_index import search_graphs
from kestrelite.operators.search import merge_top_k, probe_recall, score_shards, shard_hits
from kestrelite.scratch import materialize

BEAMS = [10, 50, 100, 200]


def run_sweep(vectors: DataFrame, edges: DataFrame, centroids: list, asked: DataFrame, scheme: str, dim: int, k: int = 10, beams: list[int] | None = None, probes: list[int] | None = None, m: int = 16) -> DataFrame:
    """(partitioning, shards, probe, ef, recall, mean_visited, p50_ms, p99_ms), by default for one shard, half of them, and all (0).

    Every walk is made once; what a number of probes gives follows from the place of each shard in the query's plan. The time of a query is that of its
    slowest walk, as shards walk at once. Truth is the exact search over the same vectors.
    """
    numbers = [r["shard_id"] for r in vectors.select("shard_id").distinct().collect()]  # the shards
    plan = score_shards(asked, centroids or [(s, [0.0] * dim) for s in numbers], dim)  # without centroids the lowest shards come first
    walks = search_graphs(vectors, edges, asked, dim, k, beams or BEAMS, m)
    walks = materialize(walks.join(plan.select("qid", "shard_id", "position"), ["qid", "shard_id"]), "sweep")
    truth = merge_top_k(shard_hits(vectors, asked, k, dim), k)
    probes = probes or sorted({1, max(1, len(numbers) // 2), 0})
    recall = probe_recall(walks.select("qid", "shard_id", "doc_id", "score", "position", "ef"), truth, k, probes, ["ef"])
    each = walks.groupBy("qid", "shard_id", "position", "ef").agg(F.max("visited").alias("visited"), F.max("us").alias("us"))
    each = each.withColumn("probe", F.explode(F.array(*[F.lit(p) for p in probes]))).where("probe = 0 OR position <= probe")
    cost = each.groupBy("ef", "probe", "qid").agg(F.sum("visited").alias("visited"), F.max("us").alias("us"))
    cost = cost.groupBy("ef", "probe").agg(F.avg("visited").alias("mean_visited"), F.percentile("us", 0.5).alias("p50"), F.percentile("us", 0.99).alias("p99"))
    out = recall.join(cost, ["ef", "probe"])
    return out.select(F.lit(scheme).alias("partitioning"), F.lit(len(numbers)).alias("shards"), "probe", "ef", "recall", F.round("mean_visited", 3).alias("mean_visited"), (F.col("p50") / 1000).alias("p50_ms"), (F.col("p99") / 1000).alias("p99_ms"))
