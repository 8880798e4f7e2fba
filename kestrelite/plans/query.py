"""A batch of text queries against a store: embed, plan, scatter, gather, merge, hydrate, with coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelite.operators.embed import hash_embedding
from kestrelite.operators.search import coverage, merge_top_k, plan_probes, score_shards
from kestrelite.plans.index import index_of
from kestrelite.plans.ingest import open_store, store_centroids
from kestrelite.scratch import materialize


def embed_asked(queries: DataFrame, dim: int) -> DataFrame:
    """(qid, vector) of the texts."""
    return queries.select("qid", hash_embedding(dim)(F.col("text")).alias("vector"))


def run_queries(spark: SparkSession, store: str, queries: DataFrame, k: int = 0, ef: int = 0, probe: int = 0, down: list[int] | None = None) -> dict[str, DataFrame]:
    """`hits` (qid, rank, doc_id, score, title, snippet, category, shard_id), `coverage` and `rejected` (qid, reason).

    queries: (qid, text). Empty text is rejected. 0 stands for the defaults: k 10, ef 100, all shards probed. `down`: shards that don't answer; they
    are missing in the coverage, and the hits are those of the others. Without centroids shards are probed in order of number. Shards that a query doesn't
    probe, or that don't answer, are neither read nor searched for it.
    """
    meta = open_store(spark, store)
    k, ef = k or 10, ef or 100
    empty = F.trim(F.coalesce("text", F.lit(""))) == ""
    rejected = queries.where(empty).select("qid", F.lit("INVALID_ARGUMENT").alias("reason"))
    asked = materialize(embed_asked(queries.where(~empty), meta["dim"]), "asked")
    sealed = spark.read.parquet(f"{store}/shards/data")
    numbers = [r["shard_id"] for r in spark.read.parquet(f"{store}/shards/counts").select("shard_id").collect()]  # the shards
    centroids = store_centroids(spark, store, meta) or [(s, [0.0] * meta["dim"]) for s in numbers]  # without any, shards in order of number
    plan = plan_probes(score_shards(asked, centroids, meta["dim"]).drop("position"), probe)
    health = spark.createDataFrame([(s, s not in (down or [])) for s in numbers], "shard_id int, answers boolean")
    answered = plan.where("probed").join(F.broadcast(health.where("answers")), "shard_id", "left_semi").select("qid", "shard_id")
    answered = None if probe <= 0 and not down else materialize(answered, "answered")
    vectors = sealed.select("doc_id", "shard_id", "vector")
    found = index_of(meta["index_type"], meta["dim"], meta["m"]).search(vectors, f"{store}/edges", asked, k, ef, answered)
    hits = merge_top_k(found, k)
    # Titles and snippets are fetched for what is left.
    hits = hits.join(sealed.select("doc_id", "title", "snippet", "category"), "doc_id", "left").select("qid", "rank", "doc_id", "score", "title", "snippet", "category", "shard_id")
    return {"hits": hits, "coverage": coverage(plan, health), "rejected": rejected}
