"""From raw records to sealed shards: normalise, sample, embed, partition, seal, index, project, query set.

A store is a folder of tables:
  shards/       sealed documents with vectors, by shard_id, numbered from 1 in each    edges/   sealed graph of each shard     projections/
  centroids/    one row a shard; removed if the store isn't partitioned by meaning     ids/     (shard_id, seq, doc_id, source_id)
  queries/      query set                                                              meta/    settings, sizes, digest, what the partitioning did
Steps of one store are written in this order, `meta` last: a store without `meta` isn't complete.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelite.functions.scalars import bucket_of, shard_of, snippet
from kestrelite.operators.corpus import corpus_digest, normalise_records, query_set, stratified_sample
from kestrelite.operators.embed import cached_embeddings
from kestrelite.operators.graph_index import projections
from kestrelite.operators.ordered import sliced, with_number
from kestrelite.operators.partitioning import balanced_assignment, kmeans_rounds, ranked_shards, room_of, shard_labels
from kestrelite.plans.index import index_for
from kestrelite.plans.settings import Settings
from kestrelite.scratch import materialize, remove_path
from kestrelite.sources.sealed import read_sealed, write_sealed


def ingest(raw: DataFrame, store: str, settings: Settings, sample: int | None = None, seed: int = 7, cache: str | None = None) -> dict:
    """Build a store from raw (id, title, abstract, categories); the row of `meta`."""
    spark = raw.sparkSession
    # Ids are hashes of the source's ids; a collision would merge two records, so it is an error.
    docs = normalise_records(raw, "id", "title", "abstract", "categories").withColumnRenamed("doc_id", "source_id").dropDuplicates(["source_id"])
    docs = docs.withColumn("doc_id", F.xxhash64("source_id")).withColumn("bucket", bucket_of(F.col("category")))
    if docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        raise ValueError("two records have the same hashed id")
    if sample:
        docs = stratified_sample(docs, "doc_id", "bucket", sample, seed)
    embedded = cached_embeddings(docs, "doc_id", F.concat_ws(" ", "title", "abstract"), settings.model_dim, cache or f"{store}/cache")
    full = docs.join(embedded, "doc_id")
    vectors = full.select("doc_id", "vector")
    spilled, cap, rounds = 0, 0, 0
    remove_path(spark, f"{store}/centroids")  # those of an earlier partitioning would route wrongly
    if settings.partitioning == "semantic":
        centres, rounds = kmeans_rounds(vectors, settings.shards, settings.model_dim, seed)
        centres = [c / max(float((c * c).sum()) ** 0.5, 1e-12) for c in centres]
        placed = materialize(balanced_assignment(vectors.select("doc_id", ranked_shards(F.col("vector"), centres).alias("shards")), len(centres)), "placed")
        spilled, cap = placed.where("rank > 0").count(), room_of(placed.count(), len(centres))
        full = full.join(placed.select("doc_id", "shard_id"), "doc_id")
        spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "shard_id int, centroid array<double>").write.mode("overwrite").parquet(f"{store}/centroids")
    else:
        full = full.withColumn("shard_id", shard_of(F.col("doc_id"), settings.shards))
    numbered = with_number(sliced(full, ["shard_id"], ["doc_id"]), ["shard_id"], ["doc_id"], "seq")
    write_sealed(numbered.select("doc_id", "source_id", "seq", "title", snippet(F.col("abstract")).alias("snippet"), "category", "bucket", "vector", "shard_id"), f"{store}/shards", "shard_id")
    sealed = read_sealed(spark, f"{store}/shards", "shard_id")
    if sealed.count() != docs.count():
        raise ValueError("not every record came into a shard")
    sealed.select("shard_id", "seq", "doc_id", "source_id").write.mode("overwrite").parquet(f"{store}/ids")
    index_for(settings).seal(sealed, f"{store}/edges", settings.shards, seed)
    projections(sealed, settings.model_dim).write.mode("overwrite").parquet(f"{store}/projections")
    query_set(sealed, "doc_id", "title", 300, seed).write.mode("overwrite").json(f"{store}/queries")
    labels = {str(r["shard_id"]): r["label"] for r in shard_labels(sealed, "shard_id", "bucket").collect()}  # a row a shard
    sizes = {str(r["shard_id"]): r["count"] for r in sealed.groupBy("shard_id").count().collect()}
    digest = corpus_digest(sealed, F.col("doc_id"), F.md5("snippet")).first()
    meta = {"partitioning": settings.partitioning, "index_type": settings.index_type, "dim": settings.model_dim, "m": settings.m, "docs": digest["n"], "digest": digest["digest"], "labels": labels, "sizes": sizes, "shards": settings.shards, "seed": seed, "cap": cap, "spilled": spilled, "iterations": rounds}
    spark.createDataFrame([meta], "partitioning string, index_type string, dim int, m int, docs long, digest string, labels map<string,string>, sizes map<string,long>, shards int, seed int, cap long, spilled long, iterations int").write.mode("overwrite").parquet(f"{store}/meta")
    return meta


def open_store(spark: SparkSession, store: str) -> dict:
    """The row of `meta`, or an error that says that the store isn't complete."""
    try:
        return spark.read.parquet(f"{store}/meta").first().asDict()
    except Exception as e:
        raise FileNotFoundError(f"{store} is no complete store") from e


def store_centroids(spark: SparkSession, store: str, meta: dict) -> list[tuple[int, list[float]]]:
    """(shard, centroid) of a store partitioned by meaning; empty, so that every shard is probed in order, if they are missing or of another number or length."""
    if meta["partitioning"] != "semantic":
        return []
    try:
        rows = spark.read.parquet(f"{store}/centroids").collect()  # a row a shard
    except AnalysisException:
        return []
    sound = len(rows) == meta["shards"] and all(len(r["centroid"]) == meta["dim"] for r in rows)
    return [(r["shard_id"], list(r["centroid"])) for r in rows] if sound else []
