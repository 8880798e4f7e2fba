"""Recorded sessions: results, spans, walks and projections of a few queries, written so that they can be replayed and compared.

A recording is a folder of JSON lines: results/, spans/, traces/, projections/, chapters/, digest/. Readers don't need the store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelite.functions.scalars import uniform_of
from kestrelite.operators.control import stage_spans
from kestrelite.operators.graph_index import hops, search_graphs, walk_digest
from kestrelite.plans.ingest import open_store
from kestrelite.plans.query import embed_asked, run_queries
from kestrelite.scratch import materialize

PARTS = ("results", "spans", "traces", "projections", "chapters", "digest")


def record_session(spark: SparkSession, store: str, queries: DataFrame, out: str, k: int = 10, ef: int = 100, down: list[int] | None = None, cap: int = 10_000) -> dict:
    """Record `queries` (qid, text), a few, against a store: first with all shards, with walks of at most `cap` records, then with those `down` missing."""
    meta = open_store(spark, store)
    chapters = [(0, "queries")] + ([(1, "failover")] if down else [])
    results = []
    for at, _ in chapters:
        found = run_queries(spark, store, queries, k, ef, 0, down if at else None)
        hits = found["hits"].groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score", "title", "snippet", "shard_id"))).alias("hits"))  # k a query
        results.append(found["coverage"].join(hits, "qid", "left").withColumn("chapter", F.lit(at)))
    told = materialize(results[0] if len(results) == 1 else results[0].unionByName(results[1]), "record")
    told = told.join(queries, "qid").withColumn("trace_id", F.md5(F.concat_ws("|", "qid", "chapter", "text")))
    told.write.mode("overwrite").json(f"{out}/results")
    # Times of stages in a recording are drawn by hash of the query: a recording is the same in every run.
    us = lambda name, most: (uniform_of(F.lit(name), F.col("qid"), F.col("chapter")) * most).cast("long")
    timed = told.select("trace_id", F.lit("TRACE_FULL").alias("level"), F.struct(us("embed", 8000).alias("embed_us"), us("plan", 20).alias("plan_us"), us("fanout", 900).alias("fanout_us"), us("merge", 30).alias("merge_us"), F.lit(9000).cast("long").alias("total_us")).alias("timings"))
    stage_spans(timed).write.mode("overwrite").json(f"{out}/spans")
    spark.createDataFrame(chapters, "chapter int, label string").write.mode("overwrite").json(f"{out}/chapters")
    sealed = spark.read.parquet(f"{store}/shards/data").select("doc_id", "shard_id", "vector")
    walks = None
    if meta["index_type"] == "hnsw":
        asked = embed_asked(queries, meta["dim"])
        walks = materialize(search_graphs(sealed, spark.read.parquet(f"{store}/edges/data"), asked, meta["dim"], k, ef, meta["m"], True, cap=cap), "walks")
        first = walks.where("rank = 1").select("qid", "shard_id", "node", "parent", "dist", "offset", "meta", "dropped")
        first.write.mode("overwrite").json(f"{out}/traces")
        held = spark.read.parquet(f"{store}/projections").join(first.select("shard_id").distinct(), "shard_id", "left_semi")
        held.write.mode("overwrite").json(f"{out}/projections")
    digest = structural_digest(told, walks)
    digest.write.mode("overwrite").json(f"{out}/digest")
    return {"queries": told.count(), "chapters": len(chapters)}


def structural_digest(results: DataFrame, walks: DataFrame | None) -> DataFrame:
    """(qid, chapter, shard_id, records, digest): what has to be the same in every run: hits and coverage of a result, and the steps of each walk.

    The row of a result has shard -1; times aren't part of it.
    """
    ids = F.transform(F.coalesce("hits", F.array().cast("array<struct<rank:int,doc_id:bigint,score:double,title:string,snippet:string,shard_id:int>>")), lambda h: h["doc_id"].cast("string"))
    of = results.select("qid", "chapter", F.lit(-1).alias("shard_id"), F.size(ids).cast("long").alias("records"), F.md5(F.concat_ws(",", F.array_join(ids, ","), "probed", "answered", "missing_shards")).alias("digest"))
    if walks is None:
        return of
    return of.union(walk_digest(hops(walks)).select("qid", F.lit(0).alias("chapter"), "shard_id", "records", "digest"))


def load_inspector(spark: SparkSession, path: str, qid: int) -> dict[str, DataFrame]:
    """`walks` (hops) and `projections` of a recorded query, by shard; a shard without a projection has no rows there."""
    traces = spark.read.schema("qid long, shard_id int, node array<int>, parent array<int>, dist array<float>, offset array<int>, meta array<int>, dropped int").json(f"{path}/traces").where(F.col("qid") == qid)
    points = spark.read.schema("shard_id int, row int, doc_id long, x float, y float").json(f"{path}/projections")
    return {"walks": hops(traces), "projections": points.join(traces.select("shard_id").distinct(), "shard_id", "left_semi")}
