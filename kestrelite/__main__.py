"""Command line: python -m kestrelite ingest|query|bench|record|corpus|node|run ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="kestrelite")
    verbs = parser.add_subparsers(dest="verb", required=True)
    ingest = verbs.add_parser("ingest", help="build a store from gzipped JSON lines")
    ingest.add_argument("corpus")
    ingest.add_argument("store")
    ingest.add_argument("--settings", required=True, help="JSON or YAML file")
    ingest.add_argument("--sample", type=int)
    query = verbs.add_parser("query", help="search a store")
    query.add_argument("store")
    query.add_argument("text", nargs="+")
    for name in ("k", "ef", "probe"):
        query.add_argument(f"--{name}", type=int, default=0)
    bench = verbs.add_parser("bench", help="recall and cost of a store's graphs by probes and beams, with gates")
    bench.add_argument("store")
    bench.add_argument("--out", required=True, help="folder of results")
    bench.add_argument("--no-merge", action="store_true", help="drop the results of other partitionings")
    record = verbs.add_parser("record", help="record queries against a store")
    record.add_argument("store")
    record.add_argument("out")
    record.add_argument("text", nargs="*", help="by default the store's query set")
    record.add_argument("--down", type=int, nargs="*", default=[], help="shards that don't answer in a second chapter")
    corpus = verbs.add_parser("corpus", help="copy the first part of gzipped JSON lines as a table")
    corpus.add_argument("source")
    corpus.add_argument("out")
    corpus.add_argument("--max-mb", type=int)
    node = verbs.add_parser("node", help="add or remove a backup in a table of shard maps")
    node.add_argument("change", choices=("add", "remove"))
    node.add_argument("map")
    node.add_argument("shard", type=int)
    node.add_argument("name")
    run = verbs.add_parser("run", help="run a registered query over a folder of tables")
    run.add_argument("name")
    run.add_argument("directory")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("kestrelite").getOrCreate()
    if a.verb == "ingest":
        from kestrelite.plans.ingest import ingest as build
        from kestrelite.plans.settings import read_settings
        from kestrelite.sources.files import read_corpus

        print(json.dumps(build(read_corpus(spark, a.corpus), a.store, read_settings(a.settings), a.sample)))
    elif a.verb == "query":
        from kestrelite.plans.query import run_queries

        out = run_queries(spark, a.store, spark.createDataFrame(list(enumerate(a.text)), "qid long, text string"), a.k, a.ef, a.probe)
        for r in out["hits"].orderBy("qid", "rank").collect():
            print(json.dumps(r.asDict()))
        for r in out["coverage"].collect():
            print(json.dumps(r.asDict()))
    elif a.verb == "bench":
        raise SystemExit(_bench(spark, a.store, a.out, not a.no_merge))
    elif a.verb == "record":
        from kestrelite.plans.record import record_session
        from kestrelite.sources.files import read_query_texts

        texts = spark.createDataFrame(list(enumerate(a.text)), "qid long, text string") if a.text else read_query_texts(spark, f"{a.store}/queries")
        print(json.dumps(record_session(spark, a.store, texts, a.out, down=a.down)))
    elif a.verb == "corpus":
        from kestrelite.sources.files import read_corpus

        read_corpus(spark, a.source, a.max_mb * (1 << 20) if a.max_mb else None).write.mode("overwrite").parquet(a.out)
    elif a.verb == "node":
        from kestrelite.operators.membership import apply_commands, map_after

        maps = spark.read.parquet(a.map)
        told = apply_commands(maps, spark.createDataFrame([(1, a.shard, a.change, a.name)], "at long, shard_id int, verb string, node string")).first()
        if told["ok"]:
            map_after(maps, a.shard, a.change, a.name).write.mode("append").parquet(a.map)
        print(json.dumps(told.asDict()))
        raise SystemExit(0 if told["ok"] else 1)
    else:
        from kestrelite.queries import collect

        collect()[0][a.name](spark, a.directory).show(50, truncate=False)


def _bench(spark: SparkSession, store: str, out: str, merge: bool) -> int:
    """Sweep a store's graphs, keep the results, and say which gates fail; 1 if any does."""
    from kestrelite.plans.gates import recall_series, sweep_gates
    from kestrelite.plans.ingest import open_store, store_centroids
    from kestrelite.plans.query import embed_asked
    from kestrelite.plans.sweep import run_sweep
    from kestrelite.scratch import materialize
    from kestrelite.sources.files import read_query_texts, read_results, write_results

    meta = open_store(spark, store)
    v = spark.read.parquet(f"{store}/shards/data").select("doc_id", "shard_id", "vector")
    asked = materialize(embed_asked(read_query_texts(spark, f"{store}/queries"), meta["dim"]), "asked")
    found = materialize(run_sweep(v, spark.read.parquet(f"{store}/edges/data"), store_centroids(spark, store, meta), asked, meta["partitioning"], meta["dim"], m=meta["m"]), "sweep-results")
    write_results(found, out, merge)
    for r in recall_series(read_results(spark, out)).orderBy("partitioning", "place").collect():
        print(json.dumps(r.asDict()))
    failed = sweep_gates(found, "hash").where("NOT passed").collect()
    for r in failed:
        print(json.dumps({"failed": r["gate"], "partitioning": r["partitioning"], "ef": r["ef"]}))
    return int(bool(failed))


if __name__ == "__main__":
    main()
