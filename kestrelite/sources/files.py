"""Corpus and event files: compressed JSON lines with a torn end, recorded event bundles, benchmark results."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelite.sources.filesystem import open_uri

CORPUS = "id string, title string, abstract string, categories string"
EVENTS = (
    "nodeId string, seq string, tMonoNs string, span struct<traceId:string,kind:string,tStartNs:string,tEndNs:string,shardId:int,detailJson:string>,"
    "stats struct<rssBytes:string,docCount:string,qps1s:float,p50Us:string,p99Us:string,primarySeq:string,appliedSeq:string,state:string,edgeCount:string>,"
    "state struct<from:string,to:string,health:string,reason:string>"
)


def read_corpus(spark: SparkSession, path: str, limit_bytes: int | None = None) -> DataFrame:
    """Records of gzipped JSON lines. A file whose end is torn off gives the records before the tear; `limit_bytes` reads that much of each file.

    One task reads one file as a stream, so a file of any size fits; lines that aren't JSON are left out.
    """
    names = spark.read.format("binaryFile").load(path).select("path")  # the content isn't read here

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            for name in batch.column(0).to_pylist():
                system, inner = open_uri(name)
                left, rest, unpack = limit_bytes, b"", zlib.decompressobj(31)
                with system.open_input_stream(inner, compression=None) as stream:
                    while left is None or left > 0:
                        part = stream.read(1 << 20 if left is None else min(left, 1 << 20))
                        if not part:
                            break
                        left = None if left is None else left - len(part)
                        try:
                            rest += unpack.decompress(part)
                            while unpack.eof and unpack.unused_data:
                                more, unpack = unpack.unused_data, zlib.decompressobj(31)
                                rest += unpack.decompress(more)
                        except zlib.error:
                            break
                        *whole, rest = rest.split(b"\n")
                        if whole:
                            yield pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in whole], pa.string())], ["line"])
                if unpack.eof and rest.strip():
                    yield pa.RecordBatch.from_arrays([pa.array([rest.decode("utf-8", "replace")], pa.string())], ["line"])

    text = names.mapInArrow(lines, "line string")
    return text.select(F.from_json("line", CORPUS).alias("r")).where("r IS NOT NULL AND r.id IS NOT NULL").select("r.*")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines as they are; blank lines are skipped, malformed ones left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A recorded event bundle in the columns of `node_events`: numbers out of strings, ids in hex, a missing shard is shard 0."""
    e = read_json_lines(spark, path, EVENTS)
    n = lambda c: F.expr(f"try_cast({c} as bigint)")
    return e.where("nodeId IS NOT NULL").select(
        F.col("nodeId").alias("node_id"), n("seq").alias("seq"), n("tMonoNs").alias("t_mono_ns"),
        F.when(F.col("span").isNotNull(), F.struct(F.lower(F.hex(F.unbase64("span.traceId"))).alias("trace_id"), F.col("span.kind").alias("kind"), n("span.tStartNs").alias("t_start_ns"), n("span.tEndNs").alias("t_end_ns"), F.coalesce("span.shardId", F.lit(0)).alias("shard_id"), F.col("span.detailJson").alias("detail_json"))).alias("span"),
        F.when(F.col("stats").isNotNull(), F.struct(F.coalesce(n("stats.rssBytes"), F.lit(0)).alias("rss_bytes"), F.coalesce(n("stats.docCount"), F.lit(0)).alias("doc_count"), F.coalesce("stats.qps1s", F.lit(0.0).cast("float")).alias("qps_1s"), F.coalesce(n("stats.p50Us"), F.lit(0)).alias("p50_us"), F.coalesce(n("stats.p99Us"), F.lit(0)).alias("p99_us"), F.coalesce(n("stats.primarySeq"), F.lit(0)).alias("primary_seq"), F.coalesce(n("stats.appliedSeq"), F.lit(0)).alias("applied_seq"), F.col("stats.state").alias("state"), F.coalesce(n("stats.edgeCount"), F.lit(0)).alias("edge_count"))).alias("stats"),
        F.when(F.col("state").isNotNull(), F.struct(F.col("state.from").alias("from_state"), F.col("state.to").alias("to_state"), F.col("state.health").alias("health"), F.col("state.reason").alias("reason"))).alias("state_change"),
    )


def write_events(events: DataFrame, path: str) -> None:
    """Record events (columns of `node_events`, trace ids in hex) as a bundle that `read_events` reads: numbers as strings, zeros left out."""
    s = lambda c: F.when(F.coalesce(c, F.lit(0)) != 0, c.cast("string"))
    span, stats, change = F.col("span"), F.col("stats"), F.col("state_change")
    line = F.struct(
        F.col("node_id").alias("nodeId"), s(F.col("seq")).alias("seq"), s(F.col("t_mono_ns")).alias("tMonoNs"),
        F.when(span.isNotNull(), F.struct(F.base64(F.unhex(span["trace_id"])).alias("traceId"), span["kind"].alias("kind"), s(span["t_start_ns"]).alias("tStartNs"), s(span["t_end_ns"]).alias("tEndNs"), F.when(span["shard_id"] != 0, span["shard_id"]).alias("shardId"), span["detail_json"].alias("detailJson"))).alias("span"),
        F.when(stats.isNotNull(), F.struct(s(stats["rss_bytes"]).alias("rssBytes"), s(stats["doc_count"]).alias("docCount"), F.when(stats["qps_1s"] != 0, stats["qps_1s"]).alias("qps1s"), s(stats["p50_us"]).alias("p50Us"), s(stats["p99_us"]).alias("p99Us"), s(stats["primary_seq"]).alias("primarySeq"), s(stats["applied_seq"]).alias("appliedSeq"), stats["state"].alias("state"), s(stats["edge_count"]).alias("edgeCount"))).alias("stats"),
        F.when(change.isNotNull(), F.struct(change["from_state"].alias("from"), change["to_state"].alias("to"), change["health"].alias("health"), change["reason"].alias("reason"))).alias("state"),
    )
    events.select(F.to_json(line)).write.mode("overwrite").text(path)


def merge_by_scheme(before: DataFrame, new: DataFrame, scheme: str = "partitioning") -> DataFrame:
    """Results of earlier runs with those of the same scheme replaced by new ones."""
    return before.join(new.select(scheme).distinct(), scheme, "left_anti").unionByName(new, allowMissingColumns=True)


def longest_valid_prefix(log: DataFrame, at: str, valid: str) -> DataFrame:
    """The entries of a log before its first invalid one."""
    torn = log.where(~F.col(valid)).agg(F.min(at).alias("_torn"))  # one row
    return log.join(F.broadcast(torn)).where(F.col("_torn").isNull() | (F.col(at) < F.col("_torn"))).drop("_torn")


def restore_log(log: DataFrame, at: str, valid: str, state: dict | None, fresh: dict) -> tuple[DataFrame, dict]:
    """(entries, state) after a restart: entries before the first invalid one, and the stored state, or a fresh one if it is missing or lacks a field."""
    sound = state is not None and all(state.get(k) is not None for k in fresh)
    return longest_valid_prefix(log, at, valid), dict(state) if sound else dict(fresh)


#: What is asked where no query set was written.
FALLBACK_TEXTS = ("galaxy rotation curves", "sparse attention", "random matrices", "enzyme kinetics", "spin glasses", "graph colouring", "tensor networks", "monte carlo sampling")


def read_query_texts(spark: SparkSession, path: str) -> DataFrame:
    """(qid, text) of a query set in JSON lines; a fixed short list if there is none, or none with a text."""
    from pyspark.errors import AnalysisException

    try:
        found = read_json_lines(spark, path, "qid long, text string").where("length(text) > 0")
        if found.limit(1).count():
            return found
    except AnalysisException:
        pass
    return spark.createDataFrame(list(enumerate(FALLBACK_TEXTS)), "qid long, text string")


RESULTS = "partitioning string, shards int, probe int, ef int, recall double, mean_visited double, p50_ms double, p99_ms double"


def read_results(spark: SparkSession, path: str) -> DataFrame | None:
    """Results of sweeps in JSON lines; None if nothing was written there."""
    from pyspark.errors import AnalysisException

    try:
        return read_json_lines(spark, path, RESULTS)
    except AnalysisException:
        return None


def write_results(results: DataFrame, path: str, merge: bool = True) -> None:
    """Write results of a sweep; with `merge` those of other partitionings stay and those of the same are replaced. A few rows, read before they are written."""
    spark = results.sparkSession
    before = read_results(spark, path) if merge else None
    whole = results.select(*[c.split()[0] for c in RESULTS.split(", ")])
    whole = merge_by_scheme(before, whole) if before is not None else whole
    rows = [tuple(r) for r in whole.collect()]  # a row a setting
    spark.createDataFrame(rows, RESULTS).coalesce(1).write.mode("overwrite").json(path)
