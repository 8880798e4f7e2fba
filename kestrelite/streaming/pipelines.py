"""Event pipelines on Structured Streaming: each runs over what is available, with its checkpoint in the shared folder, and can be started again.

Rows that are final are appended as Parquet: windows and sessions in append mode, when the watermark has passed them, after which their state is freed
and rows for them are too late. Running aggregates of few keys are a table that each batch replaces (written beside the old one, so a reader never sees
half of it). Folds over a node's events (health, gaps) keep one row a node between batches, in a table by batch number; within a batch they are the
batch operators over ordered slices, so a node that sends most of a batch is many tasks. A restarted query goes on after the last committed batch,
and a batch that is run again writes the same tables again, so nothing is lost or counted twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelite.functions.scalars import topic_of
from kestrelite.operators.membership import DOWN, SUSPECT
from kestrelite.operators.ordered import sliced, with_lag, with_number, with_running
from kestrelite.operators.redelivery import normalised_node
from kestrelite.scratch import materialize, scratch_path


def stream_table(spark: SparkSession, directory: str, name: str, files: int = 64) -> DataFrame:
    """A table as a stream of its files, at most `files` a batch; the schema is the table's, never inferred from the stream."""
    path = f"{directory}/{name}.parquet"
    # As a pattern, since a stream of a plain path has to be a folder, and a table may be one file.
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(f"{directory}/{name}[.]parquet")


def run_append(stream: DataFrame, tag: str) -> DataFrame:
    """Run to the end of what is available; the rows that were appended."""
    spark = stream.sparkSession
    out = scratch_path(spark, tag)
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", scratch_path(spark, f"{tag}-log")).option("path", out).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_complete(stream: DataFrame, tag: str) -> DataFrame:
    """Run to the end of what is available; the aggregate, of few keys, after the last batch."""
    spark = stream.sparkSession
    out = scratch_path(spark, tag)
    last: list[str] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{number}")
        last.append(f"{out}/{number}")

    query = stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", scratch_path(spark, f"{tag}-log")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(last[-1]) if last else spark.createDataFrame([], stream.schema)


def run_folded(stream: DataFrame, fold: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]], state: str, out: str, tag: str) -> DataFrame:
    """Run to the end of what is available; all rows that `fold` gave.

    fold: (batch, state) to (rows, state after the batch). `state` and `out` are schemas; a state has one row a key and is written by batch number.
    """
    spark = stream.sparkSession
    root, done = scratch_path(spark, tag), []

    def step(batch: DataFrame, number: int) -> None:
        held = spark.read.schema(state).parquet(f"{root}/state-{number - 1}") if number else spark.createDataFrame([], state)
        rows, after = fold(batch, held)
        rows.write.mode("overwrite").parquet(f"{root}/rows-{number}")
        after.write.mode("overwrite").parquet(f"{root}/state-{number}")
        done.append(f"{root}/rows-{number}")

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", scratch_path(spark, f"{tag}-log")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out).parquet(*sorted(set(done))) if done else spark.createDataFrame([], out)


def topic_counts(events: DataFrame) -> DataFrame:
    """Running number of events by topic."""
    return events.groupBy(topic_of(F.col("span"), F.col("stats")).alias("topic")).agg(F.count(F.lit(1)).alias("n"))


def run_fan_out(events: DataFrame, topics: list[str], tag: str) -> dict[str, DataFrame]:
    """What a subscriber of each topic gets: one read of the stream, a table a topic. Other topics, and topics that don't exist, get nothing."""
    spark = events.sparkSession
    root, done = scratch_path(spark, tag), []

    def send(batch: DataFrame, number: int) -> None:
        told = batch.withColumn("topic", topic_of(F.col("span"), F.col("stats")))
        told.where(F.col("topic").isin(*topics)).write.mode("overwrite").partitionBy("topic").parquet(f"{root}/batch={number}")
        done.append(number)

    query = events.writeStream.foreachBatch(send).option("checkpointLocation", scratch_path(spark, f"{tag}-log")).trigger(availableNow=True).start()
    query.awaitTermination()
    columns = events.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields) + ", batch int, topic string"
    all_ = spark.read.schema(schema).parquet(root) if done else spark.createDataFrame([], schema)
    return {t: all_.where(F.col("topic") == t).select(*columns) for t in topics}


def tumbling_means(events: DataFrame, time: str, by: str, value: str, width: str, late: str) -> DataFrame:
    """Events and their mean value in windows of event time, each when it is closed; rows more than `late` behind the newest are left out once theirs is."""
    held = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    g = held.groupBy(F.window("_t", width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("begins"), by, "n", "mean")


def sessions(events: DataFrame, time: str, key: str, pause: str, late: str) -> DataFrame:
    """Runs of a key's events without a pause of `pause` or more, each when it is over."""
    held = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    g = held.groupBy(F.session_window("_t", pause).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, F.col("w.start").cast("timestamp_ntz").alias("begins"), "n")


HEALTH, HEALTH_STATE = "node long, event_id long, misses long, state string", "node long, misses long"


def health_fold(batch: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, event_id, misses, state) of each probe (node, ts, event_id, alive); between batches a node has its misses in a row.

    Probes of a node are taken in order within a batch, and batches as they arrive.
    """
    order = ["ts", "event_id"]
    p = with_number(sliced(batch, ["node"], order), ["node"], order, "_k")
    p = with_running(p, ["node"], order, "_ok", F.when(F.col("alive"), F.col("_k")).otherwise(F.lit(0)), "max")
    p = p.join(state.select("node", F.col("misses").alias("_before")), "node", "left")
    carried = F.when(F.col("_ok") == 0, F.coalesce("_before", F.lit(0))).otherwise(0)
    p = materialize(p.withColumn("misses", (F.col("_k") - F.col("_ok") + carried).cast("long")), "health")
    told = F.when(F.col("misses") >= DOWN, "DOWN").when(F.col("misses") >= SUSPECT, "SUSPECT").otherwise("HEALTHY")
    last = p.groupBy("node").agg(F.max_by("misses", "_k").alias("misses"))
    rest = state.join(last.select("node"), "node", "left_anti").select("node", "misses")
    return p.select("node", "event_id", "misses", told.alias("state")), rest.union(last)


GAPS, GAP_STATE = "node_id string, seq long, dropped long", "node_id string, last long"


def gap_fold(batch: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node_id, seq, dropped) for each arrival that left numbers out; between batches a node has its last number. A lower number resets it."""
    order = ["batch_id", "t_mono_ns", "seq"]
    narrow = batch.select(normalised_node(F.col("node_id")).alias("node_id"), *order).where("seq IS NOT NULL")
    g = with_lag(sliced(narrow, ["node_id"], order), ["node_id"], order, {"before": "seq"})
    held = state.select(F.col("node_id").alias("_node"), F.col("last").alias("_last"))
    g = g.join(held, F.col("node_id").eqNullSafe(F.col("_node")), "left").select("node_id", *order, F.coalesce("before", "_last").alias("before"))
    g = materialize(g, "gaps")
    last = g.groupBy("node_id").agg(F.max_by("seq", F.struct(*order)).alias("last"))
    rest = held.join(last, F.col("_node").eqNullSafe(F.col("node_id")), "left_anti").select(F.col("_node").alias("node_id"), F.col("_last").alias("last"))
    dropped = F.col("seq") - F.col("before") - 1
    return g.where(dropped > 0).select("node_id", "seq", dropped.alias("dropped")), rest.union(last)


def replicate(source: DataFrame, tag: str) -> DataFrame:
    """A copy of a table as a stream: the source offset in the checkpoint is what has been acknowledged, and a restart resumes there."""
    return run_append(source, tag)
