"""Partitioning of vectors into shards: k-means centres, capacity-balanced assignment, labels, replica choice."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrelite.functions.vectors import dot, squared_distance
from kestrelite.operators.ordered import sliced, with_number
from kestrelite.operators.search import _matrix
from kestrelite.scratch import materialize, release


RANGES = 1 << 14


def literal_vector(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def nearest_centre(vector: Column, centres: list) -> Column:
    """Struct (distance, centre) of the centre at the least squared distance; ties to the lower number. Centres are few and fixed."""
    each = F.array(*[F.struct(squared_distance(vector, literal_vector(c)).alias("distance"), F.lit(i).cast("int").alias("centre")) for i, c in enumerate(centres)])
    return F.array_min(each)


def ranked_shards(vector: Column, centroids: list) -> Column:
    """Shard numbers from the most to the least similar centroid; ties to the lower number."""
    each = F.array(*[F.struct((-dot(vector, literal_vector(c))).alias("far"), F.lit(i).cast("int").alias("shard")) for i, c in enumerate(centroids)])
    return F.transform(F.array_sort(each), lambda x: x["shard"])


def kmeans(vectors: DataFrame, k: int, dim: int, seed: int = 0, iterations: int = 25, sample_rows: int = 16_384) -> np.ndarray:
    """The centres of `kmeans_rounds`."""
    return kmeans_rounds(vectors, k, dim, seed, iterations, sample_rows)[0]


def kmeans_rounds(vectors: DataFrame, k: int, dim: int, seed: int = 0, iterations: int = 25, sample_rows: int = 16_384) -> tuple[np.ndarray, int]:
    """(centres, steps taken): centres by Lloyd steps over all vectors (column `vector`, ids in `doc_id`), seeded by k-means++ on at most about `sample_rows` of them.

    Each step is one scan that returns k sums a task. An empty centre stays; the end is a total shift below 1e-4. No vectors: no centres.
    """
    n = vectors.count()
    take = vectors if n <= sample_rows else vectors.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * sample_rows / n))
    table = take.select("doc_id", "vector").toArrow()
    table = table.take(np.argsort(table["doc_id"].to_numpy(), kind="stable"))
    x = _matrix(table["vector"], dim)[1]
    if not len(x):
        return np.empty((0, dim)), 0
    rng = np.random.default_rng(seed)
    centres = [x[rng.integers(len(x))]]
    while len(centres) < min(k, len(x)):
        d = np.min([np.square(x - c).sum(1) for c in centres], axis=0)
        centres.append(x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))])
    c, taken = np.stack(centres), 0
    for taken in range(1, iterations + 1):
        held = vectors.sparkSession.sparkContext.broadcast(c)  # k vectors

        def add(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            c = held.value
            total, count = np.zeros_like(c), np.zeros(len(c), np.int64)
            for batch in batches:
                x = _matrix(batch.column(0), dim)[1]
                if len(x):
                    near = (np.square(c).sum(1) - 2 * x @ c.T).argmin(1)
                    count += np.bincount(near, minlength=len(c))
                    np.add.at(total, near, x)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(c)), pa.int32()), pa.array(count), pa.array(total.tolist(), pa.list_(pa.float64()))], ["centre", "n", "total"])

        total, count = np.zeros_like(c), np.zeros(len(c), np.int64)
        for r in vectors.select("vector").mapInArrow(add, "centre int, n long, total array<double>").toLocalIterator():
            count[r["centre"]] += r["n"]
            total[r["centre"]] += r["total"]
        new = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
        shift, c = np.linalg.norm(new - c), new
        if shift < 1e-4:
            break
    return c, taken


def room_of(rows: int, shards: int, slack_permille: int = 1300) -> int:
    """How many rows a shard may hold: ceil(1.3 rows / shards)."""
    return -(-slack_permille * rows // (1000 * shards))


def balanced_assignment(ranked: DataFrame, shards: int, slack_permille: int = 1300) -> DataFrame:
    """(doc_id, shard_id, rank): docs in order of id take their most similar shard that has room; a shard holds at most ceil(1.3 n / shards).

    `ranked`: (doc_id, shards in order of preference). The serial choice equals rounds of proposals: each doc stands at its best shard so far, a
    shard keeps its smallest ids up to its room, the others move on. A round is a histogram of ids by shard and a scan, without any sort of all docs.
    """
    now = materialize(ranked.select("doc_id", F.col("shards"), F.lit(1).alias("at")), "balanced")
    room = room_of(now.count(), shards, slack_permille)
    shard = F.element_at("shards", F.col("at"))
    while True:
        # Each shard needs the id of its last row that has room. Ids are cut into RANGES of equal width: a histogram of as many rows a shard at most
        # tells the range that holds it, and only the ids in there are ranked.
        bounds = now.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
        lo = bounds["lo"] if bounds["lo"] is not None else 0
        width = max(1, -(-((bounds["hi"] or 0) - lo + 1) // RANGES))
        placed = now.withColumn("shard_id", shard).withColumn("cut", F.floor((F.col("doc_id").cast("decimal(20,0)") - F.lit(lo).cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)")).cast("int"))
        hist = placed.groupBy("shard_id", "cut").agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy("shard_id").orderBy("cut").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        edge = materialize(hist.withColumn("upto", upto).where((F.col("upto") > room) & (F.col("upto") - F.col("n") <= room)).select("shard_id", F.col("cut").alias("edge"), (F.lit(room) - F.col("upto") + F.col("n")).alias("rest")), "balanced")
        if not edge.limit(1).count():  # no shard holds more than its room
            return now.select("doc_id", shard.alias("shard_id"), (F.col("at") - 1).alias("rank"))
        at_edge = placed.join(F.broadcast(edge), "shard_id").where("cut = edge").select("shard_id", "doc_id", "rest")  # a row a shard
        numbered = with_number(sliced(at_edge, ["shard_id"], ["doc_id"]), ["shard_id"], ["doc_id"], "number")
        first = numbered.where("number = rest + 1").select("shard_id", F.col("doc_id").alias("first"))  # the first id without room
        out = F.col("first").isNotNull() & (F.col("doc_id") >= F.col("first"))
        after = placed.join(F.broadcast(first), "shard_id", "left").select("doc_id", "shards", (F.col("at") + F.when(out, 1).otherwise(0)).alias("at"))
        after = materialize(after, "balanced")
        release(now)
        now = after


def shard_labels(rows: DataFrame, shard: str, bucket: str) -> DataFrame:
    """(shard, n, label): the most frequent bucket of each shard with its rounded share (half to even); ties to the first bucket in order."""
    each = rows.groupBy(shard, bucket).agg(F.count(F.lit(1)).alias("n"))
    top = each.groupBy(shard).agg(F.sum("n").alias("total"), F.min_by(F.struct(bucket, "n"), F.struct(-F.col("n"), F.col(bucket))).alias("top"))
    share = F.bround(F.lit(100.0) * F.col("top.n") / F.col("total")).cast("int")
    return top.select(shard, F.col("total").alias("n"), F.concat(F.col(f"top.{bucket}"), F.lit(".*("), share.cast("string"), F.lit("%)")).alias("label"))
