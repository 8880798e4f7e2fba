"""Exact and routed search: scoring kernels, per-shard top-k, merge, probing and coverage.

Scores are inner products in double. Vectors are scored by dense products of blocks (Arrow to NumPy); the winners are then summed left to right,
which gives the same bits as the column expression `dot`. Top-k is by (score descending, id ascending), k beyond the rows gives all rows, and
null vectors or vectors of another length score nothing.

A query set is sent in blocks of a fixed size: up to BLOCK queries are one broadcast of a bounded size, and vectors stay where they are; a larger set
is cut into blocks by hash, a shard's vectors into chunks of about CHUNK rows, and a pair of a chunk and a block is one task. Every task returns k rows
a query, which are merged.

With a plan, (qid, shard_id), a query meets the vectors of its shards only: of a table partitioned by shard no other files are read, and within a
shard only the queries that probe it are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries of one block: 4,096 vectors of 64 doubles are 2 MB.
BLOCK = 4096
#: Vectors of a shard in one task, about, when a large query set is sent.
CHUNK = 100_000
#: Rows of a plan that come to the driver, and centroids that go to a task, at most.
PLAN_ROWS, CENTROIDS = 1_000_000, 16_384
HITS = "qid long, shard_id int, doc_id long, score double"


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have a full vector, their vectors)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    length = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ok = np.flatnonzero(length == dim)
    flat = column.take(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return ok, flat.reshape(-1, dim)


def _left_to_right(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def _best(qids: np.ndarray, queries: np.ndarray, ids: np.ndarray, shards: np.ndarray, vectors: np.ndarray, k: int, probes: dict[int, np.ndarray] | None = None) -> tuple:
    """Top k of each (query, shard) within a block of vectors. `probes`: by shard, the positions of the queries that meet it (all without it)."""
    out: list[tuple] = []
    for shard in np.unique(shards).tolist():
        asks = np.arange(len(qids)) if probes is None else probes.get(shard)
        if asks is None or not len(asks):
            continue
        of = np.flatnonzero(shards == shard)
        of = of[np.argsort(ids[of], kind="stable")]
        for lo in range(0, len(asks), 512):
            who = asks[lo : lo + 512]
            score = queries[who] @ vectors[of].T
            n = min(k + 8, len(of))
            top = np.argpartition(-score, n - 1, axis=1)[:, :n]
            least = np.take_along_axis(score, top, 1).min(1) - 1e-9
            row, col = np.nonzero(score >= least[:, None])
            exact = _left_to_right(queries[who[row]], vectors[of[col]])
            order = np.lexsort((ids[of[col]], -exact, row))
            row, col, exact = row[order], col[order], exact[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < k
            out.append((qids[who[row[keep]]], np.full(keep.sum(), shard, np.int32), ids[of[col[keep]]], exact[keep]))
    if not out:
        return (np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(4))


@dataclass(frozen=True)
class Route:
    """A plan that follows from centroids: each query probes the `probe` shards whose centroid is most similar, ties to the lower shard (0: all)."""

    centroids: list
    probe: int

    def of(self, vectors: np.ndarray) -> dict[int, list[int]]:
        """By shard the positions of the vectors that probe it; for one block of queries."""
        order = sorted(self.centroids)
        score = np.stack([_left_to_right(vectors, np.broadcast_to(np.asarray(c, np.float64), vectors.shape)) for _, c in order], 1) if order else np.empty((len(vectors), 0))
        best = np.argsort(-score, axis=1, kind="stable")[:, : self.probe or len(order)]
        by: dict[int, list[int]] = {}
        for i, row in enumerate(best.tolist()):
            for j in row:
                by.setdefault(order[j][0], []).append(i)
        return by

    def frame(self, queries: DataFrame, dim: int) -> DataFrame:
        return score_shards(queries, self.centroids, dim, best=self.probe).select("qid", "shard_id")


def bounded_probes(plan: DataFrame | Route | None, qids: list[int], vectors: np.ndarray) -> tuple[bool, dict[int, np.ndarray] | None]:
    """(whether the plan is small enough for the driver, by shard the positions in `qids` of the queries that probe it)."""
    if plan is None:
        return True, None
    by: dict[int, list[int]] = {}
    if isinstance(plan, Route):
        if len(qids) * (plan.probe or len(plan.centroids)) > PLAN_ROWS:
            return False, None
        by = plan.of(vectors)
    else:
        rows = plan.select(F.col("qid").cast("long"), F.col("shard_id").cast("int")).limit(PLAN_ROWS + 1).toArrow()
        if rows.num_rows > PLAN_ROWS:
            return False, None
        at = {q: i for i, q in enumerate(qids)}
        for q, shard in zip(rows["qid"].to_pylist(), rows["shard_id"].to_pylist(), strict=True):
            if q in at:
                by.setdefault(shard, []).append(at[q])
    return True, {shard: np.array(sorted(set(who)), np.int64) for shard, who in by.items()}


def of_shards(rows: DataFrame, probes: dict[int, np.ndarray] | None) -> DataFrame:
    """Only the rows of the shards that are probed; of a table partitioned by shard only their files are read."""
    return rows if probes is None else rows.where(F.col("shard_id").isin(*sorted(probes)) if probes else F.lit(False))


def shard_hits(vectors: DataFrame, queries: DataFrame, k: int, dim: int, plan: DataFrame | Route | None = None) -> DataFrame:
    """(qid, shard_id, doc_id, score): the k best of each shard for each query, partial, as a scatter returns them.

    vectors: (doc_id, shard_id, vector); queries: (qid, vector); plan: (qid, shard_id), the shards that a query probes, all without it.
    """
    spark = vectors.sparkSession
    narrow = vectors.select(F.col("doc_id").cast("long"), F.col("shard_id").cast("int"), "vector")
    asked = queries.select(F.col("qid").cast("long"), "vector")

    def rows(found: tuple) -> pa.Table:
        return pa.table({"qid": pa.array(found[0], pa.int64()), "shard_id": pa.array(found[1], pa.int32()), "doc_id": pa.array(found[2], pa.int64()), "score": pa.array(found[3], pa.float64())})

    table = asked.limit(BLOCK + 1).toArrow()  # never more than one block comes to the driver
    if table.num_rows <= BLOCK:
        at, q = _matrix(table["vector"], dim)
        qids = table["qid"].to_numpy()[at]
        few, probes = bounded_probes(plan, qids.tolist(), q)
        if few:
            held = spark.sparkContext.broadcast((qids, q, probes))

            def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                qids, q, probes = held.value
                for batch in batches:
                    at, v = _matrix(batch.column(2), dim)
                    if len(at):
                        yield from rows(_best(qids, q, batch.column(0).to_numpy()[at], batch.column(1).to_numpy()[at], v, k, probes)).combine_chunks().to_batches()

            return of_shards(narrow, probes).mapInArrow(scan, HITS)
    # Cells of (shard, chunk, block). How many chunks and blocks a shard has follows its rows and its queries.
    if isinstance(plan, Route):
        plan = plan.frame(asked, dim)
    if plan is None:
        plan = asked.select("qid").join(narrow.select("shard_id").distinct(), how="cross")  # a query set against all shards
    pairs = plan.select(F.col("qid").cast("long"), F.col("shard_id").cast("int")).distinct()
    size = narrow.groupBy("shard_id").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    size = size.join(pairs.groupBy("shard_id").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "shard_id")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    a = pairs.join(asked, "qid").join(size, "shard_id").withColumn("block", F.pmod(F.xxhash64("qid"), F.col("blocks")).cast("int"))
    a = a.select("shard_id", "block", each("chunks").alias("chunk"), "qid", "vector")
    b = narrow.join(size, "shard_id").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int"))
    b = b.select("shard_id", each("blocks").alias("block"), "chunk", "doc_id", "vector")

    def pair(q: pa.Table, v: pa.Table) -> pa.Table:
        qa, qv = _matrix(q["vector"], dim)
        va, vv = _matrix(v["vector"], dim)
        shard = v["shard_id"].to_numpy()[va] if len(va) and len(qa) else np.empty(0, np.int32)
        return rows(_best(q["qid"].to_numpy()[qa], qv, v["doc_id"].to_numpy()[va], shard, vv, k))

    keys = ["shard_id", "block", "chunk"]
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(pair, HITS)


def score_shards(queries: DataFrame, centroids: list[tuple[int, list[float]]], dim: int, column: str = "vector", best: int = 0) -> DataFrame:
    """`queries` without `column`, with `shard_id`, `cscore` and `position`: the inner product with each shard's centroid, best first, ties to the lower shard.

    With `best` only that many shards of a query come out. Centroids, at most CENTROIDS, are broadcast; the caller groups shards beyond that.
    """
    if len(centroids) > CENTROIDS:
        raise ValueError(f"more than {CENTROIDS} centroids")
    order = sorted(centroids)
    shards = np.array([s for s, _ in order], np.int32)
    c = np.array([v for _, v in order], np.float64).reshape(len(order), dim)
    keys = [f for f in queries.schema.fields if f.name != column]
    held = queries.sparkSession.sparkContext.broadcast((shards, c))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, c = held.value
        most = min(best, len(shards)) if best else len(shards)
        for batch in batches:
            at, x = _matrix(batch.column(len(keys)), dim)
            if not len(at) or not most:
                continue
            exact = np.zeros((len(x), len(c)))
            for j in range(dim):
                exact += x[:, j, None] * c[None, :, j]
            by = np.argsort(-exact, axis=1, kind="stable")[:, :most]
            row = np.repeat(np.arange(len(at)), most)
            out = batch.select([f.name for f in keys]).take(pa.array(at[row]))
            position = np.tile(np.arange(1, most + 1, dtype=np.int32), len(at))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(shards[by].ravel()), pa.array(np.take_along_axis(exact, by, 1).ravel()), pa.array(position)], [*[f.name for f in keys], "shard_id", "cscore", "position"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys)
    return queries.select(*[f"`{f.name}`" for f in keys], column).mapInArrow(score, f"{schema}, shard_id int, cscore double, position int")


def merge_top_k(hits: DataFrame, k: int, id_order: Column | None = None) -> DataFrame:
    """The k best hits of each query over all its shards, with `rank`. Shards are disjoint, so nothing is counted twice."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.col("doc_id") if id_order is None else id_order)
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def per_shard_top_k(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits of each (query, shard), with `rank`."""
    order = Window.partitionBy("qid", "shard_id").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def plan_probes(scored: DataFrame, probe: int) -> DataFrame:
    """`scored`: (qid, shard_id, cscore); adds `position` and `probed`: the `probe` best shards, ties to the lower shard. 0 probes all."""
    order = Window.partitionBy("qid").orderBy(F.desc("cscore"), "shard_id")
    placed = scored.withColumn("position", F.row_number().over(order))
    return placed.withColumn("probed", F.lit(probe <= 0) | (F.col("position") <= probe))


def coverage(plan: DataFrame, healthy: DataFrame) -> DataFrame:
    """A row per query: how many shards were probed and answered, and which are missing or weren't probed, as sorted lists in text.

    healthy: (shard_id, answers). A probed shard without a healthy replica is missing, not an error.
    """
    told = plan.join(healthy, "shard_id", "left").withColumn("answers", F.coalesce("answers", F.lit(True)))
    listed = lambda c: F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.when(c, F.col("shard_id")))), lambda x: x.cast("string")))
    return told.groupBy("qid").agg(
        F.count_if("probed").alias("probed"), F.count_if(F.col("probed") & F.col("answers")).alias("answered"),
        listed(F.col("probed") & ~F.col("answers")).alias("missing_shards"), listed(~F.col("probed")).alias("unprobed_shards"),
    )


def recall_at_k(got: DataFrame, truth: DataFrame, k: int, by: list[str], settings: DataFrame | None = None, of_truth: bool = False) -> DataFrame:
    """Per group of `by`: found true neighbours over queries times k, also where a query has fewer than k; `of_truth` divides by the true neighbours instead.

    `settings`: all groups of `by`; one without any hit then has a row with 0. Without it only groups with a hit have rows.
    """
    real = truth.select("qid", "doc_id").distinct()
    both = got.select(*by, "qid", "doc_id").join(real.withColumn("_true", F.lit(1)), ["qid", "doc_id"], "left")
    found = both.groupBy(*by).agg(F.count("_true").alias("found"))
    if settings is not None:
        found = settings.select(*by).distinct().join(found, by, "left").withColumn("found", F.coalesce("found", F.lit(0)))
    n = real.agg(F.countDistinct("qid").alias("queries"), F.count(F.lit(1)).alias("pairs")).first()
    return found.withColumn("recall", F.round(F.col("found") / F.lit(max(1, n["pairs"] if of_truth else n["queries"] * k)), 9))


def probe_recall(hits: DataFrame, truth: DataFrame, k: int, probes: list[int], by: list[str] | None = None) -> DataFrame:
    """Recall of each number of probes (0: all), from hits of all shards with the `position` at which a query's plan has their shard."""
    by = by or []
    each = hits.withColumn("probe", F.explode(F.array(*[F.lit(p) for p in probes]))).where("probe = 0 OR position <= probe")
    keyed = each.withColumn("q", F.col("qid")).withColumn("qid", F.struct(*by, "probe", "q"))
    got = merge_top_k(keyed, k).select(*by, "probe", F.col("q").alias("qid"), "doc_id")
    settings = hits.select(*by).distinct() if by else hits.sparkSession.range(1).select()
    settings = settings.select(*by, F.explode(F.array(*[F.lit(p) for p in probes])).alias("probe"))
    return recall_at_k(got, truth, k, [*by, "probe"], settings)


def admitted(requests: DataFrame, k: int = 10, ef: int = 100) -> DataFrame:
    """`requests` (text, k, ef) with `status`: empty text is refused; k or ef of 0 stand for the defaults."""
    status = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "INVALID_ARGUMENT").otherwise("OK")
    default = lambda c, d: F.when(F.coalesce(c, F.lit(0)) == 0, d).otherwise(F.col(c))
    return requests.withColumn("status", status).withColumn("k", default("k", k)).withColumn("ef", default("ef", ef))


def guarded(requests: DataFrame, dim: int, order: list[str]) -> DataFrame:
    """`requests` (shard_id, state, k, dim, epoch) with `status` and `reason`, the guards of a shard in order: it has to serve, k to be above 0, the
    vector to have `dim` numbers, and the plan's epoch not to be below one that the shard has seen; it sees the epochs of requests that pass the other three."""
    from kestrelite.operators.ordered import sliced, with_running

    sound = (F.col("state") == "SERVING") & (F.col("k") != 0) & (F.col("dim") == dim)
    seen = with_running(sliced(requests, ["shard_id"], order), ["shard_id"], order, "_seen", F.when(sound, F.col("epoch")), "max")
    rules = [
        (F.col("state") != "SERVING", "FAILED_PRECONDITION", "shard not SERVING"), (F.col("k") == 0, "INVALID_ARGUMENT", "k must be > 0"),
        (F.col("dim") != dim, "INVALID_ARGUMENT", "vector dim mismatch"), (F.col("epoch") < F.col("_seen"), "FAILED_PRECONDITION", "stale shard map epoch"),
    ]
    status, reason = F.lit("OK"), F.lit(None).cast("string")
    for broken, code, why in reversed(rules):
        status, reason = F.when(broken, code).otherwise(status), F.when(broken, why).otherwise(reason)
    return seen.withColumn("status", status).withColumn("reason", reason).drop("_seen", "_slice")
