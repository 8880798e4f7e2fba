"""The k most similar vectors of every vector, by balanced posting lists.

Fit (bounded): at most `sample_rows` vectors, taken by hash of the id, are cut into equal halves again and again (two centres, median of the
projection between them) until a leaf stands for `list_size` vectors of the whole table; a few Lloyd steps follow. The centroids, at most
`sample_rows / 32` of them, are all that is broadcast. They form an in-memory graph: entry nodes, each linked to its nearest centroids, and
the centroids linked to theirs; a search walks from the best entry node to the best neighbour until nothing is better.

Index (every vector): a vector is stored in the list of its nearest centroid and, as boundary vector, in up to `replicas` lists whose
centroid is at most `1 + ratio` times as far. A query reads the lists within `1 + probe_ratio` times the nearest, at most `probes` of them.
Lists are balanced on the whole table too: one that comes out longer than `split` rows, by skew or because there are more rows than the bounded
fit has lists for, gets a second level of centroids, fitted in a task of its own on at most `SUB_ROWS` of its rows. Its vectors are stored in, and
its queries read, the second-level lists by the same rule; only where a list is the nearest one are boundary vectors replicated again.
One list is one task's dense product. A list of more than `cell` rows is cut into chunks, and each pair of chunks is a task of its own.

Defined results
  * Only vectors of `dim` finite values that are not all zero take part; a null id is left out.
  * Similarity is the inner product of the vectors scaled to length 1, as double. Ties go to the smaller id.
  * An id inserted with several vectors counts with the one whose bytes are smallest. A vector isn't its own neighbour.
  * Of one and the same vector only the k + 1 smallest ids are stored, as by the tie rule no query can have others; the rest get those.
  * Fewer than k other vectors give fewer neighbours; an empty table gives an empty result. Other columns, of any name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrelite.scratch import materialize


def usable_vectors(rows: DataFrame, id_column: str, vector_column: str, dim: int) -> DataFrame:
    """(doc_id, vec): one row per id with a usable vector, as `dim` 4-byte floats."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            length = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            right = pa.array((length == dim) & ids.is_valid().to_numpy(zero_copy_only=False))
            ids, vectors = ids.filter(right), vectors.filter(right)
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)  # a null element becomes NaN
            with np.errstate(over="ignore"):
                norm = np.square(flat.astype(np.float64)).sum(1)
            ok = np.isfinite(norm) & (norm > 0)
            flat = np.ascontiguousarray(flat[ok])
            data = pa.Array.from_buffers(pa.binary(dim * 4), len(flat), [None, pa.py_buffer(flat)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(ok)).cast(pa.int64()), data], ["doc_id", "vec"])

    narrow = rows.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{vector_column}`").cast("array<float>").alias("vec"))
    return narrow.mapInArrow(clean, "doc_id long, vec binary").groupBy("doc_id").agg(F.min("vec").alias("vec"))


def unpack(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty((0, dim), np.float32)
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    return np.frombuffer(column.buffers()[2], np.float32, len(column) * dim, int(offsets[0])).reshape(-1, dim)


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    return v / np.sqrt(np.square(v).sum(1))[:, None]


#: Copies of a vector that go to one task.
COPIES = 100_000
#: Rows that a second level is fitted on, at most, and how many lists it can have.
SUB_ROWS, SUBLISTS = 65_536, 1 << 20


@dataclass
class Lists:
    """The centroids and their graph."""

    centroids: np.ndarray
    links: np.ndarray
    entries: np.ndarray
    entry_links: np.ndarray

    def search(self, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(lists, distances), nearest first, up to `most` of them: a walk in the graph from the best entry node."""
        at = self.entries[(x @ self.centroids[self.entries].T).argmax(1)]
        todo, links = np.arange(len(x)), None
        for step in range(8):
            neighbours = self.entry_links if step == 0 else self.links
            better = at.copy()
            order = np.argsort(at[todo], kind="stable")
            here = at[todo][order]
            cut = np.concatenate([[0], np.flatnonzero(np.diff(here)) + 1, [len(here)]])
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                who, to = todo[order[lo:hi]], neighbours[here[lo]]
                better[who] = to[(x[who] @ self.centroids[to].T).argmax(1)]
            todo = np.flatnonzero(better != at) if step else np.arange(len(x))
            at = better
            if step and not len(todo):
                break
        links = self.links
        most = min(most, links.shape[1])
        lists, distances = np.empty((len(x), most), np.int32), np.empty((len(x), most), np.float32)
        order = np.argsort(at, kind="stable")
        cut = np.concatenate([[0], np.flatnonzero(np.diff(at[order])) + 1, [len(at)]])
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            if lo == hi:
                continue
            who = order[lo:hi]
            to = links[at[who[0]]]
            s = x[who] @ self.centroids[to].T
            best = np.argsort(-s, axis=1, kind="stable")[:, :most]
            lists[who] = to[best]
            distances[who] = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(s, best, 1)))
        return lists, distances


def centroids_of(x: np.ndarray, want: int, dim: int) -> np.ndarray:
    """`want` centroids of the rows of x: equal halves again and again, then a few Lloyd steps."""
    random = np.random.default_rng(0)
    groups = [np.arange(len(x))]
    while len(groups) < want:
        groups.sort(key=len)
        g = groups.pop()
        y = x[g]
        c = y[random.choice(len(y), 2, replace=False)]
        for _ in range(3):
            near = (y @ c.T).argmax(1)
            c = np.stack([y[near == k].mean(0) if (near == k).any() else c[k] for k in (0, 1)])
        by = np.argsort(y @ (c[0] - c[1]), kind="stable")
        groups += [g[by[: len(g) // 2]], g[by[len(g) // 2 :]]]
    c = np.stack([x[g].mean(0) for g in groups]) if len(x) else np.zeros((1, dim), np.float32)
    for step in range(4):
        c = c / np.maximum(np.linalg.norm(c, axis=1), 1e-12)[:, None]
        if step < 3 and len(x):
            near = np.concatenate([(x[i : i + 8192] @ c.T).argmax(1) for i in range(0, len(x), 8192)])
            total, n = np.zeros_like(c), np.bincount(near, minlength=len(c))
            order = np.argsort(near, kind="stable")
            filled = np.flatnonzero(n)
            total[filled] = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(n[filled])[:-1]]))
            c = np.where(n[:, None] > 0, total, c)
    return np.ascontiguousarray(c, np.float32)


def fit_lists(vectors: DataFrame, dim: int, rows: int, list_size: int, sample_rows: int, degree: int = 128) -> Lists:
    """The lists of `vectors`, from a sample of at most about `sample_rows` of its `rows` rows, the same in every run."""
    sample = vectors
    if rows > sample_rows:
        sample = vectors.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * sample_rows / rows))
    found = sample.toArrow()
    found = found.take(np.argsort(found["doc_id"].to_numpy(), kind="stable"))
    x = unit(unpack(found["vec"], dim)).astype(np.float32)
    c = centroids_of(x, max(1, min(-(-rows // list_size), max(1, len(x) // 32))), dim)
    random = np.random.default_rng(1)
    near = np.argsort(-(c @ c.T), axis=1, kind="stable")[:, : min(degree, len(c))].astype(np.int32)
    entries = np.sort(random.choice(len(c), max(1, int(np.sqrt(len(c)))), replace=False))
    return Lists(c, near, entries, near)


def _assigned(vectors: DataFrame, lists, dim: int, replicas: int, ratio: float, probes: int, probe_ratio: float, queries: str | None) -> DataFrame:
    """(list, home, posted, asks, doc_id, vec): a row for each list that stores the vector or that its query reads; `home`: the nearest list."""
    narrow = vectors.select("doc_id", "vec", (F.expr(queries) if queries else F.lit(True)).alias("asks"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(unpack(batch.column(1), dim)).astype(np.float32)
            asks = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            to, far = lists.value.search(x, max(replicas, probes))
            rank = np.arange(to.shape[1])[None]
            post = (rank < replicas) & (far <= (1 + ratio) * far[:, :1] + 1e-6)
            read = (rank < probes) & (far <= (1 + probe_ratio) * far[:, :1] + 1e-6) & asks[:, None]
            row, k = np.nonzero(post | read)
            taken = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(to[row, k]), pa.array(k == 0), pa.array(post[row, k]), pa.array(read[row, k]), taken.column(0), taken.column(1)], ["list", "home", "posted", "asks", "doc_id", "vec"])

    return narrow.mapInArrow(spread, "list int, home boolean, posted boolean, asks boolean, doc_id long, vec binary")


def split_lists(assigned: DataFrame, dim: int, list_size: int, split: int, cell: int, replicas: int, ratio: float, probes: int, probe_ratio: float) -> tuple[DataFrame, DataFrame]:
    """((list, posted, asks, doc_id, vec), (list, n)): lists of more than `split` stored rows are replaced by second-level lists of their own; n: the chunks of each."""
    columns = ["list", "posted", "asks", "doc_id", "vec"]
    wide = assigned.withColumn("list", F.col("list").cast("long") * SUBLISTS)
    counts = materialize(assigned.groupBy("list").agg(F.count_if("posted").alias("n"), F.count(F.lit(1)).alias("all")), "knn-lists")  # a row a list
    large = counts.where(F.col("n") > split).select("list", "n")
    if not large.limit(1).count():
        return wide.select(columns), counts.select((F.col("list").cast("long") * SUBLISTS).alias("list"), F.ceil(F.col("all") / cell).cast("int").alias("n"))
    held = materialize(assigned.join(F.broadcast(large), "list"), "knn-split")
    part = F.lit(float(1 << 20)) * SUB_ROWS / F.col("n")
    sample = held.where("posted").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < part).select("list", "n", "doc_id", "vec")

    def fit(table: pa.Table) -> pa.Table:
        table = table.take(np.argsort(table["doc_id"].to_numpy(), kind="stable"))
        x = unit(unpack(table["vec"], dim)).astype(np.float32)
        c = centroids_of(x, max(1, min(-(-table["n"][0].as_py() // list_size), len(x) // 32, SUBLISTS - 1)), dim)
        return pa.table({"list": table["list"][:1], "centroids": pa.array([c.tobytes()], pa.binary())})

    fitted = materialize(sample.groupBy("list").applyInArrow(fit, "list int, centroids binary"), "knn-sublists")
    # Rows of a list in chunks, and its centroids, 2,048 at most of a usual dimension, once a chunk.
    chunks = F.ceil(F.col("n") / split).cast("int")
    rows = held.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), chunks).cast("int")).select("list", "chunk", "home", "posted", "asks", "doc_id", "vec")
    each = fitted.join(large, "list").select("list", "centroids", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))

    def place(rows: pa.Table, fitted: pa.Table) -> pa.Table:
        c = np.frombuffer(fitted["centroids"][0].as_py(), np.float32).reshape(-1, dim) if fitted.num_rows else np.empty((0, dim), np.float32)
        out: list[tuple] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool), np.empty(0, bool))]
        home, posted, asks = (rows[name].to_numpy(zero_copy_only=False).astype(bool) for name in ("home", "posted", "asks"))
        x, most = unit(unpack(rows["vec"], dim)).astype(np.float32), min(len(c), max(replicas, probes))
        for lo in range(0, len(x) if most else 0, 4096):
            s = x[lo : lo + 4096] @ c.T
            to = np.argsort(-s, axis=1, kind="stable")[:, :most]
            far = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(s, to, 1)))
            rank, of = np.arange(most)[None], slice(lo, lo + 4096)
            post = posted[of, None] & (rank < np.where(home[of], replicas, 1)[:, None]) & (far <= (1 + ratio) * far[:, :1] + 1e-6)
            read = asks[of, None] & (rank < max(probes, 1)) & (far <= (1 + probe_ratio) * far[:, :1] + 1e-6)
            row, k = np.nonzero(post | read)
            out.append((lo + row, to[row, k], post[row, k], read[row, k]))
        row, sub, post, read = (np.concatenate([o[i] for o in out]) for i in range(4))
        taken = rows.take(pa.array(row))
        name = np.zeros(len(row), np.int64) if not rows.num_rows else np.full(len(row), rows["list"][0].as_py(), np.int64) * SUBLISTS + 1 + sub
        return pa.table({"list": pa.array(name), "posted": pa.array(post), "asks": pa.array(read), "doc_id": taken["doc_id"], "vec": taken["vec"]})

    parts = rows.groupBy("list", "chunk").cogroup(each.groupBy("list", "chunk")).applyInArrow(place, "list long, posted boolean, asks boolean, doc_id long, vec binary")
    rest = wide.join(F.broadcast(large.select((F.col("list").cast("long") * SUBLISTS).alias("list"))), "list", "left_anti")
    whole = rest.select(columns).union(parts.select(columns))
    return whole, materialize(list_chunks(whole, cell), "knn-chunks")


def parts_of(rows: int, spark, size: int = 16_384) -> int:
    """Partitions for so many rows of vectors, so that what a task reads doesn't grow with the table."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // size))


def list_chunks(assigned: DataFrame, cell: int) -> DataFrame:
    """(list, n): chunks of each list."""
    return assigned.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / cell).cast("int").alias("n"))


def cells(assigned: DataFrame, chunks: DataFrame) -> DataFrame:
    """`assigned` with `p` and `q`: a list of one chunk is one cell; of a longer one each pair of chunks is a cell.

    Lists of the first level are at most as many as its centroids; where there are second levels the join is left to the planner.
    """
    cut = assigned.join(chunks, "list").withColumn("h", F.pmod(F.xxhash64("doc_id"), F.col("n")).cast("int"))
    whole = cut.where("n = 1").select("list", F.lit(0).alias("p"), F.lit(0).alias("q"), "posted", "asks", "doc_id", "vec")
    parts = cut.where("n > 1").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    stored = parts.where("posted").select("list", F.col("h").alias("p"), F.col("o").alias("q"), F.lit(True).alias("posted"), (F.col("asks") & (F.col("h") == F.col("o"))).alias("asks"), "doc_id", "vec")
    asking = parts.where("asks AND NOT (posted AND h = o)").select("list", F.col("o").alias("p"), F.col("h").alias("q"), F.lit(False).alias("posted"), F.lit(True).alias("asks"), "doc_id", "vec")
    return whole.union(stored).union(asking)


def _nearest_in_cell(dim: int, k: int, least: float | None):
    def run(table: pa.Table) -> pa.Table:
        ids, posted, asks = (table[c].to_numpy() for c in ("doc_id", "posted", "asks"))
        x = unit(unpack(table["vec"], dim))
        x32, pid = x[posted].astype(np.float32), ids[posted]
        by = np.argsort(pid, kind="stable")  # ties then come in order of id
        x32, pid, x64 = x32[by], pid[by], x[posted][by]
        qid, y64 = ids[asks], x[asks]
        y32, a, b, s = y64.astype(np.float32), [], [], []
        for lo in range(0, len(qid) if len(pid) else 0, 1024):
            sim = y32[lo : lo + 1024] @ x32.T
            sim[qid[lo : lo + 1024, None] == pid[None]] = -9
            if least is not None:
                row, col = np.nonzero(sim >= least - 1e-4)
            else:
                n = min(k + 4, sim.shape[1])
                col = np.argpartition(-sim, n - 1, axis=1)[:, :n]
                last = np.take_along_axis(sim, col, 1).min(1)
                row, col = np.nonzero(sim >= last[:, None])  # with all that tie with the last
            exact = np.einsum("ij,ij->i", y64[lo + row], x64[col])
            good = (sim[row, col] > -5) & ((exact >= least) if least is not None else True)
            row, col, exact = row[good], col[good], exact[good]
            order = np.lexsort((col, -exact, row))
            row, col, exact = row[order], col[order], exact[order]
            first = np.searchsorted(row, row)
            top = np.arange(len(row)) - first < k
            a.append(qid[lo + row[top]])
            b.append(pid[col[top]])
            s.append(exact[top])
        cat = lambda v, t: np.concatenate(v) if v else np.empty(0, t)
        return pa.table({"doc_id": pa.array(cat(a, np.int64), pa.int64()), "neighbour": pa.array(cat(b, np.int64), pa.int64()), "similarity": pa.array(cat(s, np.float64), pa.float64())})

    return run


def nearest_neighbours(
    rows: DataFrame, id_column: str, vector_column: str, k: int = 10, dim: int = 64, queries: str | None = None, least: float | None = None,
    list_size: int = 1000, sample_rows: int = 65_536, replicas: int = 2, ratio: float = 0.1, probes: int | None = None, probe_ratio: float | None = None, cell: int = 8192, split: int = 16_384,
) -> DataFrame:
    """(doc_id, neighbour, similarity, rank) of the `k` most similar other vectors.

    `queries`: SQL condition on doc_id that says which vectors ask (all by default); all are searched. `least`: only neighbours of at least
    that similarity, a bound that is applied inside each list. `probes`, `probe_ratio`: what a query reads, by default where it is stored.
    """
    spark = rows.sparkSession
    vectors = materialize(usable_vectors(rows, id_column, vector_column, dim), "knn-vectors")
    n = vectors.count()
    same = vectors.groupBy(F.xxhash64("vec").alias("h")).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > k + 1)
    stored, extra = vectors, None
    if same.limit(1).count():  # groups of copies: by a narrow window whose partial limit keeps k + 1 rows a task
        # A group of many copies is spread by salt, as many as it has COPIES rows.
        hashed = vectors.withColumn("h", F.xxhash64("vec")).join(same, "h").select("doc_id", "vec", F.ceil(F.col("copies") / COPIES).cast("int").alias("salts"))
        copy = Window.partitionBy("vec").orderBy("doc_id")
        first = materialize(hashed.withColumn("r", F.row_number().over(copy)).where(F.col("r") <= k + 1), "knn-copies")
        late = hashed.join(first.select("doc_id"), "doc_id", "left_anti")
        stored = vectors.join(late.select("doc_id"), "doc_id", "left_anti")
        asking = (late.where(queries) if queries else late).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int"))
        salted = first.where(F.col("r") <= k).select("vec", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("doc_id").alias("neighbour"), "r")
        extra = asking.join(salted, ["vec", "salt"]).select("doc_id", "neighbour", F.lit(1.0).alias("similarity"), F.col("r").alias("rank"))
    lists = spark.sparkContext.broadcast(fit_lists(stored, dim, n if extra is None else stored.count(), list_size, sample_rows))
    reads = (probes or replicas, ratio if probe_ratio is None else probe_ratio)
    spread, chunks = split_lists(_assigned(stored, lists, dim, replicas, ratio, *reads, queries), dim, list_size, split, cell, replicas, ratio, *reads)
    spread = cells(spread, chunks).repartition(parts_of(n * replicas, spark), "list", "p", "q")
    found = spread.groupBy("list", "p", "q").applyInArrow(_nearest_in_cell(dim, k, least), "doc_id long, neighbour long, similarity double")
    found = found.groupBy("doc_id", "neighbour").agg(F.max("similarity").alias("similarity"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("similarity"), "neighbour")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.union(extra) if extra is not None else ranked
