"""Layered navigable graphs over the vectors of a shard: build, search with traces, statistics, projections.

A shard has a bounded number of vectors, and its graph is built and walked in one task; shards are independent, so a larger corpus has more shards.
Rows of a shard are its vectors in order of id. A row's top layer comes from a hash of (seed, row), so a graph is the same in every run and whatever
the order in which vectors arrive. Distances are 1 - inner product in single precision, evaluated for all unseen neighbours of a node at once.

Defined results: vectors of another length, and null ones, aren't indexed; an empty shard has no graph and no hits; k beyond the rows gives all
that the walk reaches; ties go to the smaller row in the walk and to the smaller id in the result.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelite.operators.search import BLOCK, Route, _matrix, bounded_probes, of_shards

#: Kinds of trace records.
ENTRY, VISIT, ACCEPT, RESULT = 0, 1, 2, 4
TOP_LAYER = 15


def top_layer(seed: int, row: int, m: int) -> int:
    import xxhash

    u = (xxhash.xxh3_64_intdigest(f"{seed}|{row}".encode()) + 1) / (2**64 + 1)
    return min(TOP_LAYER, int(-math.log(u) / math.log(m)))


@dataclass
class Graph:
    vectors: np.ndarray
    m: int = 16
    layers: list[dict[int, np.ndarray]] = field(default_factory=list)
    level: list[int] = field(default_factory=list)
    entry: int = -1

    def far(self, query: np.ndarray, rows) -> np.ndarray:
        return np.float32(1) - self.vectors[rows] @ query

    def descend(self, query: np.ndarray, at: int, d: float, layer: int, trace: list | None) -> tuple[int, float]:
        """The local nearest row of a layer."""
        while True:
            near = self.layers[layer].get(at)
            if near is None or not len(near):
                return at, d
            dist = self.far(query, near)
            if trace is not None:
                trace += [(layer, VISIT, int(r), at, float(x)) for r, x in zip(near, dist, strict=True)]
            best = min(zip(dist.tolist(), near.tolist(), strict=True))
            if best >= (d, at):
                return at, d
            d, at = best

    def beam(self, query: np.ndarray, starts: list[tuple[float, int]], ef: int, layer: int, trace: list | None = None) -> list[tuple[float, int]]:
        """The `ef` nearest rows that a best-first walk finds, nearest first."""
        seen = np.zeros(len(self.vectors), bool)
        seen[[r for _, r in starts]] = True
        todo, kept = list(starts), [(-d, -r) for d, r in starts]
        heapq.heapify(todo)
        heapq.heapify(kept)
        links = self.layers[layer]
        while todo:
            d, at = heapq.heappop(todo)
            if len(kept) >= ef and d > -kept[0][0]:
                break
            near = links.get(at)
            if near is None:
                continue
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            dist = self.far(query, near)
            if trace is not None:
                trace += [(layer, VISIT, int(r), at, float(x)) for r, x in zip(near, dist, strict=True)]
            if len(kept) >= ef:
                ok = dist <= -kept[0][0]
                near, dist = near[ok], dist[ok]
            for x, r in zip(dist.tolist(), near.tolist(), strict=True):
                if len(kept) < ef or (x, r) < (-kept[0][0], -kept[0][1]):
                    if trace is not None:
                        trace.append((layer, ACCEPT, r, at, x))
                    heapq.heappush(todo, (x, r))
                    heapq.heappush(kept, (-x, -r))
                    if len(kept) > ef:
                        heapq.heappop(kept)
        return sorted((-d, -r) for d, r in kept)

    def diverse(self, near: list[tuple[float, int]], most: int) -> list[int]:
        """Up to `most` links: first rows that are nearer to the node than to any link so far, then the nearest of the others."""
        if len(near) <= 1:
            return [r for _, r in near][:most]
        rows = np.array([r for _, r in near])
        own = np.array([d for d, _ in near], np.float32)
        v = self.vectors[rows]
        apart = np.float32(1) - v @ v.T
        free, nearest = np.ones(len(rows), bool), np.full(len(rows), np.inf, np.float32)
        chosen: list[int] = []
        while len(chosen) < most:
            may = np.flatnonzero(free & (own < nearest))
            if not len(may):
                break
            i = int(may[0])
            # A row that was passed over isn't looked at again, as links only come nearer.
            free[: i + 1] = False
            chosen.append(i)
            np.minimum(nearest, apart[i], out=nearest)
        if len(chosen) < most:
            rest = np.setdiff1d(np.arange(len(rows)), chosen, assume_unique=True)
            chosen += rest[: most - len(chosen)].tolist()
        return rows[chosen].tolist()

    def most(self, layer: int) -> int:
        return self.m * 2 if layer == 0 else self.m

    def add(self, row: int, level: int, ef: int) -> None:
        self.level.append(level)
        while len(self.layers) <= level:
            self.layers.append({})
        if self.entry < 0:
            for layer in range(level + 1):
                self.layers[layer][row] = np.empty(0, np.int64)
            self.entry = row
            return
        q = self.vectors[row]
        at, d = self.entry, float(self.far(q, [self.entry])[0])
        top = self.level[self.entry]
        for layer in range(top, level, -1):
            at, d = self.descend(q, at, d, layer, None)
        starts = [(d, at)]
        for layer in range(min(top, level), -1, -1):
            starts = self.beam(q, starts, ef, layer)
            links = self.diverse(starts, self.m)
            self.layers[layer][row] = np.array(links, np.int64)
            for other in links:
                back = np.append(self.layers[layer][other], row)
                if len(back) > self.most(layer):
                    dist = self.far(self.vectors[other], back)
                    back = np.array(self.diverse(sorted(zip(dist.tolist(), back.tolist(), strict=True)), self.most(layer)), np.int64)
                self.layers[layer][other] = back
        for layer in range(top + 1, level + 1):
            self.layers[layer][row] = np.empty(0, np.int64)
        if level > top:
            self.entry = row

    def seal(self) -> None:
        """Links sorted by (distance, row)."""
        for links in self.layers:
            for row, near in links.items():
                links[row] = near[np.lexsort((near, self.far(self.vectors[row], near)))]

    def search(self, query: np.ndarray, k: int, ef: int, trace: list | None = None) -> list[tuple[float, int]]:
        if self.entry < 0:
            return []
        top = self.level[self.entry]
        at, d = self.entry, float(self.far(query, [self.entry])[0])
        if trace is not None:
            trace.append((top, ENTRY, at, at, d))
        for layer in range(top, 0, -1):
            at, d = self.descend(query, at, d, layer, trace)
        found = self.beam(query, [(d, at)], max(ef, k), 0, trace)[:k]
        if trace is not None:
            trace += [(0, RESULT, r, r, x) for x, r in found]
        return found


def build(vectors: np.ndarray, m: int = 16, ef: int = 100, seed: int = 0) -> Graph:
    g = Graph(np.ascontiguousarray(vectors, np.float32), m)
    for row in range(len(vectors)):
        g.add(row, top_layer(seed, row, m), ef)
    g.seal()
    return g


EDGES = "shard_id int, layer int, row int, doc_id long, neighbours array<int>"


def _ordered(table: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray]:
    at, v = _matrix(table["vector"], dim)
    ids = table["doc_id"].to_numpy()[at]
    order = np.argsort(ids, kind="stable")
    return ids[order], v[order]


def replica_seed(seed: int, shard: int, replica: str) -> int:
    """A seed of its own for each replica of a shard; that of the shard alone for the unnamed one."""
    import xxhash

    return (seed + shard) ^ (xxhash.xxh3_64_intdigest(replica) if replica else 0)


def build_graphs(vectors: DataFrame, dim: int, m: int = 16, ef: int = 100, seed: int = 0, replica: str = "") -> DataFrame:
    """The edge lists of all shards of (doc_id, shard_id, vector), as the named replica of each builds them."""

    def run(table: pa.Table) -> pa.Table:
        shard = int(table["shard_id"][0].as_py())
        ids, v = _ordered(table, dim)
        g = build(v, m, ef, replica_seed(seed, shard, replica))
        rows = [(shard, layer, row, int(ids[row]), near.tolist()) for layer, links in enumerate(g.layers) for row, near in sorted(links.items())]
        c = list(zip(*rows, strict=True)) if rows else [[]] * 5
        return pa.table({"shard_id": pa.array(c[0], pa.int32()), "layer": pa.array(c[1], pa.int32()), "row": pa.array(c[2], pa.int32()), "doc_id": pa.array(c[3], pa.int64()), "neighbours": pa.array(c[4], pa.list_(pa.int32()))})

    return vectors.groupBy("shard_id").applyInArrow(run, EDGES)


def check_graph(edges: DataFrame, vectors: DataFrame | None = None, dim: int = 0, m: int = 0) -> None:
    """An error if a link leads to a row that its layer doesn't have; with `vectors`, if a shard's bottom layer hasn't exactly its rows, or one has another
    length than `dim`; with `m`, if a row has more links than its layer allows."""
    links = edges.select("shard_id", "layer", F.explode("neighbours").alias("row")).distinct()
    lost = links.join(edges.select("shard_id", "layer", "row"), ["shard_id", "layer", "row"], "left_anti").take(1)
    if lost:
        raise ValueError(f"shard {lost[0]['shard_id']}: layer {lost[0]['layer']} links to row {lost[0]['row']}, which it doesn't have")
    if m:
        full = edges.where(F.size("neighbours") > F.when(F.col("layer") == 0, 2 * m).otherwise(m)).take(1)
        if full:
            raise ValueError(f"shard {full[0]['shard_id']}: row {full[0]['row']} has too many links in layer {full[0]['layer']}")
    if vectors is not None:
        wrong = vectors.where(F.size("vector") != dim).take(1) if dim else []
        if wrong:
            raise ValueError(f"shard {wrong[0]['shard_id']}: a vector has another length than {dim}")
        have = edges.where("layer = 0").select("shard_id", "doc_id", F.lit(1).alias("indexed"))
        apart = vectors.select("shard_id", "doc_id", F.lit(1).alias("stored")).join(have, ["shard_id", "doc_id"], "full_outer").where("indexed IS NULL OR stored IS NULL").take(1)
        if apart:
            raise ValueError(f"shard {apart[0]['shard_id']}: the graph and the vectors disagree on id {apart[0]['doc_id']}")


def _restore(vectors: np.ndarray, edges: pa.Table, m: int) -> Graph:
    g = Graph(np.ascontiguousarray(vectors, np.float32), m)
    level = np.zeros(len(vectors), np.int64)
    for layer, row, near in zip(edges["layer"].to_pylist(), edges["row"].to_pylist(), edges["neighbours"].to_pylist(), strict=True):
        while len(g.layers) <= layer:
            g.layers.append({})
        g.layers[layer][row] = np.array(near, np.int64)
        level[row] = max(level[row], layer)
    g.level = level.tolist()
    if len(vectors):  # the first row that reached the top layer
        g.entry = int(np.flatnonzero(level == level.max())[0])
    return g


TRACED = "qid long, shard_id int, doc_id long, score double, rank int, visited int, ef int, us long, node array<int>, parent array<int>, dist array<float>, offset array<int>, meta array<int>, dropped int"
_KINDS = (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32())
_NAMES = [c.split()[0] for c in TRACED.split(", ")]


def search_graphs(
    vectors: DataFrame, edges: DataFrame, queries: list[tuple[int, list[float]]] | DataFrame, dim: int, k: int = 10, ef: int | list[int] = 100, m: int = 16,
    traced: bool = False, plan: DataFrame | Route | None = None, cap: int = 0,
) -> DataFrame:
    """The k hits of each query in each shard; `visited` counts distances evaluated, `us` is how long the walk took.

    `queries`: (qid, vector), of any number, or a list that is one bounded block. More than BLOCK are cut into blocks by hash, and each shard's
    graph meets each block in one task; a walk is the same either way. `plan`: (qid, shard_id), the shards that a query probes (all without it);
    of tables partitioned by shard only the probed ones are read. `ef`: one beam, or several that are walked one after another.

    With `traced`, the first hit of each (query, shard) carries the walk: node, parent, distance, offset and packed layer and kind of each record, of
    which a walk keeps the first `cap` (all if 0) and counts the others in `dropped`. The walk itself is the same with and without.
    """
    spark = vectors.sparkSession
    beams = [ef] if isinstance(ef, int) else list(ef)
    one, probes = True, None
    if isinstance(queries, DataFrame):
        asked = queries.select(F.col("qid").cast("long"), F.col("vector").cast("array<double>").alias("vector"))
        table = asked.limit(BLOCK + 1).toArrow()  # never more than one block comes to the driver
        one = table.num_rows <= BLOCK
        if one:
            at, q = _matrix(table["vector"], dim)
            qids = table["qid"].to_numpy()[at].tolist()
            one, probes = bounded_probes(plan, qids, q)
            held = spark.sparkContext.broadcast((qids, q, probes))
    else:
        held = spark.sparkContext.broadcast(([q for q, _ in queries], np.array([v for _, v in queries], np.float64).reshape(len(queries), dim), None))

    def walk(v: pa.Table, e: pa.Table, qids: list[int], qs: np.ndarray, probes: dict | None) -> pa.Table:
        import time

        ids, x = _ordered(v, dim)
        g = _restore(x, e, m)
        shard = int(v["shard_id"][0].as_py()) if v.num_rows else -1
        who = range(len(qids)) if probes is None else probes.get(shard, np.empty(0, np.int64)).tolist()
        out: list[tuple] = []
        for i in who:
            qid, q = qids[i], qs[i]
            for beam in beams:
                trace: list = []
                t = time.perf_counter_ns()
                hits = g.search(q.astype(np.float32), k, beam, trace)
                us = (time.perf_counter_ns() - t) // 1000
                visited = 1 + sum(1 for r in trace if r[1] == VISIT)
                scored = sorted((-float(x[r] @ q), int(ids[r])) for _, r in hits)
                for rank, (s, doc) in enumerate(scored, 1):
                    kept = (trace[:cap] if cap else trace) if traced and rank == 1 else []
                    dropped = len(trace) - len(kept) if traced and rank == 1 else 0
                    # Records carry their place in the walk's time by their order: a clock of its own would make no two runs alike.
                    offsets = [us * n // max(1, len(trace)) for n in range(len(kept))]
                    out.append((qid, shard, doc, -s, rank, visited, beam, us, [r[2] for r in kept], [r[3] for r in kept], [r[4] for r in kept], offsets, [((r[0] & 15) << 3) | r[1] for r in kept], dropped))
        c = list(zip(*out, strict=True)) if out else [[]] * len(_NAMES)
        return pa.table({n: pa.array(x, t) for n, x, t in zip(_NAMES, c, _KINDS, strict=True)})

    if one:
        v, e = of_shards(vectors.select("shard_id", "doc_id", "vector"), probes), of_shards(edges, probes)
        return v.groupBy("shard_id").cogroup(e.groupBy("shard_id")).applyInArrow(lambda v, e: walk(v, e, *held.value), TRACED)
    blocks = -(-asked.count() // BLOCK)
    # Vectors and edges of a shard come as one side; what has a layer is an edge list.
    both = vectors.select("shard_id", "doc_id", "vector").unionByName(edges.select("shard_id", "layer", "row", "neighbours"), allowMissingColumns=True)
    graph = both.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    if isinstance(plan, Route):
        plan = plan.frame(asked, dim)
    if plan is None:
        plan = asked.select("qid").join(vectors.select("shard_id").distinct(), how="cross")  # a query set against all shards
    else:
        graph = graph.join(plan.select("shard_id").distinct(), "shard_id", "left_semi")
    pairs = plan.select(F.col("qid").cast("long"), F.col("shard_id").cast("int")).distinct()
    sent = asked.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")).join(pairs, "qid").select("shard_id", "block", "qid", "vector")

    def pair(g: pa.Table, q: pa.Table) -> pa.Table:
        at, qs = _matrix(q["vector"], dim)
        g = g if len(at) else g.slice(0, 0)  # no query of this block probes the shard
        edge = pc.is_valid(g["layer"])
        return walk(g.filter(pc.invert(edge)), g.filter(edge), q["qid"].to_numpy()[at].tolist(), qs, None)

    return graph.groupBy("shard_id", "block").cogroup(sent.groupBy("shard_id", "block")).applyInArrow(pair, TRACED)


def hops(traced: DataFrame) -> DataFrame:
    """(qid, shard_id, hop, node, parent, dist, offset, layer, kind): walks, a row per record."""
    z = traced.where(F.size("node") > 0).select("qid", "shard_id", F.posexplode(F.arrays_zip("node", "parent", "dist", "offset", "meta")).alias("hop", "r"))
    return z.select("qid", "shard_id", "hop", "r.node", "r.parent", "r.dist", "r.offset", F.shiftright("r.meta", 3).bitwiseAND(F.lit(15)).alias("layer"), F.col("r.meta").bitwiseAND(F.lit(7)).alias("kind"))


def projections(vectors: DataFrame, dim: int, method: str = "pca", seed: int = 0) -> DataFrame:
    """(shard_id, row, doc_id, x, y) by `method`: `umap` where that package is installed, else and by default two principal axes of each shard, signs such that the largest loading is positive, each scaled to at most 1."""

    def run(table: pa.Table) -> pa.Table:
        shard = int(table["shard_id"][0].as_py())
        ids, v = _ordered(table, dim)
        xy = np.zeros((len(v), 2))
        reducer = None
        if method == "umap" and len(v) > 15:
            try:
                from umap import UMAP

                reducer = UMAP(n_neighbors=15, min_dist=0.1, metric="cosine", random_state=seed ^ shard)
            except ImportError:
                pass
        if reducer is not None:
            p = reducer.fit_transform(v)
            p = p - p.mean(0)
            xy = p / np.maximum(np.abs(p).max(0), 1e-12)
        elif len(v):
            _, _, axes = np.linalg.svd(v - v.mean(0), full_matrices=False)
            axes = axes[:2]
            axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
            p = (v - v.mean(0)) @ axes.T
            most = np.abs(p).max(0)
            xy[:, : p.shape[1]] = p / np.where(most > 0, most, 1)
        return pa.table({"shard_id": pa.array([shard] * len(v), pa.int32()), "row": pa.array(range(len(v)), pa.int32()), "doc_id": pa.array(ids, pa.int64()), "x": pa.array(xy[:, 0], pa.float32()), "y": pa.array(xy[:, 1], pa.float32())})

    return vectors.groupBy("shard_id").applyInArrow(run, "shard_id int, row int, doc_id long, x float, y float")


#: Scale of a projection, height of a layer, colour (red, green, blue) by kind of record, that of a visit for others.
SCALE, HEIGHT = 6.0, 2.6
COLOURS = {0: (1.0, 0.82, 0.35), 1: (0.35, 0.5, 0.7), 2: (0.6, 0.91, 1.0), 3: (0.4, 0.4, 0.45), 4: (1.0, 1.0, 1.0)}


def inspector_buffers(hop_rows: DataFrame, projected: DataFrame) -> DataFrame:
    """Positions of each hop and of its parent; rows without a projection lie at the origin."""
    p = projected.select("shard_id", F.col("row").alias("node"), F.col("x").alias("nx"), F.col("y").alias("nz"))
    q = projected.select("shard_id", F.col("row").alias("parent"), F.col("x").alias("px"), F.col("y").alias("pz"))
    at = lambda c: F.round(F.coalesce(c, F.lit(0.0)).cast("double") * SCALE, 6)
    out = hop_rows.join(p, ["shard_id", "node"], "left").join(q, ["shard_id", "parent"], "left")
    colour = F.array(*[F.lit(c) for c in COLOURS[VISIT]])
    for kind, rgb in COLOURS.items():
        colour = F.when(F.col("kind") == kind, F.array(*[F.lit(c) for c in rgb])).otherwise(colour)
    out = out.withColumn("rgb", colour)
    return out.select("qid", "shard_id", "hop", "kind", F.element_at("rgb", 1).alias("red"), F.element_at("rgb", 2).alias("green"), F.element_at("rgb", 3).alias("blue"), at(F.col("nx")).alias("x"), (F.col("layer") * HEIGHT).alias("y"), at(F.col("nz")).alias("z"), at(F.col("px")).alias("from_x"), at(F.col("pz")).alias("from_z"))


def point_cloud(projected: DataFrame) -> DataFrame:
    """(shard_id, row, x, y, z): every vector of a shard on the ground of its picture."""
    place = lambda c: F.round(F.col(c).cast("double") * SCALE, 6)
    return projected.select("shard_id", "row", place("x").alias("x"), F.lit(0.0).alias("y"), place("y").alias("z"))


def ring_layout(nodes: DataFrame, order: str, radius: float, by: list[str] | None = None) -> DataFrame:
    """`nodes` with `x` and `y` on a circle, the first at the top and the others clockwise in `order`. Nodes of a ring are few."""
    from pyspark.sql import Window

    w = Window.partitionBy(*(by or []))
    angle = 2 * math.pi * (F.row_number().over(w.orderBy(order)) - 1) / F.count(F.lit(1)).over(w) - math.pi / 2
    return nodes.withColumn("x", F.round(radius * F.cos(angle), 6)).withColumn("y", F.round(radius * F.sin(angle), 6))


def walk_digest(hop_rows: DataFrame) -> DataFrame:
    """(qid, shard_id, records, digest) of each walk: equal for two runs that took the same steps. A walk is bounded by its shard."""
    line = F.concat_ws(":", "hop", "node", "parent", F.col("layer") * 8 + F.col("kind"), F.format_string("%.6f", F.col("dist").cast("double")))
    return hop_rows.groupBy("qid", "shard_id").agg(F.count(F.lit(1)).alias("records"), F.md5(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("hop", line.alias("l")))), lambda x: x["l"]))).alias("digest"))
