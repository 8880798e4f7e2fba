"""Clusters of mutually similar vectors by hierarchical density clustering.

  1. Neighbour graph: vectors are placed in the posting lists of the neighbour search, each in up to two of them. Within a list every pair
     has its mutual reachability, the largest of its distance and both ends' distance to their `core`-th neighbour in the list. Only a
     list's minimum spanning forest leaves its task: an edge that isn't in it is in no minimum spanning tree of the whole graph.
     More than `core` copies of one vector are one node, whose vectors it has from the start and whose own distance is 0.
  2. Borůvka rounds: each node of fewer than `smallest` vectors hooks along its lightest edge. A group below that size is no cluster, so
     all that the hierarchy needs of it is how many vectors it brings at which distance, and the hooked node's vectors keep the distance
     at which they joined. After about log2(smallest) rounds only nodes of `smallest` vectors or more are left, at most rows / smallest.
  3. Condensed hierarchy over these nodes, stability of each cluster, selection by largest stability. All that happens at one distance happens at
     once and there are at most 257 distances, so the hierarchy is made by as many rounds over tables (`condense_tables`), in which a group is a
     row; of at most `DRIVER_NODES` nodes it is made in memory (`condense`). Both give the same: stabilities are whole numbers.
  4. Members are the vectors that joined a selected cluster before it joined another; of these, only such stay whose similarity with the
     cluster's mean is at least `inside`. The most persistent members, those that joined at the shortest distance, are the exemplars.

Distances are steps of 1/128. Defined results: vectors take part as in the neighbour search; ties go to the smaller id; clusters are
numbered by their smallest member; an empty table, or one without clusters, gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrelite.llm.knn import _assigned, cells, fit_lists, parts_of, split_lists, unit, unpack, usable_vectors
from kestrelite.operators.components import connected_components
from kestrelite.scratch import materialize, release

STEPS = 128
TOP = 2 * STEPS + 1
#: Nodes whose hierarchy the driver makes, and clusters whose means go to every task, at most.
DRIVER_NODES, BROADCAST_MEANS = 50_000, 16_384


def spanning_forest(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Positions of the edges of a minimum spanning forest (Kruskal; ties by position)."""
    names, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent, ends = list(range(len(names))), flat.reshape(2, -1).T.tolist()
    keep = []
    for e in np.argsort(w, kind="stable").tolist():
        x, y = ends[e]
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[x] = y
            keep.append(e)
    return np.array(keep, np.int64)


def _list_forest(dim: int, core: int):
    """The minimum spanning tree of a list's mutual reachabilities (Prim, a row of distances a step)."""

    def run(table: pa.Table) -> pa.Table:
        ids, first = np.unique(table["doc_id"].to_numpy(), return_index=True)
        x = unit(unpack(table["vec"], dim))[first].astype(np.float32)
        heavy, whole = table["heavy"].to_numpy()[first], table["reach"].to_numpy()[first]
        n = len(ids)
        reach, k = np.empty(n, np.float32), min(core, n - 1)
        for lo in range(0, n, 1024):
            sim = x[lo : lo + 1024] @ x.T
            reach[lo : lo + 1024] = -np.partition(-sim, k, axis=1)[:, k]  # the k-th besides itself
        reach = np.where(np.isnan(whole), reach, whole).astype(np.float32)
        reach[heavy] = 1
        best, to, left = np.full(n, -9, np.float32), np.zeros(n, np.int64), np.ones(n, bool)
        a, b, w, now = [], [], [], 0
        for _ in range(n - 1):
            left[now] = False
            sim = np.minimum(np.minimum(x @ x[now], reach), reach[now])
            nearer = left & (sim > best)
            best[nearer], to[nearer] = sim[nearer], now
            now = int(np.where(left, best, -10).argmax())
            a.append(ids[to[now]])
            b.append(ids[now])
            w.append(best[now])
        step = np.ceil(np.sqrt(np.maximum(0, 2 - 2 * np.array(w, np.float64))) * STEPS).clip(1).astype(np.int32)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "w": pa.array(step)})

    return run


def _whole_reach(spread: DataFrame, dim: int, core: int) -> DataFrame:
    """(list, doc_id, reach): similarity with the `core`-th neighbour in all chunks of a list, each of which is in one task with each other one."""

    def best(table: pa.Table) -> pa.Table:
        ids, first = np.unique(table["doc_id"].to_numpy(), return_index=True)
        x, own = unit(unpack(table["vec"], dim))[first].astype(np.float32), table["own"].to_numpy()[first]
        of, near = [], []
        p, q = table["p"][0].as_py(), table["q"][0].as_py()
        for a, b in {(p, q), (q, p)}:
            at, to = np.flatnonzero(own == a), np.flatnonzero(own == b)
            k = min(core, len(to) - (a == b))
            for lo in range(0, len(at) if k > 0 else 0, 1024):
                sim = x[at[lo : lo + 1024]] @ x[to].T
                sim[at[lo : lo + 1024, None] == to[None]] = -9
                of += ids[at[lo : lo + 1024]].tolist()
                near += (-np.partition(-sim, k - 1, axis=1)[:, :k]).tolist()
        return pa.table({"list": pa.array([table["list"][0].as_py()] * len(of), pa.int64()), "doc_id": pa.array(of, pa.int64()), "near": pa.array(near, pa.list_(pa.float32()))})

    parts = spread.groupBy("list", "p", "q").applyInArrow(best, "list long, doc_id long, near array<float>")
    near = parts.groupBy("list", "doc_id").agg(F.sort_array(F.flatten(F.collect_list("near")), asc=False).alias("near"))
    return near.select("list", "doc_id", F.element_at("near", F.least(F.lit(core), F.size("near"))).alias("reach"))


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spanning forest of a partition's edges, kept as one grows through it, by as many edges at a time as it has."""
    kept = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "w": pa.array([], pa.int32())})

    def joined(more: list[pa.Table]) -> pa.Table:
        both = pa.concat_tables([kept, *more])
        return both.take(spanning_forest(*(both[c].to_numpy() for c in ("a", "b", "w")))).combine_chunks()

    more: list[pa.Table] = []
    for batch in batches:
        more.append(pa.Table.from_batches([batch]).cast(kept.schema))
        if sum(map(len, more)) >= max(len(kept), 10_000):
            kept, more = joined(more), []
    yield from (joined(more) if more else kept).to_batches()


EDGE = "a long, b long, w int"


def _absorb(edges: DataFrame, placed: DataFrame, smallest: int) -> tuple[DataFrame, DataFrame]:
    """Borůvka rounds until no node of fewer than `smallest` vectors has an edge.

    `placed`: (doc_id, node, step), the node each vector belongs to and the distance at which it joined.
    """
    while True:
        small = placed.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < smallest)
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
        # One total order of edges, the same from either end, so that hooks can only close a cycle of two.
        least = both.groupBy("a").agg(F.min(F.struct("w", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))).alias("e"))
        hook = least.join(small.select(F.col("node").alias("a")), "a", "left_semi")
        hook = hook.select(F.col("a").alias("node"), F.when(F.col("e.lo") == F.col("a"), F.col("e.hi")).otherwise(F.col("e.lo")).alias("up"), F.col("e.w").alias("w"))
        back = hook.select(F.col("node").alias("up"), F.col("up").alias("node"), F.lit(True).alias("back"))
        hook = hook.join(back, ["node", "up"], "left").where("back IS NULL OR node > up").select("node", "up", "w")  # of two that hook each other the smaller stays
        hook = materialize(hook, "density-hooks")
        if not hook.limit(1).count():
            release(hook)
            return edges, placed
        while True:  # each node finds the root of its tree of hooks, twice as far each time
            above = hook.select(F.col("node").alias("up"), F.col("up").alias("upper"))
            after = materialize(hook.join(above, "up", "left").select("node", F.coalesce("upper", "up").alias("up"), "w", F.col("upper").isNotNull().alias("moved")), "density-hooks")
            moved = after.where("moved").limit(1).count()
            release(hook)
            hook = after
            if not moved:
                break
        root = hook.select("node", F.col("up").alias("root"), "w")
        old_placed, old_edges = placed, edges
        placed = materialize(placed.join(root, "node", "left").select("doc_id", F.coalesce("root", "node").alias("node"), F.when(F.col("root").isNull(), F.col("step")).otherwise(F.greatest("step", "w")).alias("step")), "density-placed")
        ends = edges.join(root.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(root.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
        ends = ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"), "w").where("a <> b")
        ends = ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").groupBy("a", "b").agg(F.min("w").alias("w"))
        edges = materialize(ends, "density-edges")
        for old in (old_placed, old_edges, hook):
            release(old)


def _upto() -> list[int]:
    """What a vector adds to a cluster's stability by staying from the first distance up to each one, in whole 2^-32 parts: differences of 1 / distance."""
    total = [0]
    for step in range(TOP):
        d = max(step, 1)
        total.append(total[-1] + round((1 / d - 1 / (d + 1)) * 2**32))
    return total


UPTO = _upto()


def condense(edges: list[tuple[int, int, int]], mass: dict[int, dict[int, int]], smallest: int) -> list[dict]:
    """The selected clusters of the hierarchy over nodes.

    edges: (node, node, step); mass: by node, how many vectors it brings at which step. A cluster has `nodes`, each with the step at which it
    joined, and `end`, the step at which the cluster joined another one (the number of steps if it never did).
    """
    top = TOP
    at_step: dict[int, list] = defaultdict(list)
    for a, b, w in edges:
        at_step[w].append((a, b))
    arrives: dict[int, list] = defaultdict(list)
    for node, steps in mass.items():
        for step, n in steps.items():
            arrives[step].append((node, n))
    parent = {n: n for n in mass}
    size, cluster_of, entry_nodes = dict.fromkeys(mass, 0), dict.fromkeys(mass), {n: [n] for n in mass}
    clusters: list[dict] = []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    active: set[int] = set()
    for step in range(top):
        touched = set()
        for node, n in arrives.get(step, ()):
            r = find(node)
            size[r] += n
            touched.add(r)
        # All merges of one step happen at once; what is a cluster before it counts as one that is merged.
        merges = at_step.get(step, ())
        groups: dict[int, set[int]] = defaultdict(set)
        for a, b in merges:
            ra, rb = find(a), find(b)
            if ra == rb:
                continue
            ga, gb = groups.pop(ra, {ra}), groups.pop(rb, {rb})
            parent[ra] = rb
            groups[rb] = ga | gb
        for r, members in groups.items():
            merged = [m for m in members if cluster_of[m] is not None]
            total = sum(size[m] for m in members)
            nodes = [n for m in members for n in entry_nodes[m]]
            if len(merged) > 1:
                for m in merged:
                    clusters[cluster_of[m]]["end"] = step
                    active.discard(cluster_of[m])
                clusters.append({"children": [cluster_of[m] for m in merged], "nodes": dict.fromkeys(nodes, step), "end": top, "stability": 0, "root": r})
                cluster_of[r] = len(clusters) - 1
                active.add(len(clusters) - 1)
            elif merged:
                c = cluster_of[merged[0]]
                for n in nodes:
                    clusters[c]["nodes"].setdefault(n, step)
                clusters[c]["root"] = r
                cluster_of[r] = c
            else:
                cluster_of[r] = None
            size[r], entry_nodes[r] = total, nodes
            touched.add(r)
        for r in {find(r) for r in touched}:
            if cluster_of[r] is None and size[r] >= smallest:
                clusters.append({"children": [], "nodes": dict.fromkeys(entry_nodes[r], step), "end": top, "stability": 0, "root": r})
                cluster_of[r] = len(clusters) - 1
                active.add(len(clusters) - 1)
        for c in active:
            clusters[c]["stability"] += size[clusters[c]["root"]] * (UPTO[step + 1] - UPTO[step])
    chosen: list[bool] = []
    for i, c in enumerate(clusters):  # children come before parents
        below = sum(clusters[k]["stability"] for k in c["children"])
        chosen.append(c["end"] < top or not c["children"])  # what holds all its part of the graph isn't a cluster unless it never split
        if c["children"] and (below > c["stability"] or not chosen[i]):
            c["stability"], chosen[i] = below, False
    selected = []
    for i in range(len(clusters) - 1, -1, -1):
        if chosen[i]:
            selected.append(clusters[i])
            todo = list(clusters[i]["children"])
            while todo:
                k = todo.pop()
                chosen[k] = False
                todo += clusters[k]["children"]
    return selected


def condense_tables(edges: DataFrame, mass: DataFrame, smallest: int) -> DataFrame:
    """The same by tables: (node, cluster, entered, end) of the nodes of all selected clusters. edges: (a, b, w); mass: (node, step, n).

    A round takes one distance: vectors arrive, edges of that distance join groups (connected components), and each group, one row, says whether it
    is a cluster. A cluster is named by (g, s), its group and the distance at which it was born. What a cluster has gained up to its end is
    size x upto(end) less the sum of what came x upto(when it came), so a round touches only groups in which something happens.
    """
    spark = edges.sparkSession
    big = "decimal(38,0)"
    steps = sorted({r[0] for r in mass.select("step").distinct().collect()} | {r[0] for r in edges.select("w").distinct().collect()})  # at most TOP numbers
    nodes = materialize(mass.select("node").distinct().select("node", F.col("node").alias("root"), F.lit(None).cast("long").alias("g"), F.lit(None).cast("int").alias("s"), F.lit(None).cast("int").alias("entered")), "condense-nodes")
    groups = materialize(nodes.select("root", F.lit(0).cast("long").alias("size"), "g", "s", F.lit(0).cast(big).alias("gone"), F.lit(0).cast(big).alias("below"), F.lit(False).alias("parent")), "condense-groups")
    ended: list[DataFrame] = []

    def close(of: DataFrame, end: int, to_g, to_s) -> DataFrame:
        """Clusters that end: their stability, whether they would be chosen, and the cluster that they join. What comes as they end adds nothing."""
        own = (F.col("size") - F.coalesce("came", F.lit(0))).cast(big) * F.lit(UPTO[end]).cast(big) - F.col("gone")
        chosen = ~F.col("parent") | ((F.col("below") <= own) & F.lit(end < TOP))
        return of.select("g", "s", F.lit(end).alias("end"), F.when(chosen, own).otherwise(F.col("below")).cast(big).alias("best"), chosen.alias("chosen"), to_g.alias("up_g"), to_s.alias("up_s"))

    for step in steps:
        name = nodes.select("node", "root")
        came = mass.where(F.col("step") == step).join(name, "node").groupBy("root").agg(F.sum("n").alias("came"))
        joins = edges.where(F.col("w") == step).join(name.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(name.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        joins = materialize(joins.where("ra <> rb").select("ra", "rb"), "condense-joins")
        pairs = connected_components(joins, "ra", "rb") if joins.limit(1).count() else joins.select(F.col("ra").alias("node"), F.col("rb").alias("component"))
        to = materialize(pairs.select(F.col("node").alias("root"), "component"), "condense-to")
        now = groups.join(came, "root", "left").join(to, "root", "left").withColumn("group", F.coalesce("component", "root"))
        now = now.withColumn("size", F.col("size") + F.coalesce("came", F.lit(0)))
        each = now.groupBy("group").agg(F.sum("size").alias("size"), F.count("g").alias("clusters"), F.max("g").alias("g1"), F.max("s").alias("s1"), F.sum(F.when(F.col("g").isNotNull(), F.col("gone"))).alias("gone1"),
                                        F.sum(F.when(F.col("g").isNotNull(), F.col("size") - F.coalesce("came", F.lit(0)))).alias("was"), F.max(F.when(F.col("g").isNotNull(), F.col("below"))).alias("below1"), F.max("parent").alias("parent1"))
        many, one = F.col("clusters") > 1, F.col("clusters") == 1
        born = many | ((F.col("clusters") == 0) & (F.col("size") >= smallest))
        each = materialize(each.select("group", "size", "clusters", many.alias("merged"), born.alias("born"), "g1", "s1", "gone1", "was", "below1", "parent1"), "condense-each")
        over = materialize(close(now.where("g IS NOT NULL").join(each.where("merged").select("group"), "group", "left_semi"), step, F.col("group"), F.lit(step)), "condense-ended")
        ended.append(over)
        below = over.groupBy(F.col("up_g").alias("group")).agg(F.sum("best").cast(big).alias("below2"))
        at = F.lit(UPTO[step]).cast(big)
        after = each.join(below, "group", "left").select(
            F.col("group").alias("root"), "size",
            F.when(F.col("born"), F.col("group")).when(F.col("clusters") == 1, F.col("g1")).alias("g"), F.when(F.col("born"), F.lit(step)).when(F.col("clusters") == 1, F.col("s1")).alias("s"),
            F.when(F.col("born"), F.col("size").cast(big) * at).when(F.col("clusters") == 1, F.col("gone1") + (F.col("size") - F.col("was")).cast(big) * at).otherwise(F.lit(0)).cast(big).alias("gone"),
            F.when(F.col("merged"), F.col("below2")).when(F.col("clusters") == 1, F.col("below1")).otherwise(F.lit(0)).cast(big).alias("below"),
            F.when(F.col("merged"), F.lit(True)).when(F.col("clusters") == 1, F.col("parent1")).otherwise(F.lit(False)).alias("parent"),
        )
        new_groups = materialize(after, "condense-groups")
        moved = nodes.join(to, "root", "left").withColumn("root", F.coalesce("component", "root")).drop("component")
        of = new_groups.select("root", F.col("g").alias("g2"), F.col("s").alias("s2"))
        first = F.col("g").isNull() & F.col("g2").isNotNull()
        new_nodes = materialize(moved.join(of, "root").select("node", "root", F.coalesce("g", "g2").alias("g"), F.coalesce("s", "s2").alias("s"), F.when(first, F.lit(step)).otherwise(F.col("entered")).alias("entered")), "condense-nodes")
        for old in (nodes, groups, joins, to, each):
            release(old)
        nodes, groups = new_nodes, new_groups
    none = F.lit(None)
    ended.append(close(groups.where("g IS NOT NULL").withColumn("came", F.lit(0)), TOP, none.cast("long"), none.cast("int")))
    clusters = materialize(reduce(DataFrame.union, ended), "condense-clusters")
    # From the last clusters down: each takes the selected cluster above it, or is selected itself.
    level = clusters.where("up_g IS NULL").select("g", "s", "end", F.when(F.col("chosen"), F.struct("g", "s", "end")).alias("sel"))
    chosen = []
    while True:
        level = materialize(level, "condense-level")
        if not level.limit(1).count():
            break
        chosen.append(level)
        above = level.select(F.col("g").alias("up_g"), F.col("s").alias("up_s"), F.col("sel").alias("above"))
        level = clusters.join(above, ["up_g", "up_s"]).select("g", "s", "end", F.coalesce("above", F.when(F.col("chosen"), F.struct("g", "s", "end"))).alias("sel"))
    if not chosen:
        return spark.createDataFrame([], "node long, cluster long, entered int, end int")
    held = nodes.where("g IS NOT NULL").join(reduce(DataFrame.union, chosen).select("g", "s", "sel"), ["g", "s"]).where("sel IS NOT NULL")
    out = held.select("node", F.col("sel.g").alias("cluster"), F.greatest("entered", "sel.s").alias("entered"), F.col("sel.end").alias("end"))
    return out.where("entered < end")


def _means(vectors: DataFrame, members: DataFrame, dim: int) -> DataFrame:
    """(cluster, mean): mean direction by cluster."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[int, np.ndarray] = {}
            cluster, x = batch.column(0).to_numpy(), unit(unpack(batch.column(1), dim))
            for c in np.unique(cluster).tolist():
                total[c] = x[cluster == c].sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["cluster", "total"])

    parts = vectors.join(members.select("doc_id", "cluster"), "doc_id").select("cluster", "vec").mapInArrow(add, "cluster long, total array<double>")
    at = parts.select("cluster", F.posexplode("total").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("x").alias("x"))
    whole = at.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("total"))  # `dim` numbers a cluster
    length = F.sqrt(F.aggregate("total", F.lit(0.0), lambda n, x: n + x * x))
    return whole.select("cluster", F.transform("total", lambda x: x / F.greatest(length, F.lit(1e-12))).alias("mean"))


def density_clusters(
    rows: DataFrame, id_column: str, vector_column: str, dim: int = 64, core: int = 10, smallest: int = 25, inside: float = 0.55,
    list_size: int = 1000, sample_rows: int = 65_536, cell: int = 4096, split: int = 16_384,
) -> tuple[DataFrame, DataFrame]:
    """(doc_id, cluster, step, similarity) of all members, and (cluster, mean), the mean direction of each cluster."""
    spark = rows.sparkSession
    vectors = materialize(usable_vectors(rows, id_column, vector_column, dim), "density-vectors")
    n = vectors.count()
    nodes, placed, heavy = vectors, vectors.select("doc_id", F.col("doc_id").alias("node"), F.lit(0).alias("step")), None
    marks = [F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2")]
    copies = vectors.groupBy(*marks).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > core).drop("n")
    if copies.limit(1).count():
        tagged = materialize(vectors.select("doc_id", *marks).join(copies, ["h1", "h2"]).select("doc_id", "first"), "density-copies")
        nodes = vectors.join(tagged.where("doc_id <> first").select("doc_id"), "doc_id", "left_anti")
        placed = placed.drop("node").join(tagged, "doc_id", "left").select("doc_id", F.coalesce("first", "doc_id").alias("node"), "step")
        heavy = tagged.where("doc_id = first").select("doc_id", F.lit(True).alias("heavy"))
    lists = spark.sparkContext.broadcast(fit_lists(nodes, dim, n if heavy is None else nodes.count(), list_size, sample_rows))
    spread, chunks = split_lists(_assigned(nodes, lists, dim, 2, 0.1, 0, 0.1, "false").where("posted"), dim, list_size, split, cell, 2, 0.1, 0, 0.1)
    spread = cells(spread.withColumn("asks", F.lit(False)), chunks)
    # Of a list in chunks each pair of chunks is a task; (p, q) and (q, p) hold the same vectors.
    spread = spread.select(F.col("list").cast("long").alias("list"), F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"), F.col("p").alias("own"), "doc_id", "vec")
    if chunks.where("n > 2").limit(1).count():  # a pair of chunks is then not the whole list
        spread = materialize(spread, "density-spread")
        large = chunks.where("n > 2").select(F.col("list").cast("long").alias("list"))
        spread = spread.join(_whole_reach(spread.join(F.broadcast(large), "list", "left_semi"), dim, core), ["list", "doc_id"], "left")
    else:
        spread = spread.withColumn("reach", F.lit(None).cast("float"))
    spread = spread.drop("own")
    spread = spread.withColumn("heavy", F.lit(False)) if heavy is None else spread.join(heavy, "doc_id", "left").withColumn("heavy", F.coalesce("heavy", F.lit(False)))
    forest = spread.repartition(parts_of(2 * n, spark), "list", "p", "q").groupBy("list", "p", "q").applyInArrow(_list_forest(dim, core), EDGE)
    edges = materialize(forest.mapInArrow(_thin, EDGE), "density-edges")
    edges, placed = _absorb(edges, placed, smallest)
    sizes = placed.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= smallest).select("node")
    mass = materialize(placed.join(sizes, "node", "left_semi").groupBy("node", "step").agg(F.count(F.lit(1)).alias("n")), "density-mass")
    left = edges.join(sizes.select(F.col("node").alias("a")), "a", "left_semi").join(sizes.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b", "w")
    left = materialize(left.mapInArrow(_thin, EDGE), "density-left")
    if mass.select("node").distinct().count() <= DRIVER_NODES:
        held: dict[int, dict[int, int]] = defaultdict(dict)
        for row in mass.collect():  # at most DRIVER_NODES nodes, each with the steps of its own vectors
            held[row["node"]][row["step"]] = row["n"]
        parts = left.rdd.getNumPartitions()
        while parts > 1:  # a tree of tasks, each of which leaves out what no spanning forest needs
            parts = -(-parts // 8)
            left = left.repartition(parts).mapInArrow(_thin, EDGE)
        chosen = condense([tuple(map(int, e)) for e in left.collect()], dict(held), smallest)
        rows = [(node, min(c["nodes"]), step, c["end"]) for c in chosen for node, step in c["nodes"].items() if step < c["end"]]
        nodes = spark.createDataFrame(rows, "node long, cluster long, entered int, end int")
    else:
        nodes = materialize(condense_tables(left, mass, smallest), "density-nodes")
    members = placed.join(nodes, "node").withColumn("step", F.greatest("step", "entered")).where("step < end").select("doc_id", "cluster", "step")
    members = materialize(members, "density-members")
    means = materialize(_means(vectors, members, dim), "density-means")
    full = vectors.join(members, "doc_id").select("doc_id", "cluster", "step", "vec")
    some = means.limit(BROADCAST_MEANS + 1).collect()
    if len(some) <= BROADCAST_MEANS:
        held = spark.sparkContext.broadcast({r["cluster"]: np.array(r["mean"]) for r in some})

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x, mean = unit(unpack(batch.column(3), dim)), np.stack([held.value[c] for c in batch.column(1).to_pylist()])
                    yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.einsum("ij,ij->i", x, mean))], ["doc_id", "cluster", "step", "similarity"])

    else:
        full = full.join(means, "cluster").select("doc_id", "cluster", "step", "vec", "mean")

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x, mean = unit(unpack(batch.column(3), dim)), batch.column(4).flatten().to_numpy().reshape(-1, dim)
                    yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.einsum("ij,ij->i", x, mean))], ["doc_id", "cluster", "step", "similarity"])

    held_rows = full.mapInArrow(near, "doc_id long, cluster long, step int, similarity double").where(F.col("similarity") >= inside)
    kept = materialize(held_rows, "density-held")
    named = materialize(kept.groupBy("cluster").agg(F.min("doc_id").alias("name")), "density-names")
    out = kept.join(named, "cluster").select("doc_id", F.col("name").alias("cluster"), "step", "similarity")
    return out, means.join(named, "cluster").select(F.col("name").alias("cluster"), "mean")


#: Points that are placed at once: they go to every task, the means don't.
POINTS = 16_384


def place(points: DataFrame, id_column: str, vector_column: str, means: DataFrame, inside: float, dim: int = 64) -> DataFrame:
    """(id_column, cluster): the cluster whose mean is most similar, if it is at least `inside`; ties to the smaller name."""
    spark = points.sparkSession
    usable = materialize(usable_vectors(points, id_column, vector_column, dim), "density-points")
    sets, found = max(1, -(-usable.count() // POINTS)), []
    for k in range(sets):
        table = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(sets)) == k).toArrow()  # one bounded set
        held = spark.sparkContext.broadcast((table["doc_id"].to_numpy(), unit(unpack(table["vec"], dim)) if table.num_rows else np.empty((0, dim))))

        def nearest(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, x = held.value
            for batch in batches:
                if batch.num_rows and len(ids):
                    sim = x @ batch.column(1).flatten().to_numpy().reshape(-1, dim).T
                    name = batch.column(0).to_numpy()
                    best = np.lexsort((name[None].repeat(len(x), 0), -sim), axis=1)[:, 0]
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(name[best]), pa.array(sim[np.arange(len(x)), best])], ["point", "cluster", "similarity"])

        found.append(means.select("cluster", "mean").mapInArrow(nearest, "point long, cluster long, similarity double"))
    best = reduce(DataFrame.union, found).groupBy("point").agg(F.min(F.struct((-F.col("similarity")).alias("far"), "cluster")).alias("b"))
    return best.where(F.col("b.far") <= -inside).select(F.col("point").alias(id_column), F.col("b.cluster").alias("cluster"))


def nearest_means(vectors: DataFrame, means: DataFrame, dim: int = 64) -> DataFrame:
    """(doc_id, cluster, best, second): the most similar mean of each vector (doc_id, vec) and the similarity of the next one (-2 if there is none).

    Means go to the tasks in sets of at most BROADCAST_MEANS, a scan of the vectors for each set.
    """
    spark = vectors.sparkSession
    sets, found = max(1, -(-means.count() // BROADCAST_MEANS)), []
    for k in range(sets):
        rows = means.where(F.pmod(F.xxhash64("cluster"), F.lit(sets)) == k).collect()  # one bounded set
        held = spark.sparkContext.broadcast((np.array([r["cluster"] for r in rows], np.int64), np.array([r["mean"] for r in rows]).reshape(-1, dim)))

        def near(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            name, mean = held.value
            for batch in batches:
                if batch.num_rows and len(name):
                    sim = unit(unpack(batch.column(1), dim)) @ mean.T
                    best = sim.argmax(1)
                    top = sim[np.arange(len(sim)), best].copy()
                    sim[np.arange(len(sim)), best] = -2
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(name[best]), pa.array(top), pa.array(sim.max(1))], ["doc_id", "cluster", "best", "second"])

        found.append(vectors.select("doc_id", "vec").mapInArrow(near, "doc_id long, cluster long, best double, second double"))
    if sets == 1:
        return found[0]
    each = reduce(DataFrame.union, found).groupBy("doc_id").agg(F.max_by(F.struct("cluster", "best"), "best").alias("t"), F.sort_array(F.flatten(F.collect_list(F.array("best", "second"))), asc=False).alias("v"))
    return each.select("doc_id", "t.cluster", "t.best", F.element_at("v", 2).alias("second"))


def describe(members: DataFrame, rows: DataFrame, id_column: str, category_column: str, exemplars: int = 5) -> DataFrame:
    """A row per cluster: size, its most persistent members, and its most frequent category with its share in thousandths."""
    order = Window.partitionBy("cluster").orderBy("step", F.desc("similarity"), "doc_id")
    typical = members.withColumn("r", F.row_number().over(order)).where(F.col("r") <= exemplars)
    typical = typical.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "doc_id"))), lambda x: x["doc_id"].cast("string")), ",").alias("exemplars"))
    of = rows.select(F.col(f"`{id_column}`").alias("doc_id"), F.coalesce(F.lower(F.regexp_extract(F.col(f"`{category_column}`"), r"^[ \t]*([^ \t,;]+)", 1)), F.lit("")).alias("category")).groupBy("doc_id").agg(F.min("category").alias("category"))
    mix = members.join(of, "doc_id", "left").groupBy("cluster", "category").agg(F.count(F.lit(1)).alias("n"))
    mix = mix.groupBy("cluster").agg(F.sum("n").alias("size"), F.max_by("category", F.struct("n", "category")).alias("main_category"), F.max("n").alias("most"))
    return mix.join(typical, "cluster").select("cluster", "size", "exemplars", "main_category", F.expr("most * 1000 div size").alias("main_permille"))
