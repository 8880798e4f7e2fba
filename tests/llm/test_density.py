import numpy as np
import pytest

from kestrelite.llm.density import condense, condense_tables, density_clusters, describe, place, spanning_forest

SCHEMA = "doc_id long, vector array<float>, category string, cluster string, step string, node string"


def blobs(seed=0, per=80, dim=16):
    rng = np.random.default_rng(seed)
    centres = np.eye(dim)[:3] * 3
    x = np.concatenate([c + 0.5 * rng.standard_normal((per, dim)) for c in centres])
    noise = rng.standard_normal((20, dim)) - 3 * centres.sum(0)
    return np.concatenate([x, noise]), np.repeat([0, 1, 2, 9], [per, per, per, 20])


def test_separated_clusters_are_found(spark):
    x, truth = blobs()
    rows = [(int(i), [float(v) for v in x[i]], f"c{truth[i]} d", "a", "b", "c") for i in range(len(x))]
    rows += rows[:5] + [(None, rows[0][1], "c", "", "", ""), (999, None, "c", "", "", ""), (998, [0.0] * 16, "c", "", "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    members, means = density_clusters(df, "doc_id", "vector", dim=16, core=5, smallest=20, inside=0.5, list_size=100)
    of = {r["doc_id"]: r["cluster"] for r in members.collect()}
    big = {}
    for i, c in of.items():
        big.setdefault(c, []).append(truth[i])
    found = sorted(max(set(v), key=v.count) for v in big.values() if len(v) >= 60)
    assert found[:3] == [0, 1, 2] and all(len(set(v)) == 1 for v in big.values())
    means_of = {r["cluster"] for r in means.collect()}
    assert all(min(k for k, c in of.items() if c == name) == name for name in means_of)
    anchors = spark.createDataFrame([(1, [3.0] + [0.0] * 15), (2, [-1.0] * 16)], "anchor_id int, vector array<float>")
    placed = {r["anchor_id"]: r["cluster"] for r in place(anchors, "anchor_id", "vector", means, 0.6, 16).collect()}
    assert truth[placed[1]] == 0
    told = {r["cluster"]: r for r in describe(members, df, "doc_id", "category").collect()}
    assert set(told) == means_of and all(r["main_permille"] == 1000 and len(r["exemplars"].split(",")) == 5 for r in told.values())


def test_many_copies_are_one_node(spark):
    x, truth = blobs(2)
    rows = [(int(i), [float(v) for v in x[i]], "c", "a", "b", "c") for i in range(len(x))]
    rows += [(5000 + i, rows[0][1], "c", "a", "b", "c") for i in range(150)]
    members, _ = density_clusters(spark.createDataFrame(rows, SCHEMA), "doc_id", "vector", dim=16, core=5, smallest=20, inside=0.5, list_size=100, cell=64)
    of = {r["doc_id"]: r["cluster"] for r in members.collect()}
    assert len({of.get(5000 + i) for i in range(150)}) == 1 and of.get(5000) is not None
    assert sum(of.get(i) is not None for i in range(80, 240)) >= 150


def test_spanning_forest_is_least():
    a, b, w = np.array([1, 2, 1, 8]), np.array([2, 3, 3, 9]), np.array([1, 2, 3, 1])
    assert sorted(spanning_forest(a, b, w).tolist()) == [0, 1, 3]


def test_condensed_hierarchy_prefers_stable_children():
    # Two nodes of ten vectors each, dense at step 10, that join only at step 200.
    chosen = condense([(1, 2, 200)], {1: {10: 10}, 2: {10: 10}}, 5)
    assert sorted(tuple(c["nodes"]) for c in chosen) == [(1,), (2,)]
    # One node only: it never split, so it is a cluster.
    assert len(condense([], {1: {10: 10}}, 5)) == 1
    assert condense([], {1: {10: 3}}, 5) == []


def test_empty(spark):
    members, means = density_clusters(spark.createDataFrame([], SCHEMA), "doc_id", "vector", dim=16)
    assert members.count() == 0 and means.count() == 0
    anchors = spark.createDataFrame([(1, [3.0] + [0.0] * 15)], "anchor_id int, vector array<float>")
    assert place(anchors, "anchor_id", "vector", means, 0.5, 16).count() == 0


def test_smallest_does_not_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr("kestrelite.llm.density.NODES", 2, raising=False)
    x, truth = blobs(4, per=40)
    rows = [(int(i), [float(v) for v in x[i]], "c", "a", "b", "c") for i in range(len(x))]
    members, _ = density_clusters(spark.createDataFrame(rows, SCHEMA), "doc_id", "vector", dim=16, core=5, smallest=20, inside=0.5, list_size=100)
    sides = {}
    for r in members.collect():
        sides.setdefault(r["cluster"], set()).add(truth[r["doc_id"]])
    assert {frozenset(v) for v in sides.values()} >= {frozenset([i]) for i in range(3)}


def test_core_distances_do_not_follow_the_chunks(spark):
    x, _ = blobs(5, per=60)
    rows = [(int(i), [float(v) for v in x[i]], "c", "a", "b", "c") for i in range(len(x))]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [density_clusters(df, "doc_id", "vector", dim=16, core=8, smallest=20, inside=0.5, list_size=100, cell=cell)[0] for cell in (4096, 24)]
    one, cut = ({r["doc_id"]: (r["cluster"], r["step"]) for r in g.collect()} for g in got)
    assert one and one == cut


def test_long_lists_are_split(spark):
    x, truth = blobs(6, per=120)
    rows = [(int(i), [float(v) for v in x[i]], "c", "a", "b", "c") for i in range(len(x))]
    members, _ = density_clusters(spark.createDataFrame(rows, SCHEMA), "doc_id", "vector", dim=16, core=5, smallest=20, inside=0.5, list_size=60, sample_rows=64, split=100)
    sides = {}
    for r in members.collect():
        sides.setdefault(r["cluster"], []).append(truth[r["doc_id"]])
    assert all(len(set(v)) == 1 for v in sides.values()) and {v[0] for v in sides.values()} >= {0, 1, 2} and sum(map(len, sides.values())) >= 300


@pytest.mark.parametrize("seed", [0, 2])
def test_hierarchy_by_tables_is_that_in_memory(spark, seed):
    """Random forests with few distances: ties, merges of many groups at once, vectors that arrive late, clusters in clusters."""
    rng = np.random.default_rng(seed)
    steps = [2, 20, 60]
    mass = {i: {int(s): int(rng.integers(1, 9)) for s in rng.choice(steps, rng.integers(1, 3), replace=False)} for i in range(60)}
    edges = [(int(rng.integers(max(0, i - 8), i)), i, int(rng.choice(steps))) for i in range(1, 60) if rng.random() < 0.95]
    chosen = condense(edges, mass, 9)
    want = set()
    for c in chosen:
        inside = {n: s for n, s in c["nodes"].items() if s < c["end"]}
        want |= {(n, min(inside), s, c["end"]) for n, s in inside.items()}
    e = spark.createDataFrame(edges, "a long, b long, w int")
    m = spark.createDataFrame([(n, s, k) for n, of in mass.items() for s, k in of.items()], "node long, step int, n long")
    got = condense_tables(e, m, 9).collect()
    name = {}
    for r in got:
        name[r["cluster"]] = min(name.get(r["cluster"], r["node"]), r["node"])
    assert {(r["node"], name[r["cluster"]], r["entered"], r["end"]) for r in got} == want and len(chosen) > 1


def test_means_that_are_not_broadcast(spark, monkeypatch):
    x, _ = blobs(7, per=50)
    df = spark.createDataFrame([(int(i), [float(v) for v in x[i]], "c", "a", "b", "c") for i in range(len(x))], SCHEMA)
    run = lambda: {(r["doc_id"], r["cluster"], r["step"]) for r in density_clusters(df, "doc_id", "vector", dim=16, core=5, smallest=20, inside=0.5, list_size=100)[0].collect()}
    one = run()
    monkeypatch.setattr("kestrelite.llm.density.BROADCAST_MEANS", 1)
    assert one and run() == one
