import numpy as np
import pytest

from kestrelite.operators.graph_index import ENTRY, RESULT, VISIT, build, build_graphs, hops, projections, search_graphs, walk_digest


@pytest.fixture(scope="module")
def corpus():
    x = np.random.default_rng(0).standard_normal((600, 24))
    return (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)


def test_recall_degrees_and_trace(corpus):
    g = build(corpus, ef=100)
    rng = np.random.default_rng(1)
    found, total = 0, 0
    for _ in range(40):
        q = rng.standard_normal(24).astype(np.float32)
        q /= np.linalg.norm(q)
        trace = []
        hits = g.search(q, 10, 100, trace)
        assert [r for _, r in hits] == [r for _, r in g.search(q, 10, 100)]
        truth = set(np.argsort(-(corpus @ q))[:10].tolist())
        found, total = found + len(truth & {r for _, r in hits}), total + 10
        assert trace[0][1] == ENTRY and trace[0][0] == len(g.layers) - 1
        layers = [t[0] for t in trace]
        assert layers == sorted(layers, reverse=True)
        assert [t[2] for t in trace if t[1] == RESULT] == [r for _, r in hits] and sum(t[1] == VISIT for t in trace) > 0
    assert found / total >= 0.95
    for layer, links in enumerate(g.layers):
        assert max(len(v) for v in links.values()) <= (32 if layer == 0 else 16)
        assert all(r not in v for r, v in links.items())


def test_same_graph_whatever_the_order_of_rows(spark, corpus):
    rows = [(i, i % 2, corpus[i].tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, shard_id int, vector array<float>")
    a, b = (sorted(map(tuple, build_graphs(d, 24, seed=3).collect())) for d in (df, df.orderBy("doc_id", ascending=False).repartition(3)))
    assert a == b and a != sorted(map(tuple, build_graphs(df, 24, seed=4).collect()))
    edges = build_graphs(df, 24, seed=3)
    q = [(1, corpus[5].tolist()), (2, corpus[6].tolist())]
    runs = [{(r["qid"], r["shard_id"]): r["digest"] for r in walk_digest(hops(search_graphs(d, edges, q, 24, traced=True))).collect()} for d in (df, df.repartition(5))]
    assert runs[0] == runs[1] and len(runs[0]) == 4


def test_projection(spark, corpus):
    df = spark.createDataFrame([(i, 0, corpus[i].tolist()) for i in range(50)] + [(99, 1, corpus[0].tolist())], "doc_id long, shard_id int, vector array<float>")
    p = projections(df, 24).collect()
    xy = np.array([(r["x"], r["y"]) for r in p if r["shard_id"] == 0])
    assert np.abs(xy).max(0) == pytest.approx([1, 1]) and xy[:, 0].std() >= xy[:, 1].std() * 0.5
    assert [(r["x"], r["y"]) for r in p if r["shard_id"] == 1] == [(0.0, 0.0)]


def test_more_queries_than_a_block(spark, corpus, monkeypatch):
    """Each query walks as it does in one block, traces included; a query without a full vector has no hits."""
    df = spark.createDataFrame([(i, i % 3, corpus[i].tolist()) for i in range(150)], "doc_id long, shard_id int, vector array<float>")
    edges = build_graphs(df, 24)
    q = spark.createDataFrame([(i, corpus[i].tolist()) for i in range(300, 325)] + [(999, None)], "qid long, vector array<float>")
    walks = lambda: sorted(map(str, search_graphs(df, edges, q, 24, traced=True).drop("us", "offset").collect()))  # noqa: E731 - no two runs take the same time
    one = walks()
    monkeypatch.setattr("kestrelite.operators.graph_index.BLOCK", 4)
    assert walks() == one and len(one) == 25 * 3 * 10


def test_registered_queries_with_more_than_a_block(spark, monkeypatch, tmp_path):
    from kestrelite.queries.graph_index import QUERIES

    x = np.random.default_rng(2).standard_normal((900, 64))
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    names = ("hnsw_search", "hnsw_search_wide", "hnsw_trace_stats", "inspector_view")
    run = lambda n: sorted(map(str, QUERIES[n](spark, str(tmp_path)).drop("duration_us").collect()))
    one = {n: run(n) for n in names}
    for at in ("operators", "queries"):
        monkeypatch.setattr(f"kestrelite.{at}.graph_index.BLOCK", 4, raising=False)
    assert {n: run(n) for n in names} == one and all(one.values())


def test_probed_shards_only(spark, corpus, tmp_path):
    """A query meets the shards of its plan, whether in one block or several, and others aren't read."""
    df = spark.createDataFrame([(i, i % 6, corpus[i].tolist()) for i in range(300)], "doc_id long, shard_id int, vector array<float>")
    df.write.partitionBy("shard_id").parquet(f"{tmp_path}/v")
    build_graphs(df, 24).write.partitionBy("shard_id").parquet(f"{tmp_path}/e")
    v, e = spark.read.parquet(f"{tmp_path}/v"), spark.read.parquet(f"{tmp_path}/e")
    q = spark.createDataFrame([(i, corpus[i].tolist()) for i in range(400, 406)], "qid long, vector array<float>")
    plan = spark.createDataFrame([(400 + i, s) for i in range(6) for s in (1, 2 + i % 2)], "qid long, shard_id int")
    want = sorted(tuple(r) for r in search_graphs(v, e, q, 24).join(plan, ["qid", "shard_id"]).select("qid", "shard_id", "doc_id", "rank", "visited").collect())
    found = search_graphs(v, e, q, 24, plan=plan).select("qid", "shard_id", "doc_id", "rank", "visited")
    assert sorted(map(tuple, found.collect())) == want and len(want) == 120
    plans = found._jdf.queryExecution().executedPlan().toString()
    assert plans.count("PartitionFilters: [isnotnull(shard_id") + plans.count("PartitionFilters: [shard_id") >= 2
    from kestrelite.operators import graph_index, search

    old = graph_index.BLOCK, search.PLAN_ROWS
    try:
        graph_index.BLOCK, search.PLAN_ROWS = 2, 3
        assert sorted(map(tuple, search_graphs(v, e, q, 24, plan=plan).select("qid", "shard_id", "doc_id", "rank", "visited").collect())) == want
    finally:
        graph_index.BLOCK, search.PLAN_ROWS = old


def test_capped_traces_count_what_they_drop(spark, corpus):
    df = spark.createDataFrame([(i, 0, corpus[i].tolist()) for i in range(200)], "doc_id long, shard_id int, vector array<float>")
    edges, q = build_graphs(df, 24), [(1, corpus[300].tolist())]
    whole, cut = (search_graphs(df, edges, q, 24, traced=True, cap=cap).where("rank = 1").first() for cap in (0, 50))
    assert len(cut["node"]) == 50 and cut["dropped"] == len(whole["node"]) - 50 and whole["dropped"] == 0 and cut["doc_id"] == whole["doc_id"]
    assert cut["node"] == whole["node"][:50] and whole["offset"] == sorted(whole["offset"])


def test_a_walk_evaluates_a_part_of_clustered_vectors():
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((20, 64))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    draw = lambda n: (lambda x: (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32))(centres[rng.integers(0, 20, n)] + 0.3 * rng.standard_normal((n, 64)) / 8)
    x, queries = draw(2000), draw(60)
    g, visits, found = build(x, ef=100), [], 0
    for q in queries:
        trace = []
        hits = {r for _, r in g.search(q, 10, 100, trace)}
        visits.append(1 + sum(t[1] == VISIT for t in trace))
        found += len(hits & set(np.argsort(-(x @ q))[:10].tolist()))
    assert max(visits) < 1000 and np.mean(visits) < 650 and found / 600 >= 0.95


def test_replicas_have_graphs_of_their_own(spark, corpus):
    df = spark.createDataFrame([(i, 0, corpus[i].tolist()) for i in range(150)], "doc_id long, shard_id int, vector array<float>")
    a, b, c = (sorted(map(tuple, build_graphs(df, 24, replica=r).collect())) for r in ("shard-0a", "shard-0b", "shard-0a"))
    assert a == c and a != b
    assert projections(df, 24, "umap").count() == 150  # by its own method or, without that package, by the other
