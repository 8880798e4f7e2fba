import random

import numpy as np
import pytest

from kestrelite.functions.vectors import dot, norm, normalised
from kestrelite.operators import search
from kestrelite.operators.embed import hash_embedding
from kestrelite.operators.search import coverage, merge_top_k, per_shard_top_k, plan_probes, shard_hits
from pyspark.sql import functions as F

FIVE = [(10, [1.0, 0.0, 0.0, 0.0]), (20, [0.0, 1.0, 0.0, 0.0]), (30, [0.0, 0.0, 1.0, 0.0]), (40, [0.0, 0.0, 0.0, 1.0]), (50, [0.7071, 0.7071, 0.0, 0.0])]


def vectors(spark, rows, shards=1):
    return spark.createDataFrame([(i, i % shards, v) for i, v in rows], "doc_id long, shard_id int, vector array<double>")


def test_five_documents(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0])], "qid long, vector array<double>")
    hits = merge_top_k(shard_hits(vectors(spark, FIVE), q, 3, 4), 3).orderBy("rank").collect()
    assert [(r["doc_id"], round(r["score"], 4)) for r in hits] == [(10, 1.0), (50, 0.7071), (20, 0.0)]


@pytest.mark.parametrize("block", [4096, 3])
def test_merge_of_shards_is_the_global_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(search, "BLOCK", block)
    rng = np.random.default_rng(0)
    rows = [(i, rng.integers(-2, 3, 6).astype(float).tolist()) for i in range(300)]  # many ties
    qs = [(q, rng.integers(-2, 3, 6).astype(float).tolist()) for q in range(8)]
    q = spark.createDataFrame(qs, "qid long, vector array<double>")
    got = merge_top_k(per_shard_top_k(shard_hits(vectors(spark, rows, 5), q, 7, 6), 7).drop("rank"), 7).collect()
    for qid, qv in qs:
        want = sorted(rows, key=lambda r: (-float(np.dot(r[1], qv)), r[0]))[:7]
        assert [r["doc_id"] for r in sorted((r for r in got if r["qid"] == qid), key=lambda r: r["rank"])] == [i for i, _ in want]


def test_unusable_vectors_and_empty(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "qid long, vector array<double>")
    v = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, None), (3, 0, [1.0])], "doc_id long, shard_id int, vector array<double>")
    assert [(r["qid"], r["doc_id"]) for r in shard_hits(v, q, 5, 2).collect()] == [(1, 1)]
    assert shard_hits(v.limit(0), q, 5, 2).count() == 0 and shard_hits(v, q.limit(0), 5, 2).count() == 0


def test_probing_and_coverage(spark):
    scored = spark.createDataFrame([(1, s, c) for s, c in enumerate([0.5, 0.9, 0.9, 0.1])], "qid long, shard_id int, cscore double")
    plan = plan_probes(scored, 2)
    assert {r["shard_id"] for r in plan.where("probed").collect()} == {1, 2}
    down = spark.createDataFrame([(2, False)], "shard_id int, answers boolean")
    r = coverage(plan, down).first()
    assert (r["probed"], r["answered"], r["missing_shards"], r["unprobed_shards"]) == (2, 1, "2", "0,3")
    assert plan_probes(scored, 0).where("probed").count() == 4


def test_top_k_plan_limits_before_the_shuffle(spark):
    hits = spark.createDataFrame([(1, 0, i, random.random()) for i in range(50)], "qid long, shard_id int, doc_id long, score double")
    plan = merge_top_k(hits, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_vector_columns(spark):
    r = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>").select(dot(F.col("a"), F.col("b")), norm(F.col("a")), normalised(F.col("a")), normalised(F.col("z"))).first()
    assert (r[0], r[1], list(r[2]), list(r[3])) == (11.0, 5.0, [0.6, 0.8], [0.0, 0.0])


def test_embedding_is_deterministic(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "t string")
    v = [np.array(r[0]) for r in df.select(hash_embedding(8)(F.col("t"))).collect()]
    assert (v[0] == v[1]).all() and not (v[0] == v[3]).all() and all(abs(np.linalg.norm(x) - 1) < 1e-6 for x in v)


@pytest.mark.parametrize("block", [4096, 3])
def test_routed_search_meets_and_reads_the_plan_only(spark, monkeypatch, tmp_path, block):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(300)]
    vectors(spark, rows, 8).write.partitionBy("shard_id").parquet(f"{tmp_path}/v")
    v = spark.read.parquet(f"{tmp_path}/v")
    qs = [(q, rng.standard_normal(6).tolist()) for q in range(7)]
    q = spark.createDataFrame(qs, "qid long, vector array<double>")
    plan = spark.createDataFrame([(q, s) for q in range(7) for s in (3, 5 + q % 2)], "qid long, shard_id int")
    monkeypatch.setattr(search, "BLOCK", block)
    monkeypatch.setattr(search, "CHUNK", 20)
    hits = shard_hits(v, q, 4, 6, plan)
    got = {(r["qid"], r["shard_id"], r["doc_id"]) for r in per_shard_top_k(hits, 4).collect()}
    want = set()
    for qid, qv in qs:
        for s in (3, 5 + qid % 2):
            want |= {(qid, s, i) for i, _ in sorted((r for r in rows if r[0] % 8 == s), key=lambda r: (-float(np.dot(r[1], qv)), r[0]))[:4]}
    assert got == want
    if block > 7:
        scan = hits._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in scan and "shard_id" in scan.split("PartitionFilters: [")[1].split("]")[0]
        assert {f.split("shard_id=")[1].split("/")[0] for f in hits.inputFiles()} >= {"3", "5", "6"}


@pytest.mark.parametrize("block", [4096, 2])
def test_a_route_is_the_plan_that_its_centroids_give(spark, monkeypatch, block):
    rng = np.random.default_rng(4)
    v = vectors(spark, [(i, rng.standard_normal(6).tolist()) for i in range(120)], 5)
    q = spark.createDataFrame([(i, rng.standard_normal(6).tolist()) for i in range(6)], "qid long, vector array<double>")
    centroids = [(s, rng.standard_normal(6).tolist()) for s in range(4)] + [(4, [0.0] * 6)]
    plan = search.score_shards(q, centroids, 6, best=2).select("qid", "shard_id")
    want = sorted(map(tuple, per_shard_top_k(shard_hits(v, q, 3, 6, plan), 3).collect()))
    monkeypatch.setattr(search, "BLOCK", block)
    assert sorted(map(tuple, per_shard_top_k(shard_hits(v, q, 3, 6, search.Route(centroids, 2)), 3).collect())) == want and len(want) == 36


def test_shards_by_centroid(spark):
    q = spark.createDataFrame([(1, "x", [1.0, 0.0]), (2, None, [0.0, 1.0]), (3, "y", None)], "qid long, shard string, vector array<double>")
    centroids = [(7, [1.0, 0.0]), (2, [0.0, 1.0]), (4, [0.0, 1.0])]
    got = sorted(tuple(r) for r in search.score_shards(q, centroids, 2, best=2).select("qid", "shard_id", "position", "cscore").collect())
    assert got == [(1, 2, 2, 0.0), (1, 7, 1, 1.0), (2, 2, 1, 1.0), (2, 4, 2, 1.0)]
    assert search.score_shards(q, centroids, 2).count() == 6 and search.score_shards(q, [], 2).count() == 0


def test_recall_of_a_setting_that_finds_nothing(spark):
    truth = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "qid long, doc_id long")
    got = spark.createDataFrame([(1, 1, 10), (2, 1, 99)], "probe int, qid long, doc_id long")
    settings = spark.createDataFrame([(1,), (2,), (3,)], "probe int")
    r = {x["probe"]: (x["found"], x["recall"]) for x in search.recall_at_k(got, truth, 2, ["probe"], settings).collect()}
    assert r == {1: (1, 0.25), 2: (0, 0.0), 3: (0, 0.0)}
    of_truth = {x["probe"]: x["recall"] for x in search.recall_at_k(got, truth, 2, ["probe"], of_truth=True).collect()}
    assert of_truth[1] == pytest.approx(1 / 3, abs=1e-6)


def test_guards_in_order(spark):
    rows = [(1, 0, "SERVING", 10, 4, 5), (2, 0, "SERVING", 10, 4, 4), (3, 0, "SERVING", 0, 4, 9), (4, 0, "SERVING", 10, 3, 9), (5, 0, "SERVING", 10, 4, 5), (6, 1, "LOADING", 0, 4, 1)]
    df = spark.createDataFrame(rows, "qid long, shard_id int, state string, k int, dim int, epoch long")
    got = [(r["status"], r["reason"]) for r in search.guarded(df, 4, ["qid"]).orderBy("qid").collect()]
    assert [g[0] for g in got] == ["OK", "FAILED_PRECONDITION", "INVALID_ARGUMENT", "INVALID_ARGUMENT", "OK", "FAILED_PRECONDITION"]
    assert got[1][1].startswith("stale") and got[5][1] == "shard not SERVING" and got[0][1] is None
