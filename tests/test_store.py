import numpy as np
import pytest

from kestrelite.operators.embed import hash_embedding
from kestrelite.plans.ingest import ingest, open_store
from kestrelite.plans.query import run_queries
from kestrelite.plans.settings import Settings
from pyspark.sql import functions as F

RAW = "id string, title string, abstract string, categories string"


def raw(spark, n=120):
    rows = [(f"p{i}", f" Title  {i}", f"abstract {i} " + "word " * 30, ["cs.LG x", "math.CO", "hep-th"][i % 3]) for i in range(n)]
    return spark.createDataFrame(rows + [("short", "t", "too short", "cs.LG"), (None, "t", "a" * 200, "cs.LG"), ("p1", " Title  1", "abstract 1 " + "word " * 30, "math.CO")], RAW)


@pytest.mark.parametrize("partitioning,index", [("semantic", "hnsw"), ("hash", "bruteforce")])
def test_store_end_to_end(spark, tmp_path, partitioning, index):
    store = f"file://{tmp_path}/store"
    with pytest.raises(FileNotFoundError):
        open_store(spark, store)
    meta = ingest(raw(spark), store, Settings(16, 3, 1, partitioning, index))
    assert meta["docs"] == 120 and sum(meta["sizes"].values()) == 120 and open_store(spark, store)["digest"] == meta["digest"]
    if partitioning == "semantic":
        assert max(meta["sizes"].values()) <= 52
    texts = ["Title 3 " + "abstract 3 " + ("word " * 30).strip(), " ", "anything else"]
    q = spark.createDataFrame(list(enumerate(texts)), "qid long, text string")
    out = run_queries(spark, store, q)
    assert [r["qid"] for r in out["rejected"].collect()] == [1]
    hits = out["hits"].orderBy("qid", "rank").collect()
    assert hits[0]["title"] == "Title 3" and hits[0]["score"] == pytest.approx(1, abs=1e-5) and len(hits) == 20
    docs = spark.read.parquet(f"{store}/shards/data").collect()
    v = np.array(spark.createDataFrame([(texts[2],)], "t string").select(hash_embedding(16)(F.col("t"))).first()[0])
    want = sorted(docs, key=lambda d: -float(np.dot(d["vector"], v)))[:10]
    assert {h["doc_id"] for h in hits if h["qid"] == 2} == {d["doc_id"] for d in want}
    part = run_queries(spark, store, q, probe=2, down=[0])
    for r in part["coverage"].collect():
        assert r["probed"] == 2 and r["answered"] == 2 - (r["missing_shards"] == "0")
    assert all(h["shard_id"] != 0 for h in part["hits"].collect())
    spark.read.parquet(f"{store}/cache/model=hash-16").count() == 120


def test_a_large_batch_is_searched_by_graph(spark, tmp_path, monkeypatch):
    store = f"file://{tmp_path}/store"
    ingest(raw(spark), store, Settings(16, 3, 1, "hash", "hnsw"))
    q = spark.createDataFrame([(i, f"Title {i} and more") for i in range(7)], "qid long, text string")
    one = sorted(map(str, run_queries(spark, store, q, k=3, ef=5)["hits"].collect()))
    monkeypatch.setattr("kestrelite.operators.graph_index.BLOCK", 3)
    monkeypatch.setattr("kestrelite.plans.index.shard_hits", None)
    assert sorted(map(str, run_queries(spark, store, q, k=3, ef=5)["hits"].collect())) == one and len(one) == 21


def test_probed_store_reads_probed_shards_and_routing_falls_back(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    meta = ingest(raw(spark), store, Settings(16, 3, 1, "semantic", "bruteforce"))
    assert meta["cap"] == 52 and meta["shards"] == 3 and meta["iterations"] > 0 and meta["spilled"] >= 0
    from kestrelite.plans.ingest import store_centroids

    assert len(store_centroids(spark, store, meta)) == 3
    ids = spark.read.parquet(f"{store}/ids").collect()
    for s in range(3):
        assert sorted(r["seq"] for r in ids if r["shard_id"] == s) == list(range(1, meta["sizes"][str(s)] + 1))
    q = spark.createDataFrame([(1, "Title 7")], "qid long, text string")
    out = run_queries(spark, store, q, probe=1)
    assert len({r["shard_id"] for r in out["hits"].collect()}) == 1 and out["coverage"].first()["probed"] == 1
    spark.createDataFrame([(0, [1.0] * 16)], "shard_id int, centroid array<double>").write.mode("overwrite").parquet(f"{store}/centroids")
    assert store_centroids(spark, store, meta) == []  # of another number: every shard in order
    assert {r["shard_id"] for r in run_queries(spark, store, q, probe=2)["hits"].collect()} == {0, 1}


def test_hash_store_removes_old_centroids_and_graphs_are_sealed(spark, tmp_path):
    import os

    from kestrelite.operators.graph_index import check_graph
    from kestrelite.sources.sealed import read_sealed

    os.makedirs(f"{tmp_path}/store/centroids")
    store = f"file://{tmp_path}/store"
    ingest(raw(spark, 60), store, Settings(8, 2, 1, "hash", "hnsw"))
    assert not os.path.exists(f"{tmp_path}/store/centroids")
    edges, v = read_sealed(spark, f"{store}/edges", "shard_id"), spark.read.parquet(f"{store}/shards/data")
    check_graph(edges, v, 8, 16)
    bad = {
        "links to row": edges.withColumn("neighbours", F.array(F.lit(9999))), "too many links": edges.withColumn("neighbours", F.when(F.col("layer") == 0, F.array_repeat(F.lit(0), 40)).otherwise(F.col("neighbours"))),
        "disagree": edges.where("NOT (layer = 0 AND row = 3 AND shard_id = 0)").withColumn("neighbours", F.array().cast("array<int>")),
    }
    for message, broken in bad.items():
        with pytest.raises(ValueError, match=message):
            check_graph(broken, v, 8, 16)
    with pytest.raises(ValueError, match="another length"):
        check_graph(edges, v, 9)


def test_recording_bench_and_command_line(spark, tmp_path, capsys):
    import json

    from kestrelite.__main__ import main
    from kestrelite.plans.record import load_inspector
    from kestrelite.sources.files import read_results

    store = f"file://{tmp_path}/store"
    ingest(raw(spark, 90), store, Settings(16, 3, 1, "hash", "hnsw"))
    texts = ["Title 3", "anything else"]
    for out in ("a", "b"):
        main(["record", store, f"{tmp_path}/{out}", *texts, "--down", "1"])
    told = spark.read.json(f"{tmp_path}/a/results").collect()
    assert sorted((r["qid"], r["chapter"], r["answered"], r["missing_shards"]) for r in told) == [(0, 0, 3, ""), (0, 1, 2, "1"), (1, 0, 3, ""), (1, 1, 2, "1")]
    a, b = (sorted(map(str, spark.read.json(f"{tmp_path}/{x}/digest").collect())) for x in ("a", "b"))
    assert a == b and len(a) == 4 + 6
    walk = load_inspector(spark, f"{tmp_path}/a", 0)
    assert {r["shard_id"] for r in walk["walks"].collect()} == {0, 1, 2} and walk["projections"].count() == 90
    assert spark.read.json(f"{tmp_path}/a/spans").count() == 4 * 6
    with pytest.raises(SystemExit) as end:
        main(["bench", store, "--out", f"{tmp_path}/bench"])
    rows = read_results(spark, f"{tmp_path}/bench").collect()
    assert end.value.code == 0 and {(r["probe"], r["ef"]) for r in rows} == {(p, ef) for p in (0, 1) for ef in (10, 50, 100, 200)}
    maps = f"{tmp_path}/maps"
    spark.createDataFrame([(4, 0, "a", None), (4, 1, "b", "c")], "epoch long, shard_id int, primary_node string, backup_node string").write.parquet(maps)
    for args, code in ((["add", maps, "0", "z"], 0), (["remove", maps, "1", "b"], 1)):
        with pytest.raises(SystemExit) as end:
            main(["node", *args])
        assert end.value.code == code
    newest = {(r["shard_id"], r["backup_node"]) for r in spark.read.parquet(maps).where("epoch = 5").collect()}
    assert newest == {(0, "z"), (1, "c")} and spark.read.parquet(maps).where("epoch > 5").count() == 0
    assert json.loads([x for x in capsys.readouterr().out.splitlines() if '"verb"' in x][-1])["ok"] is False


def test_encoders(spark):
    from dataclasses import dataclass

    from kestrelite.operators.embed import embedding

    @dataclass
    class Lengths:
        dim: int
        name: str = "lengths"

        def encode(self, texts):
            return np.array([[len(t) + 1.0, 1.0] for t in texts])

    df = spark.createDataFrame([("abc",), (None,), ("abc",)], "t string")
    v = [r[0] for r in df.select(embedding(Lengths(2), batch=2)(F.col("t"))).collect()]
    assert v[0] == v[2] and v[0] == pytest.approx([4 / 17**0.5, 1 / 17**0.5]) and v[1] == pytest.approx([0.5**0.5] * 2)
    with pytest.raises(Exception, match="not of length 3"):
        df.select(embedding(Lengths(3))(F.col("t"))).collect()
