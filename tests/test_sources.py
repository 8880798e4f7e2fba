import gzip
import json

import pytest
from pyspark.sql import functions as F

from kestrelite.plans.gates import recall_gates
from kestrelite.plans.settings import SettingsError, load_settings
from kestrelite.sources.files import longest_valid_prefix, merge_by_scheme, read_corpus, read_events, write_events
from kestrelite.sources.sealed import NotSealed, is_sealed, read_sealed, write_sealed


def test_sealed_table(spark, tmp_path):
    path = f"file://{tmp_path}/sealed"
    df = spark.createDataFrame([(i, i % 3) for i in range(30)], "doc_id long, shard_id int")
    with pytest.raises(NotSealed):
        read_sealed(spark, path, "shard_id")
    write_sealed(df, path, "shard_id")
    assert is_sealed(spark, path) and read_sealed(spark, path, "shard_id").count() == 30
    with pytest.raises(NotSealed):
        write_sealed(df, path, "shard_id")
    file = next((tmp_path / "sealed" / "data").rglob("*.parquet"))
    whole = file.read_bytes()
    file.write_bytes(whole[:50] + bytes([whole[50] ^ 1]) + whole[51:])
    for crc in file.parent.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(NotSealed):
        read_sealed(spark, path, "shard_id")
    file.unlink()
    with pytest.raises(NotSealed):
        read_sealed(spark, path, "shard_id")


def test_torn_corpus(spark, tmp_path):
    lines = [json.dumps({"id": str(i), "title": f"t{i}", "abstract": "a" * 500, "categories": "cs.LG math.CO"}) for i in range(4000)]
    whole = gzip.compress("\n".join(lines).encode(), 1)
    (tmp_path / "whole.jsonl.gz").write_bytes(whole)
    (tmp_path / "torn.jsonl.gz").write_bytes(whole[: len(whole) // 2])
    assert read_corpus(spark, f"{tmp_path}/whole.jsonl.gz").count() == 4000
    ids = [int(r["id"]) for r in read_corpus(spark, f"{tmp_path}/torn.jsonl.gz").collect()]
    assert 0 < len(ids) < 4000 and sorted(ids) == list(range(len(ids)))
    assert read_corpus(spark, f"{tmp_path}/whole.jsonl.gz", limit_bytes=1000).count() < 4000


def test_event_bundle(spark, tmp_path):
    rows = [{"nodeId": "a", "seq": "7", "tMonoNs": "9", "span": {"traceId": "ThuRC1WshEzLsrsHwXcsRA==", "kind": "K", "tStartNs": "1", "tEndNs": "2"}}, {"nodeId": "b", "seq": "1", "stats": {"rssBytes": "5"}}]
    (tmp_path / "e.ndjson").write_text("\n".join(["not json", "", *map(json.dumps, rows)]))
    got = {r["node_id"]: r for r in read_events(spark, f"{tmp_path}/e.ndjson").collect()}
    assert got["a"]["seq"] == 7 and got["a"]["span"]["shard_id"] == 0 and got["a"]["span"]["trace_id"] == "4e1b910b55ac844ccbb2bb07c1772c44"
    assert got["b"]["stats"]["rss_bytes"] == 5 and got["b"]["stats"]["doc_count"] == 0 and set(got) == {"a", "b"}
    write_events(read_events(spark, f"{tmp_path}/e.ndjson"), f"{tmp_path}/again")
    assert {r["node_id"]: r for r in read_events(spark, f"{tmp_path}/again").collect()} == got


def test_event_bundle_keeps_all_stats(spark, tmp_path):
    stats = {"rssBytes": "5", "docCount": "6", "qps1s": 2.5, "p50Us": "7", "p99Us": "8", "primarySeq": "9", "appliedSeq": "4", "state": "S", "edgeCount": "3"}
    (tmp_path / "e.ndjson").write_text("\n".join(json.dumps({"nodeId": n, "seq": "1", "stats": s}) for n, s in (("a", stats), ("b", {"rssBytes": "1"}))))
    write_events(read_events(spark, f"{tmp_path}/e.ndjson"), f"{tmp_path}/again")
    for path in ("e.ndjson", "again"):
        e = read_events(spark, f"{tmp_path}/{path}")
        assert e.select("stats.*").dtypes == [("rss_bytes", "bigint"), ("doc_count", "bigint"), ("qps_1s", "float"), ("p50_us", "bigint"), ("p99_us", "bigint"), ("primary_seq", "bigint"), ("applied_seq", "bigint"), ("state", "string"), ("edge_count", "bigint")]
        got = {r["node_id"]: tuple(r["stats"]) for r in e.collect()}
        assert got == {"a": (5, 6, 2.5, 7, 8, 9, 4, "S", 3), "b": (1, 0, 0.0, 0, 0, 0, 0, None, 0)}


def test_merge_prefix_gates_settings(spark):
    old = spark.createDataFrame([("hash", 1), ("semantic", 2)], "partitioning string, r int")
    assert sorted(map(tuple, merge_by_scheme(old, spark.createDataFrame([("hash", 9)], old.schema)).collect())) == [("hash", 9), ("semantic", 2)]
    log = spark.createDataFrame([(1, True), (2, True), (3, False), (4, True)], "i int, ok boolean")
    assert sorted(r["i"] for r in longest_valid_prefix(log, "i", "ok").collect()) == [1, 2]
    assert longest_valid_prefix(log.where("ok"), "i", "ok").count() == 3
    runs = spark.createDataFrame([(1, 0.5), (2, 0.47), (4, 0.96)], "probe int, recall double")
    assert [(r["probe"], r["monotone"], r["above_floor"]) for r in recall_gates(runs, "probe", "recall", 0.95).orderBy("probe").collect()] == [(1, True, True), (2, False, True), (4, True, True)]
    tree = {"model": {"dim": 64}, "cluster": {"shards": 4, "replicas": 2, "partitioning": "semantic"}, "index": {"type": "hnsw"}}
    assert load_settings(tree).ef_search == 100
    for path, value in (("cluster.replicas", 3), ("cluster.partitioning", "x"), ("model.dim", None), ("cluster.shards", True)):
        a, b = path.split(".")
        with pytest.raises(SettingsError, match=path):
            load_settings({**tree, a: {**tree[a], b: value}})


def test_unknown_fields_and_yaml(tmp_path):
    from kestrelite.plans.settings import read_settings

    tree = {"model": {"dim": 64, "name": "x"}, "cluster": {"shards": 4, "replicas": 2, "partitioning": "semantic"}, "index": {"type": "hnsw", "efsearch": 3}}
    with pytest.raises(SettingsError, match="index.efsearch: unknown"):
        load_settings(tree)
    with pytest.raises(SettingsError, match="cluster: 3 is no mapping"):
        load_settings({"cluster": 3})
    pytest.importorskip("yaml")
    (tmp_path / "s.yaml").write_text("model: {dim: 8}\ncluster:\n  shards: 2\n  replicas: 1\n  partitioning: hash\nindex:\n  type: bruteforce\n")
    assert read_settings(str(tmp_path / "s.yaml")).model_dim == 8
    with pytest.raises(SettingsError, match="none.yaml"):
        read_settings(str(tmp_path / "none.yaml"))


def test_results_merge_by_scheme(spark, tmp_path):
    from kestrelite.sources.files import read_results, write_results

    path = f"{tmp_path}/bench"
    assert read_results(spark, path) is None
    row = lambda scheme, recall: spark.createDataFrame([(scheme, 2, 0, 100, recall, 1.0, 0.5, 0.9)], "partitioning string, shards int, probe int, ef int, recall double, mean_visited double, p50_ms double, p99_ms double")
    for scheme, recall in (("hash", 0.5), ("semantic", 0.6), ("hash", 0.9)):
        write_results(row(scheme, recall), path)
    assert sorted((r["partitioning"], r["recall"]) for r in read_results(spark, path).collect()) == [("hash", 0.9), ("semantic", 0.6)]
    write_results(row("hash", 0.1), path, merge=False)
    assert [r["recall"] for r in read_results(spark, path).collect()] == [0.1]


def test_restored_logs_and_query_texts(spark, tmp_path):
    from kestrelite.sources.files import FALLBACK_TEXTS, read_query_texts, restore_log

    log = spark.createDataFrame([(1, True), (2, False), (3, True)], "i int, ok boolean")
    fresh = {"term": 0, "vote": ""}
    for state, want in (({"term": 4, "vote": "a"}, {"term": 4, "vote": "a"}), ({"term": 4}, fresh), (None, fresh)):
        entries, held = restore_log(log, "i", "ok", state, fresh)
        assert [r["i"] for r in entries.collect()] == [1] and held == want
    assert read_query_texts(spark, f"{tmp_path}/none").count() == len(FALLBACK_TEXTS)
    (tmp_path / "q.json").write_text('{"qid": 5, "text": "x"}\n{"qid": 6, "text": ""}\n')
    assert [r["text"] for r in read_query_texts(spark, f"{tmp_path}/q.json").collect()] == ["x"]


def test_heavy_shards_are_sealed_by_several_tasks(spark, tmp_path):
    path = f"file://{tmp_path}/sealed"
    write_sealed(spark.createDataFrame([(i, 0 if i % 10 else 1) for i in range(500)], "doc_id long, shard_id int"), path, "shard_id", records_per_file=50)
    files = list((tmp_path / "sealed" / "data" / "shard_id=0").glob("*.parquet"))
    assert len(files) >= 2 and read_sealed(spark, path, "shard_id").count() == 500


def test_addresses():
    from kestrelite.sources.filesystem import open_uri

    assert open_uri("file:/tmp/x")[1] == "/tmp/x" and open_uri("file:///tmp/x")[1] == "/tmp/x" and open_uri("/tmp/x")[1] == "/tmp/x"


def test_sweep_gates_and_series(spark):
    from kestrelite.plans.gates import recall_series, sweep_gates

    rows = [("semantic", 4, 0, 10, 0.8, 1.0), ("semantic", 4, 0, 100, 0.94, 2.0), ("semantic", 4, 0, 200, 0.9, 4.0), ("semantic", 4, 2, 100, 0.85, 1.5), ("hash", 4, 0, 100, 0.99, 3.0)]
    df = spark.createDataFrame(rows, "partitioning string, shards int, probe int, ef int, recall double, p99_ms double")
    got = {(r["gate"], r["partitioning"], r["ef"]): r["passed"] for r in sweep_gates(df, "some-model").collect()}
    assert got == {("floor", "semantic", 100): False, ("floor", "hash", 100): True, ("monotone", "semantic", 10): True, ("monotone", "semantic", 100): True, ("monotone", "semantic", 200): False, ("monotone", "hash", 100): True, ("half", "semantic", 0): False}
    assert not any(r["gate"] == "half" for r in sweep_gates(df, "hash").collect())
    assert [r["ef"] for r in recall_series(df).where("partitioning = 'semantic'").orderBy("place").collect()] == [10, 100, 100, 200]


def test_layouts(spark):
    from kestrelite.operators.graph_index import point_cloud, ring_layout

    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "n string")
    assert {r["n"]: (r["x"], r["y"]) for r in ring_layout(nodes, "n", 2.0).collect()} == {"a": (0.0, -2.0), "b": (2.0, 0.0), "c": (0.0, 2.0), "d": (-2.0, 0.0)}
    p = spark.createDataFrame([(0, 1, 5, 0.5, -1.0)], "shard_id int, row int, doc_id long, x float, y float")
    assert tuple(point_cloud(p).first()) == (0, 1, 3.0, 0.0, -6.0)
