"""Control-plane operators against hand-made cases."""

import pytest

from kestrelite.operators import control

SAMPLE = "t double, ok boolean, answered long, probed long, missing array<int>, latency_ms double"


def samples(spark, rows):
    return spark.createDataFrame(rows, SAMPLE)


def good(t, ms=10.0):
    return (t, True, 2, 2, [], ms)


def report(spark, rows, **kw):
    return control.failover_report(samples(spark, rows), 5.0, 2, **kw).first()


def test_failover_that_recovers(spark):
    rows = [good(i / 10) for i in range(50)] + [(5.0 + i / 10, True, 1, 2, [1], 30.0) for i in range(20)] + [good(7 + i / 10, 12.0) for i in range(50)]
    r = report(spark, rows)
    assert (r["failed"], r["degraded"], r["before_p99"], r["tail_p99"], r["passed"]) == (0, 20, 10.0, 12.0, True) and r["recovery_s"] == pytest.approx(1.9)
    assert not report(spark, rows, recovers=False)["passed"]
    assert report(spark, [good(i / 10) for i in range(120)], recovers=False)["passed"]


@pytest.mark.parametrize(
    "bad,name",
    [((6.0, False, 0, 0, [], 1.0), "failed"), ((6.0, True, 1, 1, [], 1.0), "misprobed"), ((6.0, True, 3, 2, [], 1.0), "impossible"), ((6.0, True, 1, 2, [], 1.0), "unnamed"), ((6.0, True, 2, 2, [0], 1.0), "contradicted")],
)
def test_coverage_has_to_be_exact(spark, bad, name):
    r = report(spark, [good(i / 10) for i in range(120)] + [bad])
    assert r[name] == 1 and not r["passed"]


def test_slow_tail_late_recovery_and_no_samples(spark):
    base = [good(i / 10) for i in range(120)]
    assert not report(spark, base + [(11.0, True, 1, 2, [1], 10.0)])["passed"]  # six seconds after the fault
    assert not report(spark, base + [good(11.9, 900.0)] * 3)["passed"]
    assert not report(spark, [])["passed"]


def test_the_element_of_a_share(spark):
    for n in (1, 7, 100, 250):
        df = spark.createDataFrame([(float(v % 37),) for v in range(n)], "v double")
        want = sorted(float(v % 37) for v in range(n))
        assert [r["v"] for r in control.element_at_share(df, "v", 990).collect()] == [want[min(n - 1, int(n * 0.99))]]


def test_quorum_needs_the_current_term(spark):
    match = spark.createDataFrame([("a", 5), ("a", 4), ("a", 2), ("b", 3), ("b", 3), ("b", 0), ("c", 9), ("c", 1)], "g string, match_index long")
    log = [("a", i, 1 if i < 4 else 2) for i in range(1, 6)] + [("b", i, 1 if i < 4 else 2) for i in range(1, 5)] + [("c", 1, 3)]
    got = {r["g"]: (r["majority_index"], r["commit_index"]) for r in control.quorum_commit(match, spark.createDataFrame(log, "g string, index long, term long"), "g").collect()}
    assert got == {"a": (4, 4), "b": (3, 0), "c": (1, 1)}  # b: what a majority has is of an earlier term


def test_audit_of_logs(spark):
    claims = spark.createDataFrame([("g", 1, "x"), ("g", 1, "x"), ("g", 2, "x"), ("g", 2, "y")], "g string, term long, member string")
    assert [(r["term"], r["leaders"]) for r in control.leader_conflicts(claims, "g").collect()] == [(2, 2)]
    rows = [("g", m, i + 1, t) for m, log in {"x": [1, 1, 2, 2], "y": [1, 1, 3, 2], "z": [1, 1, 3]}.items() for i, t in enumerate(log)]
    bad = control.log_mismatches(spark.createDataFrame(rows, "g string, member string, index long, term long"), "g").collect()
    assert [(r["a"], r["b"], r["diverged_at"], r["agreed_at"]) for r in bad] == [("x", "y", 3, 4)]
    entries = spark.createDataFrame([("g", "x", 1, 1, 7), ("g", "y", 1, 1, 7), ("g", "x", 2, 1, 8), ("g", "y", 2, 2, 8)], "g string, member string, index long, term long, epoch long")
    assert [r["index"] for r in control.commit_conflicts(entries, "g").collect()] == [2]


def test_a_stale_leader_does_not_lead(spark):
    rows = [("g", "a", "leader", 4, 10.0), ("g", "b", "leader", 5, 12.0), ("g", "b", "follower", 4, 11.0), ("g", "c", "leader", 9, 1.0)]
    got = {r["member"]: (r["down"], r["leads"]) for r in control.member_panel(spark.createDataFrame(rows, "g string, member string, role string, term long, seen double"), "g", 2.5).collect()}
    assert got == {"a": (False, False), "b": (False, True), "c": (True, False)}


def test_levels_and_overhead(spark):
    rows = [("n", "TRACE_NONE", 1, 2, 3, 4, 10), ("s", "TRACE_SPANS", 1, None, 3, 4, 10), ("f", "TRACE_FULL", 1, 2, 3, 4, 10), ("u", "OTHER", 1, 2, 3, 4, 10)]
    df = spark.createDataFrame([(i, lv, {"embed_us": e, "plan_us": p, "fanout_us": f, "merge_us": m, "total_us": t}) for i, lv, e, p, f, m, t in rows], "trace_id string, level string, timings struct<embed_us:long,plan_us:long,fanout_us:long,merge_us:long,total_us:long>")
    got = {(r["trace_id"], r["kind"]): (r["t_start_us"], r["t_end_us"]) for r in control.stage_spans(df).collect()}
    assert {i for i, _ in got} == {"s", "f"} and got["f", "SPAN_MERGE"] == (6, 10) and got["s", "SPAN_PLAN"] == (1, 1) and len(got) == 12
    over = spark.createDataFrame([("TRACE_NONE", 100.0), ("TRACE_NONE", 200.0), ("TRACE_FULL", 300.0), ("TRACE_FULL", None)], "level string, us double")
    assert {r["level"]: (r["n"], r["p50_us"], r["over_percent"]) for r in control.overhead_by_level(over).collect()} == {"TRACE_NONE": (2, 150.0, 0.0), "TRACE_FULL": (1, 300.0, 100.0)}


def test_publishing_and_live_frames(spark):
    events = spark.createDataFrame([("a", t * 1_000_000) for t in range(120)] + [("b", 5)], "node string, t long")
    b = control.publish_batches(events, "node", "t", ["t"], most=30, flush_ms=50)
    assert sorted((r["node"], r["window"], r["batch"], r["count"]) for r in b.groupBy("node", "window", "batch").count().collect()) == [("a", 0, 0, 30), ("a", 0, 1, 20), ("a", 1, 0, 30), ("a", 1, 1, 20), ("a", 2, 0, 20), ("b", 0, 0, 1)]
    batches = spark.createDataFrame([(t, "spans" if t % 2 else "metrics", 2) for t in range(10)] + [(40, "spans", 7)], "at long, topic string, events long")
    got = sorted(tuple(r) for r in control.live_frames(batches, "at", ["at", "topic"], 33, 4).collect())
    assert got == [(0, "meta", 0, 6), (0, "metrics", 4, 0), (0, "spans", 4, 0), (1, "spans", 7, 0)]


def test_a_full_ring_drops_the_newest(spark):
    events = spark.createDataFrame([("a", t * 1_000_000) for t in range(70)] + [("b", 1)], "node string, t long")
    got = {r["node"]: (r["kept"], r["dropped"]) for r in control.ring_drops(events, "node", "t", ["t"], 9, 50).collect()}
    assert got == {"a": (32, 38), "b": (1, 0)}  # nine become sixteen; two windows


def test_progress_and_nodes(spark):
    rows = spark.createDataFrame([(s, i) for s, n in ((1, 5), (2, 4)) for i in range(n)], "shard int, id long")
    assert sorted(tuple(r) for r in control.build_progress(rows, "shard", ["id"], 2).collect()) == [(1, 2, 5), (1, 4, 5), (1, 5, 5), (2, 2, 4), (2, 4, 4)]
    e = spark.createDataFrame([("a", 1, "NODE_STATE_LOADING", None), ("a", 2, None, "NODE_STATE_SERVING"), ("b", 1, None, "NODE_STATE_SERVING"), ("b", 2, "NODE_STATE_LOADING", None), ("c", 1, None, None)], "node string, at long, stats_state string, to_state string")
    got = {r["node"]: (r["state"], r["building"]) for r in control.live_nodes(e, "node", ["at"]).collect()}
    assert got == {"a": ("NODE_STATE_SERVING", False), "b": ("NODE_STATE_LOADING", True), "c": (None, False)}


@pytest.mark.parametrize("now,want", [([(1, 1), (2, 1), (3, 2)], (2, 0, 1, False)), ([(1, 1), (2, 2)], (1, 1, 1, True)), ([(1, 1)], (1, 1, 0, True)), ([(1, 1), (2, 1)], (2, 0, 0, False))])
def test_what_a_log_has_to_write(spark, now, want):
    log = lambda rows: spark.createDataFrame([(i, t, f"e{i}{t}") for i, t in rows], "index long, term long, entry string")
    assert tuple(control.log_change(log([(1, 1), (2, 1)]), log(now)).first()) == want
