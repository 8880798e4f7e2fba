"""Streams of several files in several batches: state goes on, late rows are left out, closed windows are told once."""

import datetime
import random

import pytest

from kestrelite.operators.membership import health_states
from kestrelite.streaming.pipelines import (
    GAP_STATE, GAPS, HEALTH, HEALTH_STATE, gap_fold, health_fold, run_append, run_complete, run_fan_out, run_folded, sessions, stream_table, topic_counts, tumbling_means,
)

T0 = datetime.datetime(2026, 3, 1)


def at(minutes):
    return T0 + datetime.timedelta(minutes=minutes)


def files(spark, tmp_path, parts, schema):
    """A table of one file a part, read in that order, a file a batch."""
    import os
    import time

    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/t.parquet")
        for name in os.listdir(f"{tmp_path}/t.parquet"):
            path = f"{tmp_path}/t.parquet/{name}"
            if os.path.getmtime(path) > time.time() - 60:  # files are taken by age: the first parts are the oldest
                os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    return stream_table(spark, str(tmp_path), "t", files=1)


def test_windows_close_once_and_leave_late_rows_out(spark, tmp_path):
    parts = [
        [(at(1), "a", 1.0), (at(30), "a", 3.0), (at(59), "b", 5.0)],
        [(at(130), "a", 7.0)],  # the watermark goes to 120: the first hour is closed
        [(at(131), "b", 1.0)],
        [(at(10), "a", 100.0), (at(125), "a", 9.0)],  # too late; in time
        [(at(300), "z", 0.0)],
    ]
    s = files(spark, tmp_path, parts, "ts timestamp_ntz, kind string, value double")
    got = sorted(tuple(r) for r in run_append(tumbling_means(s, "ts", "kind", "value", "1 hour", "10 minutes"), "t").collect())
    assert got == [(at(0), "a", 2, 2.0), (at(0), "b", 1, 5.0), (at(120), "a", 2, 8.0), (at(120), "b", 1, 1.0)]


def test_sessions_go_on_over_batches(spark, tmp_path):
    parts = [[(at(0), 1), (at(20), 1)], [(at(45), 1), (at(5), 2)], [(at(200), 2)], [(at(300), 3)]]
    s = files(spark, tmp_path, parts, "ts timestamp_ntz, user long")
    got = sorted(tuple(r) for r in run_append(sessions(s, "ts", "user", "30 minutes", "10 minutes"), "t").collect())
    assert got == [(1, at(0), 3), (2, at(5), 1), (2, at(200), 1)]


@pytest.mark.parametrize("batches", [1, 4])
def test_health_is_that_of_one_pass(spark, tmp_path, batches):
    rng = random.Random(batches)
    rows = [(rng.choice([1, 2, 2, 2]), t, t, rng.random() < 0.4) for t in range(200)]
    schema = "node long, ts long, event_id long, alive boolean"
    step = -(-len(rows) // batches)
    s = files(spark, tmp_path, [rows[i : i + step] for i in range(0, len(rows), step)] + [[(9, 999, 999, True)]], schema)
    got = {(r["event_id"], r["misses"], r["state"]) for r in run_folded(s, health_fold, HEALTH_STATE, HEALTH, "t").collect()}
    want = health_states(spark.createDataFrame([*rows, (9, 999, 999, True)], schema), "node", ["ts", "event_id"], "alive").collect()
    assert got == {(r["event_id"], r["misses"], r["state"]) for r in want}


def test_gaps_over_batches(spark, tmp_path):
    schema = "node_id string, batch_id long, t_mono_ns long, seq long"
    parts = [[(" A", 1, 1, 1), ("a", 1, 2, 2), ("b", 1, 1, 5)], [("A ", 2, 3, 6)], [("b", 3, 9, 1), ("a", 3, 4, 7), ("a", 3, 5, 9), ("c", 3, 1, None)], [("b", 4, 10, 3)]]
    got = sorted(tuple(r) for r in run_folded(files(spark, tmp_path, parts, schema), gap_fold, GAP_STATE, GAPS, "t").collect())
    assert got == [("a", 6, 3), ("a", 9, 1), ("b", 3, 1)]


def test_topics_and_subscribers(spark, tmp_path):
    schema = "node_id string, seq long, span struct<kind:string>, stats struct<n:long>"
    parts = [[("a", 1, ("K",), None), ("a", 2, None, (1,))], [("a", 3, None, None), ("b", 1, ("K",), None)]]
    s = files(spark, tmp_path, parts, schema)
    assert {(r["topic"], r["n"]) for r in run_complete(topic_counts(s), "t").collect()} == {("spans", 2), ("metrics", 1), ("cluster", 1)}
    sent = run_fan_out(s, ["spans", "cluster", "weather"], "f")
    assert {t: sorted((r["node_id"], r["seq"]) for r in df.collect()) for t, df in sent.items()} == {"spans": [("a", 1), ("b", 1)], "cluster": [("a", 3)], "weather": []}


def test_stream_of_one_file(spark):
    from tests.compare import DATA

    s = stream_table(spark, DATA, "events").select("event_id")
    assert run_append(s, "copy").count() == spark.read.parquet(f"{DATA}/events.parquet").count()
