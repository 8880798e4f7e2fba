import random

from kestrelite.operators.membership import apply_commands, fold_failovers, health_states, replay_cas


def test_health_and_failover_equal_one_pass(spark):
    rng = random.Random(0)
    rows = [(rng.choice([0, 1]), t, t, rng.random() < 0.45) for t in range(400)]
    out = health_states(spark.createDataFrame(rows, "node long, ts long, event_id long, alive boolean"), "node", ["ts", "event_id"], "alive")
    got = {r["event_id"]: (r["misses"], r["state"], r["before"], r["ever_healthy"]) for r in out.collect()}
    miss, state, ever = {0: 0, 1: 0}, {0: "HEALTHY", 1: "HEALTHY"}, {0: False, 1: False}
    a_first, swaps, changes = True, 0, []
    for node, t, _, alive in rows:
        miss[node] = 0 if alive else miss[node] + 1
        ever[node] |= alive
        new = "DOWN" if miss[node] >= 5 else "SUSPECT" if miss[node] >= 2 else "HEALTHY"
        assert got[t] == (miss[node], new, state[node], ever[node])
        if new != state[node]:
            changes.append((7, t, node == 0, new, ever[node]))
            if new == "DOWN" and ever[node] and (node == 0) == a_first and state[1 - node] == "HEALTHY":
                a_first, swaps = not a_first, swaps + 1
            state[node] = new
    r = fold_failovers(spark.createDataFrame(changes, "shard_id long, at long, is_a boolean, state string, ever_healthy boolean")).first()
    assert (r["failovers"], r["epoch"], r["primary"]) == (swaps, swaps + 1, "a" if a_first else "b") and swaps > 0


def test_replay(spark):
    log = [("m", 1, 0, 1), ("m", 2, 0, 2), ("m", 3, 1, 5), ("m", 4, 1, 9), ("m", 5, 5, 6), ("n", 1, 3, 4)]
    got = {r["log"]: (r["entries"], r["applied"], r["value"]) for r in replay_cas(spark.createDataFrame(log, "log string, i long, e long, p long"), "log", "i", "e", "p", 0).collect()}
    assert got == {"m": (5, 3, 6), "n": (1, 0, 0)}


def test_commands(spark):
    m = spark.createDataFrame([(1, 0, "a", "b"), (1, 1, "c", None)], "epoch long, shard_id int, primary_node string, backup_node string")
    c = spark.createDataFrame([(1, 1, "add", "c"), (2, 1, "add", "d"), (3, 0, "add", "z"), (4, 0, "remove", "a"), (5, 0, "remove", "b"), (6, 0, "add", "z"), (7, 9, "add", "q")], "at long, shard_id int, verb string, node string")
    got = {r["at"]: (r["ok"], r["epoch"]) for r in apply_commands(m, c).collect()}
    assert got == {1: (False, 1), 2: (True, 2), 3: (False, 2), 4: (False, 2), 5: (True, 3), 6: (True, 4), 7: (False, 4)}


def test_folds_over_many_slices(spark):
    """One key has nearly all rows and is cut into slices; the fold is that of one pass."""
    rng = random.Random(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as small slices would else become one
    try:
        entries = [("hot" if rng.random() < 0.9 else "b", i, rng.randrange(4), rng.randrange(4)) for i in range(300)] + [("none", 1, None, 2)]
        value, applied = {"hot": 0, "b": 0, "none": 0}, {"hot": 0, "b": 0, "none": 0}
        for log, _, e, p in entries:
            if e == value[log]:
                value[log], applied[log] = p, applied[log] + 1
        got = replay_cas(spark.createDataFrame(entries, "log string, i long, e long, p long"), "log", "i", "e", "p", 0).collect()
        assert {r["log"]: (r["value"], r["applied"]) for r in got} == {k: (value[k], applied[k]) for k in value} and applied["hot"] > 20
        changes, state, first, swaps = [], {True: "HEALTHY", False: "HEALTHY"}, True, 0
        for i in range(300):
            is_a, new, ever = rng.random() < 0.5, rng.choice(["HEALTHY", "SUSPECT", "DOWN"]), rng.random() < 0.9
            changes.append((7, i, is_a, new, ever))
            if new == "DOWN" and ever and is_a == first and state[not is_a] == "HEALTHY":
                first, swaps = not first, swaps + 1
            state[is_a] = new
        r = fold_failovers(spark.createDataFrame(changes, "shard_id long, at long, is_a boolean, state string, ever_healthy boolean")).first()
        assert (r["failovers"], r["primary"]) == (swaps, "a" if first else "b") and swaps > 10
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
