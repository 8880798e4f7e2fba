import random

from pyspark.sql import functions as F

from kestrelite.operators.components import connected_components
from kestrelite.operators.ordered import sliced, with_lag, with_number, with_running
from kestrelite.operators.stream_views import first_at_or_above, grants_per_run


def data(seed=0, n=400):
    rng = random.Random(seed)
    return [(rng.choice(["hot", "hot", "b", None]), i, rng.choice([None, rng.randint(0, 50)])) for i in range(n)]


def test_running_values_equal_one_pass(spark):
    rows = data()
    df = spark.createDataFrame(rows, "k string, t long, v long").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as small slices would else become one
    s = sliced(df, ["k"], ["t"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert s.select("_slice").distinct().count() > 1
    out = with_lag(s, ["k"], ["t"], {"last": "v"})
    out = with_number(out, ["k"], ["t"], "number")
    out = with_running(out, ["k"], ["t"], "most", F.col("v"), "max")
    out = with_running(out, ["k"], ["t"], "total", F.coalesce("v", F.lit(0)), "sum")
    got = {r["t"]: (r["last"], r["number"], r["most"], r["total"]) for r in out.collect()}
    state = {}
    for k, t, v in rows:
        last, number, most, total = state.get(k, (None, 0, None, 0))
        now = (v, number + 1, max((x for x in (most, v) if x is not None), default=None), total + (v or 0))
        assert got[t] == (last, *now[1:])
        state[k] = now


def test_grants(spark):
    rng = random.Random(3)
    rows, t = [], 0
    for _ in range(300):
        t += rng.choice([1, 5, 40, 300, 1200])
        rows.append((rng.choice("ab"), t))
    got = {r["k"]: (r["requests"], r["granted"]) for r in grants_per_run(spark.createDataFrame(rows, "k string, t long"), "k", "t", 3, 100).collect()}
    for key in "ab":
        held, granted, n = [], 0, 0
        for k, t in rows:
            if k == key:
                n += 1
                held = [x for x in held if t - x <= 100]
                if len(held) < 3:
                    held.append(t)
                    granted += 1
        assert got[key] == (n, granted)


def test_first_at_or_above(spark):
    left = spark.createDataFrame([(1, 5), (2, 10), (3, 11), (4, 99)], "l long, v long")
    right = spark.createDataFrame([(7, 10), (8, 10), (9, 50)], "r long, b long")
    assert {(x["l"], x["r"]) for x in first_at_or_above(left, "l", "v", right, "r", "b").collect()} == {(1, 7), (2, 7), (3, 9)}


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(5, 5), (None, 3), (1, None)] + [(500, i) for i in range(501, 600)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            parent[find(a)] = find(b)
    groups = {}
    for x in list(parent):
        groups.setdefault(find(x), []).append(x)
    assert got == {x: min(g) for g in groups.values() for x in g}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
