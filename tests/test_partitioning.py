import math
import random

import numpy as np
import pytest

from kestrelite.operators.partitioning import balanced_assignment, kmeans, shard_labels


@pytest.mark.parametrize("seed", [0, 1])
def test_balanced_equals_serial_greedy(spark, seed):
    rng = random.Random(seed)
    k, n = 3, 41
    prefs = {i: rng.sample(range(k), k) if rng.random() < 0.4 else [0, 1, 2] for i in range(0, n * 5, 5)}
    got = {r["doc_id"]: (r["shard_id"], r["rank"]) for r in balanced_assignment(spark.createDataFrame(list(prefs.items()), "doc_id long, shards array<int>"), k).collect()}
    room, held = math.ceil(1.3 * n / k), [0] * k
    for i in sorted(prefs):
        rank, s = next((r, s) for r, s in enumerate(prefs[i]) if held[s] < room)
        held[s] += 1
        assert got[i] == (s, rank)


def test_kmeans_separates_blobs(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([c + 0.1 * rng.standard_normal((40, 4)) for c in np.eye(4)[:3] * 5])
    v = spark.createDataFrame([(i, x[i].tolist()) for i in range(len(x))], "doc_id long, vector array<double>")
    c = kmeans(v, 3, 4)
    assert sorted(c.argmax(1).tolist()) == [0, 1, 2] and np.abs(np.sort(c.max(1)) - 5).max() < 0.2
    assert (kmeans(v.repartition(5), 3, 4) == c).all() or np.abs(kmeans(v.repartition(5), 3, 4) - c).max() < 1e-9
    assert kmeans(v.limit(0), 3, 4).shape == (0, 4)


def test_labels_round_half_to_even(spark):
    rows = [(0, "a")] * 1 + [(0, "b")] * 1 + [(1, "b")] * 5 + [(1, "a")] * 3
    got = {r["s"]: (r["n"], r["label"]) for r in shard_labels(spark.createDataFrame(rows, "s int, b string"), "s", "b").collect()}
    assert got == {0: (2, "a.*(50%)"), 1: (8, "b.*(62%)")}
