import numpy as np

from kestrelite.llm.knn import nearest_neighbours

SCHEMA = "doc_id long, vector array<float>, list int, vec string, asks string"


def rows_of(ids, vectors):
    return [(int(i), None if v is None else [None if x is None else float(x) for x in v], 1, "a", "b") for i, v in zip(ids, vectors, strict=True)]


def brute(ids, x, k, least=None):
    x = x / np.linalg.norm(x, axis=1)[:, None]
    s = x @ x.T
    out = {}
    for i, a in enumerate(ids):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-round(s[i, j], 9), ids[j]))[:k]
        out[a] = [ids[j] for j in order if least is None or s[i, j] >= least]
    return out


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((8, 16))
    x = (centres[rng.integers(8, size=900)] + 0.4 * rng.standard_normal((900, 16))).astype(np.float32)
    ids = [int(i) * 3 - 500 for i in range(900)]
    df = spark.createDataFrame(rows_of(ids, x), SCHEMA)
    got = {}
    for r in nearest_neighbours(df, "doc_id", "vector", k=5, dim=16, list_size=100, probes=64, probe_ratio=0.2, replicas=2, queries="doc_id % 2 = 0").collect():
        got.setdefault(r["doc_id"], []).append((r["rank"], r["neighbour"]))
    want = brute(ids, x.astype(float), 5)
    assert set(got) == {i for i in ids if i % 2 == 0}
    assert np.mean([len({n for _, n in got[i]} & set(want[i])) / 5 for i in got]) >= 0.9
    assert all([r for r, _ in sorted(v)] == [1, 2, 3, 4, 5] for v in got.values())


def test_one_list_is_exact_and_chunks_change_nothing(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((150, 8)).astype(np.float32)
    ids = list(range(150))
    df = spark.createDataFrame(rows_of(ids, x), SCHEMA)
    want = brute(ids, x.astype(float), 4)
    for cell in (1000, 40):
        got = {}
        for r in nearest_neighbours(df, "doc_id", "vector", k=4, dim=8, list_size=1000, cell=cell).collect():
            got.setdefault(r["doc_id"], {})[r["rank"]] = r["neighbour"]
        assert {i: [g[k] for k in sorted(g)] for i, g in got.items()} == want


def test_copies_ties_and_unusable_vectors(spark):
    v, w = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = rows_of(range(9), [v] * 8 + [w]) + rows_of([20, 21, 22, 23, 24, 25], [None, [1.0], [0.0] * 3, [float("nan"), 0, 0], [float("inf"), 1, 1], [None, 1.0, 1.0]])
    rows += [(None, v, 1, "a", "b"), (0, v, 1, "a", "b")]
    got = {}
    for r in nearest_neighbours(spark.createDataFrame(rows, SCHEMA), "doc_id", "vector", k=2, dim=3, least=0.5).collect():
        got.setdefault(r["doc_id"], []).append((r["rank"], r["neighbour"], round(r["similarity"], 6)))
    assert set(got) == set(range(8))
    for i in range(8):
        first = [j for j in range(8) if j != i][:2]
        assert sorted(got[i]) == [(1, first[0], 1.0), (2, first[1], 1.0)]


def test_empty(spark):
    assert nearest_neighbours(spark.createDataFrame([], SCHEMA), "doc_id", "vector", dim=3).count() == 0


def test_long_lists_get_a_second_level(spark):
    """Few first-level lists, so that most are split: recall stays, all vectors are stored, and a tight hot spot is split too."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((30, 16))
    x = (centres[rng.integers(30, size=1500)] + 0.4 * rng.standard_normal((1500, 16))).astype(np.float32)
    x[:500] = (centres[0] + 0.05 * rng.standard_normal((500, 16))).astype(np.float32)
    ids = list(range(1500))
    df = spark.createDataFrame(rows_of(ids, x), SCHEMA)
    want = brute(ids, x.astype(float), 5)
    for given in ({}, {"queries": "doc_id % 3 = 0", "probes": 64, "probe_ratio": 0.3}):
        got = {}
        for r in nearest_neighbours(df, "doc_id", "vector", k=5, dim=16, list_size=40, sample_rows=128, replicas=3, ratio=0.15, split=120, cell=100, **given).collect():
            got.setdefault(r["doc_id"], set()).add(r["neighbour"])
        assert set(got) == {i for i in ids if not given or i % 3 == 0}
        assert np.mean([len(got[i] & set(want[i])) / 5 for i in got]) >= 0.9


def test_copies_are_spread_by_salt(spark, monkeypatch):
    monkeypatch.setattr("kestrelite.llm.knn.COPIES", 7)
    rows = rows_of(range(60), [[1.0, 0.0, 0.0]] * 50 + [[0.0, 1.0, 0.0]] * 10)
    got = {}
    for r in nearest_neighbours(spark.createDataFrame(rows, SCHEMA), "doc_id", "vector", k=3, dim=3, least=0.5).collect():
        got.setdefault(r["doc_id"], []).append((r["rank"], r["neighbour"]))
    for i in range(60):
        lo, hi = (0, 50) if i < 50 else (50, 60)
        assert [n for _, n in sorted(got[i])] == [j for j in range(lo, hi) if j != i][:3]
