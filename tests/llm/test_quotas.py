from kestrelite.llm.quotas import draw_samples, repair, target_report

DOCS = "doc_id long, category string, draw_id int, take string, bucket string"
TARGETS = "draw_id int, sample_percent int, category string, target_permille int, min_docs int"


def test_repair_meets_what_can_be_met():
    have = {"a": 500, "b": 300, "c": 5, "": 195}
    take = repair(have, {"a": (50, 0), "b": (40, 0), "c": (10, 10)}, 100, 1)
    assert take["c"] == 5 and take["a"] == 50 and take["b"] == 40 and sum(take.values()) == 100
    assert repair({}, {"a": (5, 2)}, 10, 0) == {}
    assert sum(repair({"a": 3, "b": 3}, {"a": (3, 3), "b": (3, 3)}, 4, 0).values()) == 4


def test_samples(spark):
    rows = [(i, ["cs.LG x", " CS.lg", "\tcs.LG", "math.CO", "", None][i % 6], 1, "", "") for i in range(600)] + [(0, "cs.LG x", 1, "", ""), (None, "cs.LG", 1, "", "")]
    docs = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([(1, 50, "cs.LG", 500, 0), (1, 50, "math.CO", 400, 0), (1, 50, "q.X", 10, 7)], TARGETS)
    report = {r["category"]: r for r in target_report(docs, "doc_id", "category", targets).collect()}
    assert (report["cs.LG"]["need"], report["cs.LG"]["have"], report["cs.LG"]["met"]) == (150, 300, True)
    assert (report["math.CO"]["need"], report["math.CO"]["have"], report["math.CO"]["met"]) == (120, 100, False)
    assert (report["q.X"]["need"], report["q.X"]["have"], report["q.X"]["met"]) == (7, 0, False)
    for parts in (1, 5):
        got = sorted(tuple(r) for r in draw_samples(docs.repartition(parts), "doc_id", "category", targets).collect())
        assert len(got) == 300 and len({r[1] for r in got}) == 300
        counts = {c: sum(1 for r in got if r[2] == c) for c in ("cs.lg", "math.co", "")}
        assert counts == {c: v for c, v in (("cs.lg", report["cs.LG"]["take"]), ("math.co", report["math.CO"]["take"]), ("", 300 - report["cs.LG"]["take"] - report["math.CO"]["take"]))}
        assert parts == 1 or got == before
        before = got


def test_empty(spark):
    none = spark.createDataFrame([], DOCS)
    targets = spark.createDataFrame([(1, 50, "cs.LG", 500, 3)], TARGETS)
    assert [r["met"] for r in target_report(none, "doc_id", "category", targets).collect()] == [False]
    assert draw_samples(none, "doc_id", "category", targets).count() == 0
    some = spark.createDataFrame([(1, "cs.LG", 1, "", "")], DOCS)
    assert draw_samples(some, "doc_id", "category", spark.createDataFrame([], TARGETS)).count() == 0


def test_no_sample_that_keeps_the_minima_deviates_less():
    import itertools
    import random

    rng = random.Random(0)
    for trial in range(200):
        have = {c: rng.randint(0, 7) for c in ("a", "b", "c", "")}
        size = rng.randint(0, 14)
        targets = {c: (rng.randint(0, 6), rng.randint(0, 3)) for c in ("a", "b", "c")}
        targets = {c: (max(w, m), m) for c, (w, m) in targets.items()}
        take = repair(have, targets, size, trial)
        total = min(size, sum(have.values()))
        assert sum(take.values()) == total and all(0 <= take[c] <= have[c] for c in have)
        floors = {c: min(have[c], targets[c][1]) if c in targets else 0 for c in have}
        if sum(floors.values()) > total:
            continue
        off = lambda t: sum(abs(t[c] - targets.get(c, (0, 0))[0]) for c in have)
        names = sorted(have)
        least = min(off(dict(zip(names, t, strict=True))) for t in itertools.product(*[range(floors[c], have[c] + 1) for c in names]) if sum(t) == total)
        assert all(take[c] >= floors[c] for c in have) and off(take) == least


def test_registered_method_and_report(spark):
    from kestrelite.llm.queries import QUERIES

    names = [n for n in QUERIES if n.startswith("p4_")]
    assert names[0] == "p4_method"
    from tests.compare import DATA

    report = {(r["draw_id"], r["category"].strip(" \t").lower()): r for r in QUERIES["p4_report"](spark, DATA).collect()}
    drawn = QUERIES["p4_method"](spark, DATA).collect()
    assert len(drawn) == len({(r["draw_id"], r["doc_id"]) for r in drawn})
    taken = {}
    for r in drawn:
        taken[r["draw_id"], r["category"]] = taken.get((r["draw_id"], r["category"]), 0) + 1
    for key, r in report.items():
        if not r["met"]:
            assert taken.get(key, 0) <= r["have"] < r["need"]
