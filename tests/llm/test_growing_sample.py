import datetime

from pyspark.sql import functions as F

from kestrelite.llm.growing_sample import BITS, STEP, fraction, growing_sample, number_ids

SCHEMA = "doc_id long, t timestamp, seq long, part string, i string"
T0 = datetime.datetime(2026, 1, 1)


def rows(n):
    return [(i * 37 % 1009 - 500, T0 + datetime.timedelta(seconds=i // 3), 1, "", "") for i in range(n)]


def new(tmp_path):
    return f"file://{tmp_path}/register"


def test_numbers_follow_insertion_and_fractions_are_exact(spark, tmp_path):
    data = rows(500) + rows(40) + [(None, T0, 1, "", "")]
    got = {r["doc_id"]: r["seq"] for r in number_ids(spark.createDataFrame(data, SCHEMA).repartition(7), "doc_id", "t", new(tmp_path)).collect()}
    want = {d: k for k, (_, d) in enumerate(sorted((t, d) for d, t, *_ in rows(500)))}
    assert got == want
    big = [0, 1, 2**20, 2**39 + 5, 2**40 - 1, 2**40 + 3, 123456789012]
    out = spark.createDataFrame([(b,) for b in big], "s long").select("s", fraction(F.col("s"), 77).alias("f")).collect()
    assert all(r["f"] == (r["s"] * STEP + 77) % 2**BITS for r in out)


def test_stable_even_and_growing(spark):
    small, large = (spark.createDataFrame(rows(n), SCHEMA) for n in (400, 1000))
    a, b = ({r["doc_id"] for r in growing_sample(d, "doc_id", "t", 100, 12345).collect()} for d in (small, large))
    assert a <= b and a == {r["doc_id"] for r in growing_sample(small.repartition(5), "doc_id", "t", 100, 12345).collect()}
    seqs = sorted(r["seq"] for r in growing_sample(large, "doc_id", "t", 100, 12345).collect())
    for lo in range(0, 900, 100):
        assert 8 <= sum(lo <= s < lo + 100 for s in seqs) <= 12


def test_nothing_that_comes_later_takes_a_doc_out(spark, tmp_path):
    base = [(i * 7, T0 + datetime.timedelta(seconds=i), 1, "", "") for i in range(2000)]
    timeless = [(100_000 + i, None, 1, "", "") for i in range(50)]
    take = lambda data: {r["doc_id"] for r in growing_sample(spark.createDataFrame(data, SCHEMA), "doc_id", "t", 50, 99, new(tmp_path)).collect()}
    first = take(base + timeless)
    assert 95 <= len(first) <= 110 and take(base + timeless) == first
    late = [(1, T0 - datetime.timedelta(days=3), 1, "", ""), (2, None, 1, "", ""), (100_000, T0, 1, "", "")]
    second = take(base + timeless + late)
    assert first <= second
    more = [(3_000_000 + i, T0 - datetime.timedelta(days=9), 1, "", "") for i in range(1000)]
    third = take(more + late + timeless + base)
    assert second <= third and 45 <= len(third - second) <= 55
    gone = take(base[:1000])
    assert gone == third & {r[0] for r in base[:1000]}


def test_register_keeps_numbers_and_starts_once(spark, tmp_path):
    take = lambda data: {r["doc_id"]: r["seq"] for r in number_ids(spark.createDataFrame(data, SCHEMA), "doc_id", "t", new(tmp_path)).collect()}
    assert take([(5, T0, 1, "", "")]) == {5: 0}  # the next number after 0 is 1
    assert take([(4, T0, 1, "", ""), (5, T0, 1, "", "")]) == {5: 0, 4: 1}
    kept = take(rows(300)[50:])
    again = take(rows(300))
    assert all(again[d] == s for d, s in kept.items()) and sorted(again.values()) == list(range(len(again)))


def test_a_faster_run_is_waited_for(spark, tmp_path, monkeypatch):
    from kestrelite.llm import growing_sample as module

    real, calls = module._publish, []

    def slow(s, written, register, run):
        if not calls:  # another run numbers two ids first
            calls.append(1)
            s.createDataFrame([(77, 0), (1, 1)], "doc_id long, seq long").write.parquet(f"{register}/run-{run:06d}")
        return real(s, written, register, run)

    monkeypatch.setattr(module, "_publish", slow)
    got = {r["doc_id"]: r["seq"] for r in number_ids(spark.createDataFrame([(1, T0, 1, "", ""), (2, T0, 1, "", "")], SCHEMA), "doc_id", "t", new(tmp_path)).collect()}
    assert got == {77: 0, 1: 1, 2: 2}


def test_nulls_and_empty(spark, tmp_path):
    got = number_ids(spark.createDataFrame([(1, None, 1, "", ""), (2, T0, 1, "", "")], SCHEMA), "doc_id", "t", new(tmp_path)).collect()
    assert {r["doc_id"]: r["seq"] for r in got} == {2: 0, 1: 1}
    assert growing_sample(spark.createDataFrame([], SCHEMA), "doc_id", "t", 100).count() == 0
