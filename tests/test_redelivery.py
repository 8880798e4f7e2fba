import datetime

from pyspark.sql import functions as F

from kestrelite.operators.redelivery import normalised_node, one_per_message, repeated_messages

SCHEMA = "node string, seq long, t long, batch long, at timestamp, body string, file string, row long, k_node string, win string, copies long"
T0 = datetime.datetime(2026, 1, 1)


def write(spark, tmp_path, rows, files=3):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(files).write.parquet(path)
    return spark.read.parquet(path)


def identity():
    return {"node": normalised_node(F.col("node")), "seq": F.col("seq"), "t": F.col("t")}


def order():
    return [F.col("body").isNull(), F.col("batch"), F.col("at").isNull(), F.col("at")]


def test_one_copy_of_each(spark, tmp_path):
    x = ("f", 1, "k", "w", 9)
    rows = [
        ("A ", 1, 10, 2, T0, "late", *x), (" a", 1, 10, 1, T0, None, *x), ("a", 1, 10, 3, None, "later", *x), ("\ta", 1, 11, 1, T0, "restart", *x), ("b", 1, 10, 1, T0, "b", *x),
        (None, 1, 10, 1, T0, "n1", *x), (None, 1, 10, 1, T0, "n2", *x), ("a", None, 10, 1, T0, "n3", *x), ("a", None, 10, 1, T0, "n4", *x),
    ]
    rows += [("hot", 5, 5, i, T0, f"h{i}", *x) for i in range(500)] + [("tie", 1, 1, 1, T0, "same", *x)] * 4
    df = write(spark, tmp_path, rows)
    kept = one_per_message(df, identity(), order())
    assert kept.columns == df.columns
    assert sorted(r["body"] for r in kept.collect()) == sorted(["late", "restart", "b", "n1", "n2", "n3", "n4", "h0", "same"])
    assert {tuple(r) for r in repeated_messages(df, identity(), order()).collect()} == {("a", 1, 10), ("hot", 5, 5), ("tie", 1, 1)}


def test_payload_is_not_shuffled(spark, tmp_path):
    df = write(spark, tmp_path, [("a", 1, 1, i, T0, "x" * 100, "f", 1, "k", "w", 9) for i in range(20)])
    kept = one_per_message(df, identity(), order())
    plan = kept._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Join" not in plan and kept.count() == 1


def test_empty(spark, tmp_path):
    df = write(spark, tmp_path, [])
    assert one_per_message(df, identity(), order()).count() == 0 and repeated_messages(df, identity(), order()).count() == 0


def test_hot_messages_are_told_where_they_lie(spark, tmp_path, monkeypatch):
    from kestrelite.operators import redelivery

    rows = [("hot", 1, i) for i in range(300)] + [("warm", 2, i) for i in range(30)] + [("once", 3, 0), (None, 4, 1), (None, 4, 2)]
    spark.createDataFrame(rows, "node string, seq long, at long").repartition(5).write.parquet(f"{tmp_path}/t")
    run = lambda: sorted(map(str, one_per_message(spark.read.parquet(f"{tmp_path}/t"), {"node": F.col("node"), "seq": F.col("seq")}, [F.col("at")]).collect()))
    cold = run()
    monkeypatch.setattr(redelivery, "HOT_COPIES", 100)
    assert run() == cold and len(cold) == 5 and sum("at=0" in r for r in cold) == 3
