import math
import random

import pytest
from pyspark.sql import functions as F

from kestrelite.llm.percentiles import combine, radix_histogram, radix_select

SCHEMA = "g string, part int, v double, key long, n long, found string"


def rows(seed=0, n=400):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        v = rng.choice([rng.expovariate(1e-3), -rng.random(), 0.0, -0.0, 5.0, None, math.nan, 1e300, -math.inf, math.inf])
        out.append((rng.choice(["a", "b", None]), i % 3, v, 1, 2, "x"))
    return out + [("hot", 0, 7.0, 1, 2, "x")] * 200 + [("empty", 0, None, 1, 2, "x")]


def brute(data, permille):
    groups = {}
    for g, _, v, *_ in data:
        if v is not None and not math.isnan(v):
            groups.setdefault(g, []).append(v + 0.0)
    return {g: sorted(v)[max(1, -(-len(v) * permille // 1000)) - 1] for g, v in groups.items()}


def test_exact(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    found = radix_select(radix_histogram(df, ["g"], F.col("v")), ["g"], [1, 500, 990, 1000]).collect()
    for p in (1, 500, 990, 1000):
        assert {r["g"]: r["low"] for r in found if r["permille"] == p} == brute(data, p)
    assert all(r["low"] == r["high"] for r in found)


@pytest.mark.parametrize("bits", [20, 32])
def test_parts_add_up_and_error_is_bounded(spark, bits):
    data = [(g, p, abs(v) + 1 if v is not None and math.isfinite(v) else 2.0, *x) for g, p, v, *x in rows(3)]
    df = spark.createDataFrame(data, SCHEMA)
    parts = combine(radix_histogram(df, ["g", "part"], F.col("v"), bits), ["g"])
    found = {(r["g"], r["permille"]): r for r in radix_select(parts, ["g"], [500, 990], bits).collect()}
    for p in (500, 990):
        for g, v in brute(data, p).items():
            r = found[g, p]
            assert r["low"] <= v <= r["high"] and r["high"] <= r["low"] * (1 + 2.0 ** (12 - bits))


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert radix_select(radix_histogram(df, ["g"], F.col("v")), ["g"], [500]).count() == 0
