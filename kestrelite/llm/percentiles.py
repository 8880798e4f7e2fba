"""Percentiles of very large numeric columns, by radix selection.

A double becomes a 64-bit integer in the same order. Repeated values of a group are counted first (with a map-side half), so what is kept is
(group, integer, count). The target ranks of a group then follow the bits from the top: per pass, a histogram of the next digit among the
values that share the digits found so far; the digit that holds a rank is kept, the ranks before it are taken off, and only values with a kept
digit are read again. A group goes through the passes as 96 bits of hash, and comes back as itself at the end. Histograms add up, so
results of separate batches or days are combined by adding counts (`radix_histogram`, `combine`), never by mixing percentiles.

Error: after `bits` of 64 bits the value is known to lie in [low, high]; for bits >= 12 their ratio is below 1 + 2^(12 - bits). With all 64
bits the value is exact. A percentile p of n values is the one of rank ceil(p n), at least 1.

Defined results: null and NaN values don't count, a group without values has no row, a null group key is a group, ties need no care, as equal
values are one count; -0.0 counts as 0.0; infinities are values. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from kestrelite.scratch import materialize, release


@F.pandas_udf(LongType())
def ordered_bits(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A double's bits as a signed integer that orders as the doubles do."""
    for v in values:
        raw = (v.to_numpy(np.float64) + 0.0).view(np.int64)
        yield pd.Series(np.where(raw < 0, raw ^ np.int64(0x7FFFFFFFFFFFFFFF), raw))


@F.pandas_udf(DoubleType())
def from_ordered_bits(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for v in values:
        key = v.to_numpy(np.int64)
        yield pd.Series(np.where(key < 0, key ^ np.int64(0x7FFFFFFFFFFFFFFF), key).view(np.float64))


def radix_histogram(rows: DataFrame, keys: Sequence[str], value: Column, bits: int = 64) -> DataFrame:
    """(keys, key, n): how many values of a group share their first `bits` bits. Tables of parts add up to the table of the whole."""
    held = rows.select(*[F.col(k) for k in keys], value.cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    counted = held.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("n")).select(*keys, ordered_bits("_v").alias("key"), "n")
    if bits < 64:
        counted = counted.withColumn("key", F.shiftright("key", 64 - bits)).groupBy(*keys, "key").agg(F.sum("n").alias("n"))
    return counted


def combine(histograms: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One histogram from those of parts: any columns beside `keys` that told the parts apart go."""
    return histograms.groupBy(*keys, "key").agg(F.sum("n").alias("n"))


def radix_select(histogram: DataFrame, keys: Sequence[str], permilles: Sequence[int], bits: int = 64, digit: int = 16) -> DataFrame:
    """(keys, permille, n, low, high) of each group and target: the bounds of the value at its rank; low = high for 64 bits."""
    group = [F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys]
    rows = materialize(histogram.withColumn("_g", F.xxhash64(*group)).withColumn("_h", F.hash(*group)), "percentiles")
    values, left = rows.select("_g", "_h", F.col("key").alias("_key"), F.col("n").alias("_n")), None
    state, done = None, 0
    while done < bits:
        width = min(digit, bits - done)
        rest = bits - done - width  # bits below this digit
        head = F.shiftright("_key", rest).alias("_head")
        if state is None:
            hist, run = values.groupBy("_g", "_h", head).agg(F.sum("_n").alias("_n")), Window.partitionBy("_g", "_h")
            # A histogram has at most 2^digit rows a group; targets are made where the group's total is known.
            hist = hist.withColumn("_total", F.sum("_n").over(run))
            rank = lambda p: F.greatest(F.lit(1).cast("long"), F.expr(f"(_total * {int(p)} + 999) div 1000"))
            hist = hist.withColumn("_ranks", F.array(*[F.struct(F.lit(int(p)).alias("permille"), rank(p).alias("rank")) for p in permilles]))
        else:
            found = state.select("_g", "_h", F.col("_head").alias("_found"))
            kept = values.withColumn("_found", F.shiftright("_key", rest + width)).join(found, ["_g", "_h", "_found"], "left_semi").select("_g", "_h", "_key", "_n")
            after = materialize(kept, "percentiles")
            if left is not None:
                release(left)
            values = left = after
            part = values.groupBy("_g", "_h", head).agg(F.sum("_n").alias("_n")).withColumn("_found", F.shiftright("_head", width))
            hist = part.join(state.select("_g", "_h", F.col("_head").alias("_found"), "_total", "_ranks"), ["_g", "_h", "_found"])
            run = Window.partitionBy("_g", "_h", "_found")
        upto = F.sum("_n").over(run.orderBy("_head").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        hist = hist.withColumn("_below", upto - F.col("_n"))
        inside = F.filter("_ranks", lambda r: (r["rank"] > F.col("_below")) & (r["rank"] <= F.col("_below") + F.col("_n")))
        on = F.transform(inside, lambda r: F.struct(r["permille"].alias("permille"), (r["rank"] - F.col("_below")).alias("rank")))
        old, state = state, materialize(hist.select("_g", "_h", "_total", "_head", on.alias("_ranks")).where(F.size("_ranks") > 0), "percentiles")
        if old is not None:
            release(old)
        done += width
    each = state.select("_g", "_h", "_total", "_head", F.explode("_ranks.permille").alias("permille"))
    low = F.shiftleft("_head", 64 - bits) if bits < 64 else F.col("_head")
    high = F.shiftleft(F.col("_head") + 1, 64 - bits) - 1 if bits < 64 else F.col("_head")
    named = rows.select("_g", "_h", *keys).groupBy("_g", "_h").agg(*[F.first(k).alias(k) for k in keys])
    return each.join(named, ["_g", "_h"]).select(*keys, "permille", F.col("_total").alias("n"), from_ordered_bits(low).alias("low"), from_ordered_bits(high).alias("high"))
