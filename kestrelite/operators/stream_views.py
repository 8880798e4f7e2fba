"""Layouts, grants and lookups over recorded streams."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kestrelite.operators.ordered import sliced, with_lag, with_running


def element_at_rank(values: str, rank: Column) -> Column:
    """The element of a sorted array at a zero-based rank."""
    return F.element_at(F.col(values), rank.cast("int") + 1)


def waterfall(spans: DataFrame) -> DataFrame:
    """`left_at` and `width` of each span (trace_id, t0, t1) within its trace; a width is at least 0.002, a trace at least 1 ns long."""
    bounds = spans.groupBy("trace_id").agg(F.min("t0").alias("_a"), F.greatest(F.lit(1), F.max("t1") - F.min("t0")).alias("_span"))
    out = spans.join(bounds, "trace_id").withColumn("left_at", (F.col("t0") - F.col("_a")) / F.col("_span"))
    return out.withColumn("width", F.greatest(F.lit(0.002), (F.col("t1") - F.col("t0")) / F.col("_span"))).drop("_a", "_span")


def grants_per_run(requests: DataFrame, key: str, time: str, cap: int, window: int) -> DataFrame:
    """(key, requests, granted): a request is granted if fewer than `cap` grants lie at most `window` before it.

    A grant depends on grants, not on requests, so no window frame expresses it. After a pause longer than the window no grant counts any more: the
    requests between two such pauses are one run, and only a run is folded in order. Runs are read as sorted streams, of which a task holds the last `cap`
    grants and no more; a run that has a large part of all requests is one task's reading, but never one task's memory.
    """
    cut = with_lag(sliced(requests.select(key, time), [key], [time]), [key], [time], {"_before": time})
    cut = cut.withColumn("_new", F.when(F.col(time) - F.col("_before") <= window, 0).otherwise(1)).drop("_slice")
    runs = with_running(sliced(cut, [key], [time, "_new"]), [key], [time, "_new"], "_run", F.col("_new"), "sum")
    kind = dict(requests.dtypes)[key]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, n, granted, out = None, deque(), 0, 0, []
        for batch in batches:
            for k, run, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if (k, run) != now:
                    if now is not None:
                        out.append((now[0], n, granted))
                    now, n, granted = (k, run), 0, 0
                    held.clear()
                n += 1
                while held and t - held[0] > window:
                    held.popleft()
                if len(held) < cap:
                    held.append(t)
                    granted += 1
            if len(out) > 10_000:
                yield told(out)
                out = []
        if now is not None:
            out.append((now[0], n, granted))
        yield told(out)

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], keys), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], [key, "n", "g"])

    keys = to_arrow_type(requests.schema[key].dataType)
    ordered = runs.where(F.col(time).isNotNull()).select(key, "_run", time).repartition(key, "_run").sortWithinPartitions(key, "_run", time)
    folded = ordered.mapInArrow(fold, f"`{key}` {kind}, n long, g long")
    return folded.groupBy(key).agg(F.sum("n").alias("requests"), F.sum("g").alias("granted"))


def first_at_or_above(left: DataFrame, left_id: str, value: str, right: DataFrame, right_id: str, bound: str) -> DataFrame:
    """As-of join forwards: each left row with the smallest right bound that is at least its value (ties: the smallest right id). Without any: no row.

    Both sides are laid on one axis from high to low and the last bound met is carried on, so there is no pairing of rows.
    """
    # Going down, bounds of the same value come before values; of equal bounds the smallest id comes last.
    axis = left.select((-F.col(value)).alias("_k"), F.lit(1).alias("_side"), F.col(left_id).alias("_l"), F.lit(None).cast("bigint").alias("_r"), F.lit(0).cast("bigint").alias("_o"))
    axis = axis.union(right.select((-F.col(bound)).alias("_k"), F.lit(0).alias("_side"), F.lit(None).cast("bigint"), F.col(right_id), (-F.col(right_id)).alias("_o")))
    order = ["_k", "_side", "_o", "_l"]
    held = F.when(F.col("_side") == 0, F.struct("_k", (-F.col("_r")).alias("_n")))
    carried = with_running(sliced(axis, [], order), [], order, "_at", held, "max")
    return carried.where("_side = 1 AND _at IS NOT NULL").select(F.col("_l").alias(left_id), (-F.col("_at._n")).alias(right_id))
