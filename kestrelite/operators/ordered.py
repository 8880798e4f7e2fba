"""Running computations over long ordered groups, without one task per group.

A window `PARTITION BY key ORDER BY t` sorts all rows of a key in one task, however many there are. Here rows are range-partitioned by (key, order)
instead, so a key that holds a third of all rows spans many slices. The running value inside a slice is an ordinary window; what a slice needs
from the slices before it is one row per (key, slice), and a window over those few rows.

Defined results: rows that agree in all order columns may swap places, so the order has to be total for a result to be unique; null keys are a key
of their own; null order values come first; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrelite.scratch import materialize

SLICE = "_slice"


def sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """`df` with a slice number: slices follow each other in (keys, order)."""
    ranged = df.repartitionByRange(*[F.col(c) for c in (*keys, *order)])
    return materialize(ranged.withColumn(SLICE, F.spark_partition_id()), "slices")  # written once, so that numbers can't change


def _inside(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys, SLICE).orderBy(*order)


def _with_edges(df: DataFrame, keys: Sequence[str], edges: DataFrame, wanted: Sequence[str]) -> DataFrame:
    e = edges.select(*[F.col(k).alias(f"_e_{k}") for k in keys], F.col(SLICE).alias("_e_slice"), *wanted)
    on = F.col(SLICE) == F.col("_e_slice")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_e_{k}"))
    return df.join(e, on, "left").drop("_e_slice", *[f"_e_{k}" for k in keys])


def with_lag(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """`columns`: new name to column whose value in the row before is wanted. `df` comes from `sliced`."""
    w, across = _inside(keys, order), Window.partitionBy(*keys).orderBy(SLICE)
    last = df.groupBy(*keys, SLICE).agg(F.max_by(F.struct(*columns.values()), F.struct(*order)).alias("_tail"))
    before = last.withColumn("_edge", F.lag("_tail").over(across)).drop("_tail")
    out = df.withColumn("_n", F.row_number().over(w))
    for new, c in columns.items():
        out = out.withColumn(new, F.lag(c).over(w))
    out = _with_edges(out, keys, before, ["_edge"])
    for new, c in columns.items():
        out = out.withColumn(new, F.when(F.col("_n") == 1, F.col(f"_edge.{c}")).otherwise(F.col(new)))
    return out.drop("_n", "_edge")


def with_running(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, value: Column, how: str) -> DataFrame:
    """The running `max`, `sum` or `count` of `value` up to and with each row. `df` comes from `sliced`."""
    fold = {"max": F.max, "sum": F.sum, "count": F.count}[how]
    again = F.max if how == "max" else F.sum
    held = df.withColumn("_v", value)
    part = held.groupBy(*keys, SLICE).agg(fold("_v").alias("_part"))
    across = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    before = part.withColumn("_edge", again("_part").over(across)).drop("_part")
    up_to = _inside(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = _with_edges(held.withColumn("_in", fold("_v").over(up_to)), keys, before, ["_edge"])
    both = F.greatest("_in", "_edge") if how == "max" else F.coalesce("_in", F.lit(0)) + F.coalesce("_edge", F.lit(0))
    return out.withColumn(name, both).drop("_v", "_in", "_edge")


def with_number(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Row numbers 1, 2, ... of each key. `df` comes from `sliced`."""
    return with_running(df, keys, order, name, F.lit(1), "count")


def fold_slices(df: DataFrame, key: str, order: Sequence[str], summarise, start: str) -> DataFrame:
    """(key, state, applied): the state of each key after all its rows in order, and how many rows changed it. `df` comes from `sliced`.

    summarise(rows of a slice in order, an Arrow table) gives, for each state that some row of the slice reacts to, the state after the slice and how many
    rows changed it: a list of (state, state after, changes), states as text. A state that isn't there passes through unchanged. So slices are summed up
    side by side, however long a key is, and a key's fold goes over its slices, of which there are as many as tasks at most.
    """
    import pyarrow as pa

    kind = dict(df.dtypes)[key]

    def run(table: pa.Table) -> pa.Table:
        found = summarise(table.sort_by([(c, "ascending") for c in order]))
        n = len(found)
        return pa.table({key: table[key].take(pa.array([0] * n, pa.int64())), SLICE: table[SLICE].take(pa.array([0] * n, pa.int64())), "a": pa.array([f[0] for f in found], pa.string()), "b": pa.array([f[1] for f in found], pa.string()), "n": pa.array([f[2] for f in found], pa.int64())})

    each = df.groupBy(key, SLICE).applyInArrow(run, f"`{key}` {kind}, {SLICE} int, a string, b string, n long")
    maps = each.groupBy(key, SLICE).agg(F.map_from_entries(F.collect_list(F.struct("a", F.struct("b", "n")))).alias("m"))
    chain = maps.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(SLICE, "m")), lambda x, y: x[SLICE] - y[SLICE]), lambda s: s["m"]).alias("maps"))
    first = F.struct(F.lit(start).alias("state"), F.lit(0).cast("long").alias("applied"))

    def step(at: Column, m: Column) -> Column:
        hit = F.try_element_at(m, at["state"])
        return F.struct(F.coalesce(hit["b"], at["state"]).alias("state"), (at["applied"] + F.coalesce(hit["n"], F.lit(0))).cast("long").alias("applied"))

    return chain.select(key, F.aggregate("maps", first, step).alias("s")).select(key, "s.state", "s.applied")
