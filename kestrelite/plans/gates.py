"""Gates of a benchmark run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recall_gates(results: DataFrame, by: str, recall: str, floor: float, slack: float = 0.02) -> DataFrame:
    """Results with `monotone` (recall doesn't fall by more than `slack` as `by` grows) and `above_floor` for the widest setting. Few rows."""
    w = Window.orderBy(by)
    widest = Window.partitionBy()
    out = results.withColumn("_last", F.lag(recall).over(w)).withColumn("_most", F.max(by).over(widest))
    return out.withColumn("monotone", F.coalesce(F.col(recall) >= F.col("_last") - slack, F.lit(True))).withColumn("above_floor", (F.col(by) < F.col("_most")) | (F.col(recall) >= floor)).drop("_last", "_most")


def recall_series(results: DataFrame, scheme: str = "partitioning", latency: str = "p99_ms") -> DataFrame:
    """Results with their `place` in the series of their scheme, from the fastest on. Few rows."""
    return results.withColumn("place", F.row_number().over(Window.partitionBy(scheme).orderBy(latency, "probe", "ef")))


def sweep_gates(results: DataFrame, model: str | None = None, floor: float = 0.95, slack: float = 0.02, half_floor: float = 0.9) -> DataFrame:
    """(gate, partitioning, ef, passed) of a sweep (partitioning, shards, probe, ef, recall); probe 0 is all shards. Few rows.

    floor: recall at ef 100 over all shards; monotone: no ef loses more than `slack` against the one before it; half: the best recall over half of the
    shards of a partitioning by meaning, asked only of a real encoder, as the hashing one puts a query nowhere near what it is about.
    """
    full = results.where("probe = 0")
    before = F.lag("recall").over(Window.partitionBy("partitioning").orderBy("ef"))
    gates = full.where("ef = 100").select(F.lit("floor").alias("gate"), "partitioning", "ef", (F.col("recall") >= floor).alias("passed"))
    gates = gates.union(full.select(F.lit("monotone"), "partitioning", "ef", F.coalesce(F.col("recall") >= before - slack, F.lit(True))))
    if model and model != "hash":
        half = results.where("partitioning = 'semantic' AND probe = greatest(1, shards div 2)")
        gates = gates.union(half.groupBy("partitioning").agg(F.max("recall").alias("r")).select(F.lit("half"), "partitioning", F.lit(0), F.col("r") >= half_floor))
    return gates
