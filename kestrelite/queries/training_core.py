"""Problem 2: messages delivered more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelite.operators.redelivery import normalised_node, one_per_message, repeated_messages
from kestrelite.sources.tables import table

#: A copy that still has its body comes before one that lost it, then the earlier batch, then the earlier receipt (unknown last).
LOST_BODY = "span IS NULL AND stats IS NULL AND state_change IS NULL"


def message_identity() -> dict:
    return {"node_id": normalised_node(F.col("node_id")), "seq": F.col("seq"), "t_mono_ns": F.col("t_mono_ns")}


def delivery_order() -> list:
    return [F.expr(LOST_BODY), F.col("batch_id"), F.col("received_at").isNull(), F.col("received_at")]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_messages(table(spark, sf_dir, "node_events"), message_identity(), delivery_order())


def p2_one_per_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table with one row per message, flattened to what any engine prints alike."""
    kept = one_per_message(table(spark, sf_dir, "node_events"), message_identity(), delivery_order())
    return kept.select(
        normalised_node(F.col("node_id")).alias("node_id"), "seq", "t_mono_ns", "batch_id", "received_at",
        F.expr(f"NOT ({LOST_BODY})").alias("has_body"), F.col("span.kind").alias("span_kind"), F.col("stats.p99_us").alias("p99_us"),
    )


QUERIES = {"p2_found": p2_found, "p2_one_per_message": p2_one_per_message}

_NODE = "lower(trim(node_id, chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)))"
ORACLE = {
    "p2_found": f"""
        SELECT {_NODE} AS node_id, seq, t_mono_ns FROM node_events
        WHERE node_id IS NOT NULL AND seq IS NOT NULL AND t_mono_ns IS NOT NULL GROUP BY ALL HAVING count(*) > 1""",
    "p2_one_per_message": f"""
        SELECT node_id, seq, t_mono_ns, batch_id, received_at, has_body, span_kind, p99_us FROM (
          SELECT {_NODE} AS node_id, seq, t_mono_ns, batch_id, received_at, NOT ({LOST_BODY}) AS has_body,
                 span.kind AS span_kind, stats.p99_us AS p99_us,
                 row_number() OVER (PARTITION BY {_NODE}, seq, t_mono_ns ORDER BY ({LOST_BODY}), batch_id, received_at NULLS LAST) AS rn
          FROM node_events) WHERE rn = 1 OR node_id IS NULL OR seq IS NULL OR t_mono_ns IS NULL""",
}
