"""Scalar functions: identifiers, buckets, codes, text and layout arithmetic. All are column expressions that stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that is collapsed in titles and abstracts, spelled out because engines differ on their short forms.
SPACES = "[ \\t\\n\\r\\f\\x0B]+"
#: Nine archive prefixes that count as physics.
PHYSICS = ("hep-", "astro-ph", "cond-mat", "gr-qc", "nucl-", "quant-ph", "physics", "math-ph", "nlin")
#: Order of span kinds along a query.
SPAN_ORDER = ("SPAN_QUERY_RECEIVED", "SPAN_EMBED", "SPAN_PLAN", "SPAN_SHARD_RPC", "SPAN_SHARD_SEARCH", "SPAN_MERGE", "SPAN_QUERY_DONE")
TRACE_LEVELS = {"TRACE_NONE": 0, "TRACE_SPANS": 1, "TRACE_FULL": 2}


def collapsed(text: Column) -> Column:
    """Text with each run of white space made one space, and none at the ends."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def snippet(text: Column, length: int = 400) -> Column:
    return F.substring(text, 1, length)


def bucket_of(category: Column) -> Column:
    """Coarse bucket of a category code, by prefixes in a fixed order."""
    physics = F.lit(False)
    for p in PHYSICS:
        physics = physics | F.startswith(category, F.lit(p))
    return (
        F.when(F.startswith(category, F.lit("cs.")), "cs")
        .when(F.startswith(category, F.lit("math.")), "math")
        .when(physics, "physics")
        .when(F.startswith(category, F.lit("q-bio")), "q-bio")
        .otherwise("other")
    )


def shard_of(key: Column, shards: int) -> Column:
    """Hash partition of an id: the first 32 bits of its MD5, so that any engine can recompute it."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint"), F.lit(shards)).cast("int")


def uniform_of(*parts: Column) -> Column:
    """A uniform in (0, 1) from a hash of the given parts, the same in any engine and any order of rows."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def node_role(node: Column) -> Column:
    return F.when(node.rlike("^shard-[0-9]+[ab]$"), "shard").otherwise(F.nullif(F.regexp_extract(node, "^(coord|embed|collector|member)-[0-9]+$", 1), F.lit("")))


def node_number(node: Column) -> Column:
    return F.nullif(F.regexp_extract(node, "^(?:shard|coord|embed|collector|member)-([0-9]+)[ab]?$", 1), F.lit("")).cast("int")


def node_replica(node: Column) -> Column:
    return F.nullif(F.regexp_extract(node, "^shard-[0-9]+([ab])$", 1), F.lit(""))


def shard_port(base: int, shard: Column, replica: Column) -> Column:
    return (F.lit(base) + shard * 10 + F.when(replica == "a", 0).otherwise(1)).cast("int")


def topic_of(span: Column, stats: Column) -> Column:
    return F.when(span.isNotNull(), "spans").when(stats.isNotNull(), "metrics").otherwise("cluster")


def trace_hex(base64: Column) -> Column:
    return F.lower(F.hex(F.unbase64(base64)))


def span_rank(kind: Column) -> Column:
    out = F.lit(len(SPAN_ORDER))
    for i, k in reversed(list(enumerate(SPAN_ORDER))):
        out = F.when(kind == k, i).otherwise(out)
    return out.cast("int")


def http_status(grpc: Column) -> Column:
    """HTTP code of each call status."""
    codes = {"OK": 200, "INVALID_ARGUMENT": 400, "NOT_FOUND": 404, "FAILED_PRECONDITION": 409, "UNAVAILABLE": 503, "DEADLINE_EXCEEDED": 504}
    out = F.lit(500)
    for k, v in codes.items():
        out = F.when(grpc == k, v).otherwise(out)
    return out.cast("int")


def call_label(status: Column) -> Column:
    """How a call's status is named in the details of a span."""
    labels = {"OK": "OK", "DEADLINE_EXCEEDED": "DEADLINE", "UNAVAILABLE": "UNAVAILABLE", "FAILED_PRECONDITION": "STALE_EPOCH"}
    out = F.lit("ERROR")
    for k, v in labels.items():
        out = F.when(status == k, v).otherwise(out)
    return out


def hop_meta(layer: Column, kind: Column) -> Column:
    """Packed hop: kind in the low three bits, layer above."""
    return F.shiftleft(layer.bitwiseAND(F.lit(15)), 3).bitwiseOR(kind)


def hop_layer(meta: Column) -> Column:
    return F.shiftright(meta, 3).bitwiseAND(F.lit(15))


def hop_kind(meta: Column) -> Column:
    return meta.bitwiseAND(F.lit(7))


def unsigned(key: Column) -> Column:
    """A 64-bit id as a value that orders as the unsigned number does."""
    return key.bitwiseXOR(F.lit(-9223372036854775808))
