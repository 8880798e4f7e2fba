"""Corpus preparation over `docs`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelite.functions.scalars import SPAN_ORDER, bucket_of, snippet
from kestrelite.operators.corpus import SHARES, corpus_digest, normalise_records, query_set, stratified_sample
from kestrelite.queries.partitioning import _BUCKET
from kestrelite.sources.tables import table

QUERIES: dict = {}
ORACLE: dict = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_WS = "trim(regexp_replace({}, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))"
_NORM = f"""n AS (SELECT DISTINCT doc_id, {_WS.format('title')} AS title, {_WS.format('snippet')} AS abstract, nullif(regexp_extract({_WS.format('category')}, '^([^ ]+)', 1), '') AS c FROM docs),
    d AS (SELECT doc_id, title, abstract, c, {_BUCKET} AS bucket FROM n WHERE doc_id IS NOT NULL AND length(title) > 0 AND length(abstract) >= 100 AND c IS NOT NULL)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise_records(table(spark, sf_dir, "docs"), "doc_id", "title", "snippet", "category").distinct().withColumn("bucket", bucket_of(F.col("category")))


@register(f"WITH {_NORM} SELECT doc_id, title, abstract, c AS category, bucket, substr(abstract, 1, 400) AS snippet FROM d")
def doc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).withColumn("snippet", snippet(F.col("abstract")))


@register(f"WITH {_NORM}, t AS (SELECT count(*) AS total FROM d) SELECT bucket, count(*) AS n, round(count(*) / any_value(total), 9) AS share FROM d, t GROUP BY bucket")
def bucket_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    return r.join(F.broadcast(r.agg(F.sum("n").alias("total")))).select("bucket", "n", F.round(F.col("n") / F.col("total"), 9).alias("share"))


_QUOTA = "CASE bucket " + " ".join(f"WHEN '{b}' THEN {max(1, 2000 * s // 1000)}" for b, s in SHARES.items()) + " ELSE 0 END"


@register(f"WITH {_NORM} SELECT doc_id, bucket FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5('7|' || CAST(doc_id AS VARCHAR)), doc_id) AS k FROM d) WHERE k <= {_QUOTA}")
def stratified_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of 2,000 in fixed shares of buckets."""
    return stratified_sample(_records(spark, sf_dir), "doc_id", "bucket", 2000, 7).select("doc_id", "bucket")


@register(f"WITH {_NORM}, q AS (SELECT doc_id, title FROM d ORDER BY md5('11|' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 300) SELECT row_number() OVER (ORDER BY doc_id) - 1 AS qid, title AS text, doc_id AS source_doc_id FROM q")
def held_out_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_set(_records(spark, sf_dir), "doc_id", "title", 300, 11)


@register(f"""WITH {_NORM} SELECT count(*) AS n, lower(hex(CAST(sum(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '|' || md5(abstract)), 1, 15) AS HUGEINT)) % 1152921504606846976 AS BIGINT))) AS digest FROM d""")
def digest_of_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_digest(_records(spark, sf_dir), F.col("doc_id"), F.md5("abstract"))


_KINDS = ", ".join(f"('{k}')" for k in SPAN_ORDER)


@register(f"""WITH s AS (SELECT DISTINCT span.trace_id AS t, span.kind AS k FROM node_events WHERE span.trace_id IS NOT NULL)
    SELECT kind, (SELECT count(DISTINCT t) FROM s) - (SELECT count(*) FROM s WHERE k = kind) AS traces_without FROM (VALUES {_KINDS}) t(kind)""")
def missing_span_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each kind of span that a complete trace has: how many traces lack it."""
    s = table(spark, sf_dir, "node_events").where("span.trace_id IS NOT NULL").select(F.col("span.trace_id").alias("t"), F.col("span.kind").alias("kind")).distinct()
    want = spark.createDataFrame([(k,) for k in SPAN_ORDER], "kind string")
    traces = s.agg(F.countDistinct("t").alias("traces"))  # one row
    have = s.where("kind IS NOT NULL").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return want.join(have, "kind", "left").join(F.broadcast(traces)).select("kind", (F.col("traces") - F.coalesce("n", F.lit(0))).alias("traces_without"))


@register("SELECT q.qid AS qid, q.source_doc_id AS source_doc_id, d.title IS NOT NULL AS found, coalesce(starts_with(lower(d.title), lower(trim(q.text))), FALSE) AS is_title FROM queries q LEFT JOIN (SELECT doc_id, min(coalesce(title, '')) AS title FROM docs GROUP BY doc_id) d ON d.doc_id = q.source_doc_id")
def query_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out queries against the record that each was taken from."""
    d = table(spark, sf_dir, "docs").groupBy(F.col("doc_id").alias("source_doc_id")).agg(F.min(F.coalesce("title", F.lit(""))).alias("title"))
    q = table(spark, sf_dir, "queries").join(d, "source_doc_id", "left")
    return q.select("qid", "source_doc_id", F.col("title").isNotNull().alias("found"), F.coalesce(F.startswith(F.lower("title"), F.lower(F.trim("text"))), F.lit(False)).alias("is_title"))
