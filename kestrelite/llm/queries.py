"""Registered queries of this part, and their SQL."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelite.llm.density import density_clusters, describe, nearest_means, place
from kestrelite.llm.growing_sample import BITS, STEP, growing_sample
from kestrelite.llm.knn import nearest_neighbours, unit, unpack, usable_vectors
from kestrelite.llm.leakage import leaked_items
from kestrelite.llm.neardup import group_pairs, near_duplicate_groups
from kestrelite.llm.packing import FIT, INDEX, SEED, WHOLE, pack_texts
from kestrelite.llm.percentiles import combine, radix_histogram, radix_select
from kestrelite.llm.quotas import draw_samples, target_report
from kestrelite.llm.subjects import subject_areas
from kestrelite.operators.redelivery import normalised_node
from kestrelite.operators.search import merge_top_k, shard_hits
from kestrelite.scratch import materialize, shared_dir
from kestrelite.sources.tables import table

QUERIES: dict = {}
ORACLE: dict = {}


def _register(f):
    QUERIES[f.__name__] = f
    return f


PERMILLES = (500, 900, 950, 990)
#: Bits of the histograms kept per batch and day: a value is known to 1 part in 2^12.
KEPT_BITS = 24


def _latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, node_id, day, part, us): one latency per message and per answered query, whatever the number of its copies.

    Inside a body a missing number is zero; a response whose parts took time but whose total is missing has no total, and doesn't count.
    """
    node = normalised_node(F.col("node_id")).alias("node_id")
    events = table(spark, sf_dir, "node_events").where("stats IS NOT NULL").select(node, "seq", "t_mono_ns", "batch_id", "emitted_at", "received_at", F.coalesce("stats.p99_us", F.lit(0)).alias("us"))
    events = events.groupBy("node_id", "seq", "t_mono_ns").agg(F.max("us").alias("us"), F.min("batch_id").alias("part"), F.coalesce(F.min("emitted_at"), F.min("received_at")).cast("date").alias("day"))
    answers = table(spark, sf_dir, "responses").select("trace_id", node, F.col("answered_at").alias("t"), F.col("recorded_at").alias("r"), F.col("timings.total_us").alias("us"))
    answers = answers.groupBy("trace_id").agg(F.min("node_id").alias("node_id"), F.max("us").alias("us"), F.min("r").cast("date").alias("r"), F.min("t").cast("date").alias("day"))
    answers = answers.select(F.lit("response").alias("source"), "node_id", "day", F.datediff("r", F.lit("1970-01-01")).cast("long").alias("part"), "us").where("us IS NOT NULL")
    return events.select(F.lit("stats").alias("source"), "node_id", "day", "part", "us").union(answers)


@_register
def p1_batch_and_day_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source, node and day, the percentiles of each batch (`level` batch) and, from the batches' histograms added up, of the day (`level` day).

    All 64 bits are followed, so values are exact. `part` is the batch, or the day of recording for responses.
    """
    keys = ["source", "node_id", "day", "part"]
    parts = materialize(radix_histogram(_latencies(spark, sf_dir), keys, F.col("us")), "percentile-parts")
    days = combine(parts, keys[:3]).withColumn("part", F.lit(None).cast("long"))
    both = parts.withColumn("level", F.lit("batch")).unionByName(days.withColumn("level", F.lit("day")))
    found = radix_select(both, ["level", *keys], PERMILLES)
    return found.select("level", *keys, "permille", "n", F.col("low").alias("value"))


@_register
def p1_node_day_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source, node and day, from a histogram per batch cut to 24 bits and combined: bounds that are within 1 part in 4096."""
    keys = ["source", "node_id", "day"]
    parts = radix_histogram(_latencies(spark, sf_dir), [*keys, "part"], F.col("us"), KEPT_BITS)
    return radix_select(combine(parts, keys), keys, PERMILLES, KEPT_BITS)


_NODE = "lower(trim(node_id, chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)))"
ORACLE["p1_batch_and_day_percentiles"] = f"""
    WITH e AS (SELECT 'stats' AS source, {_NODE} AS node_id, max(coalesce(stats.p99_us, 0)) AS us, min(batch_id) AS part,
                      CAST(coalesce(min(emitted_at), min(received_at)) AS DATE) AS day
               FROM node_events WHERE stats IS NOT NULL GROUP BY {_NODE}, seq, t_mono_ns),
         r AS (SELECT 'response' AS source, min({_NODE}) AS node_id, max(timings.total_us) AS us,
                      CAST(date_diff('day', DATE '1970-01-01', CAST(min(recorded_at) AS DATE)) AS BIGINT) AS part, CAST(min(answered_at) AS DATE) AS day
               FROM responses GROUP BY trace_id),
         w AS (SELECT source, node_id, day, part, us FROM e UNION ALL SELECT source, node_id, day, part, us FROM r WHERE us IS NOT NULL),
         v AS (SELECT 'batch' AS level, * FROM w UNION ALL SELECT 'day', source, node_id, day, NULL, us FROM w),
         o AS (SELECT *, row_number() OVER (PARTITION BY level, source, node_id, day, part ORDER BY us) AS k,
                      count(*) OVER (PARTITION BY level, source, node_id, day, part) AS n FROM v)
    SELECT level, source, node_id, day, part, CAST(p AS INTEGER) AS permille, n, CAST(us AS DOUBLE) AS value
    FROM o, (SELECT unnest([500, 900, 950, 990]) AS p) WHERE k = greatest(1, (n * p + 999) // 1000)"""


#: The same bounds by arithmetic: a double of exponent e has steps of 2^(e - 12) in its first 24 bits, and of 2^(e - 52) in all of them.
ORACLE["p1_node_day_percentiles"] = ORACLE["p1_batch_and_day_percentiles"].split("         v AS (")[0].rstrip().rstrip(",") + """,
         o AS (SELECT *, row_number() OVER (PARTITION BY source, node_id, day ORDER BY us) AS k, count(*) OVER (PARTITION BY source, node_id, day) AS n FROM w),
         x AS (SELECT source, node_id, day, CAST(p AS INTEGER) AS permille, n, CAST(us AS DOUBLE) AS v, floor(log2(greatest(us, 1))) AS e
               FROM o, (SELECT unnest([500, 900, 950, 990]) AS p) WHERE k = greatest(1, (n * p + 999) // 1000))
    SELECT source, node_id, day, permille, n, CASE WHEN v = 0 THEN 0.0 ELSE floor(v / pow(2.0, e - 12)) * pow(2.0, e - 12) END AS low,
           CASE WHEN v = 0 THEN 1099511627775 * pow(2.0, -1074) ELSE (floor(v / pow(2.0, e - 12)) + 1) * pow(2.0, e - 12) - pow(2.0, e - 52) END AS high FROM x"""


@_register
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_pairs(near_duplicate_groups(table(spark, sf_dir, "docs"), "doc_id", ["title", "snippet"], threshold=0.6))


@_register
def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf_dir, "docs"), "doc_id", ["title", "snippet"], threshold=0.6)


@_register
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = nearest_neighbours(table(spark, sf_dir, "docs"), "doc_id", "vector", k=10, least=0.93, replicas=3)
    return near.select(F.least("doc_id", "neighbour").alias("doc_a"), F.greatest("doc_id", "neighbour").alias("doc_b")).distinct()


@_register
def p5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of each query doc (id divisible by 100), searched in all docs; a query reads all lists nearly as near as the nearest."""
    return nearest_neighbours(table(spark, sf_dir, "docs"), "doc_id", "vector", k=10, queries="doc_id % 100 = 0", probes=128, probe_ratio=0.15)


@_register
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, means = density_clusters(table(spark, sf_dir, "docs"), "doc_id", "vector")
    placed = place(table(spark, sf_dir, "cluster_anchors"), "anchor_id", "vector", means, 0.55)
    return placed.join(members, "cluster").select(F.col("anchor_id").cast("int").alias("anchor_id"), "doc_id")


@_register
def p6_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "docs")
    return describe(density_clusters(docs, "doc_id", "vector")[0], docs, "doc_id", "category")


@_register
def p6_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the clusters are from a right division: members not similar to their own mean (0.6), or similar to another (0.5), and docs outside that are
    similar to a mean (0.6). The SQL says that there are none."""
    members, means = density_clusters(table(spark, sf_dir, "docs"), "doc_id", "vector")
    members, means = materialize(members.select("doc_id", F.col("cluster").alias("own")), "division"), materialize(means, "division-means")
    vectors = usable_vectors(table(spark, sf_dir, "docs"), "doc_id", "vector", 64)
    near = nearest_means(vectors, means).join(members, "doc_id", "left")
    inside = F.col("own").isNotNull()
    return near.agg(
        F.count_if(inside & ((F.col("own") != F.col("cluster")) | (F.col("best") < 0.6))).alias("unlike_their_own"), F.count_if(inside & (F.col("second") >= 0.5)).alias("like_another"), F.count_if(~inside & (F.col("best") >= 0.6)).alias("left_out"),
    )


ORACLE["p6_division"] = "SELECT CAST(0 AS BIGINT) AS unlike_their_own, CAST(0 AS BIGINT) AS like_another, CAST(0 AS BIGINT) AS left_out"


@_register
def p5_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of p5_nearest against exact search, for the same query docs: how many there are, and whether 0.9 is reached. The SQL says that it is."""
    vectors = materialize(usable_vectors(table(spark, sf_dir, "docs"), "doc_id", "vector", 64), "recall")

    def decode(batches):
        for batch in batches:
            x = unit(unpack(batch.column(1), 64)) if batch.num_rows else np.empty((0, 64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "vector"])

    x = vectors.mapInArrow(decode, "doc_id long, vector array<double>")
    asked = x.where("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), "vector")
    exact = shard_hits(x.withColumn("shard_id", F.lit(0)), asked, 11, 64).where("qid <> doc_id")
    truth = merge_top_k(exact, 10).select("qid", "doc_id")
    got = p5_nearest(spark, sf_dir).select(F.col("doc_id").alias("qid"), F.col("neighbour").alias("doc_id"))
    hit = truth.join(got.withColumn("found", F.lit(1)), ["qid", "doc_id"], "left")
    # A near tie may be told apart in either way.
    return hit.agg(F.countDistinct("qid").alias("queries"), (F.coalesce(F.sum("found"), F.lit(0)) >= 0.9 * F.count(F.lit(1))).alias("reached"))


ORACLE["p5_recall"] = """
    WITH u AS (SELECT DISTINCT doc_id, CAST(vector AS DOUBLE[]) AS v FROM docs WHERE doc_id IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
    SELECT count(DISTINCT doc_id) AS queries, TRUE AS reached FROM u WHERE doc_id % 100 = 0 AND list_inner_product(v, v) > 0"""


@_register
def p4_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All draws by swap repair: (draw_id, doc_id, category). What p4_found lists follows from counts alone, before any sample is drawn."""
    return draw_samples(table(spark, sf_dir, "docs"), "doc_id", "category", table(spark, sf_dir, "sample_targets"))


@_register
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = target_report(table(spark, sf_dir, "docs"), "doc_id", "category", table(spark, sf_dir, "sample_targets"))
    return report.where("NOT met").select("draw_id", "category")


@_register
def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target: what its share of the sample is, what it needs with its minimum, what there is, and whether that is enough."""
    report = target_report(table(spark, sf_dir, "docs"), "doc_id", "category", table(spark, sf_dir, "sample_targets"))
    return report.select("draw_id", "category", "wanted", "need", "have", "met")


ORACLE["p4_found"] = r"""
    WITH d AS (SELECT doc_id, min(nullif(lower(regexp_extract(category, '^[\s,;|/]*([^\s,;|/]+)', 1)), '')) AS category
               FROM docs WHERE doc_id IS NOT NULL GROUP BY doc_id),
         h AS (SELECT category, count(*) AS have FROM d GROUP BY category), t AS (SELECT count(*) AS total FROM d)
    SELECT draw_id, s.category AS category FROM sample_targets s CROSS JOIN t LEFT JOIN h ON h.category = lower(trim(s.category, chr(32) || chr(9)))
    WHERE coalesce(have, 0) < greatest(min_docs, (total * sample_percent // 100) * target_permille // 1000)"""

ORACLE["p4_report"] = r"""
    WITH d AS (SELECT doc_id, min(nullif(lower(regexp_extract(category, '^[\s,;|/]*([^\s,;|/]+)', 1)), '')) AS category
               FROM docs WHERE doc_id IS NOT NULL GROUP BY doc_id),
         h AS (SELECT category, count(*) AS have FROM d GROUP BY category), t AS (SELECT count(*) AS total FROM d),
         r AS (SELECT draw_id, s.category AS category, (total * sample_percent // 100) * target_permille // 1000 AS wanted, min_docs, coalesce(have, 0) AS have
               FROM sample_targets s CROSS JOIN t LEFT JOIN h ON h.category = lower(trim(s.category, chr(32) || chr(9))))
    SELECT draw_id, category, wanted, greatest(wanted, CAST(min_docs AS BIGINT)) AS need, have, have >= greatest(wanted, CAST(min_docs AS BIGINT)) AS met FROM r"""

GROWING_PERMILLE, GROWING_SHIFT = 50, 271_828_182_845


@_register
def p7_growing_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One doc in twenty, the same in every run; docs that are inserted later add to it and take nothing away.

    The numbers of the docs of `sf_dir` are kept in a register in the shared folder, which this query reads and extends. Its SQL is that of a first run.
    """
    register = f"{shared_dir(spark)}/kestrelite-registers/docs-{hashlib.md5(sf_dir.rstrip('/').encode()).hexdigest()}"
    return growing_sample(table(spark, sf_dir, "docs"), "doc_id", "inserted_at", GROWING_PERMILLE, GROWING_SHIFT, register)


ORACLE["p7_growing_sample"] = f"""
    WITH f AS (SELECT doc_id, min(inserted_at) AS t FROM docs WHERE doc_id IS NOT NULL GROUP BY doc_id),
         s AS (SELECT doc_id, row_number() OVER (ORDER BY t NULLS LAST, doc_id) - 1 AS seq FROM f)
    SELECT doc_id, seq FROM s WHERE (CAST(seq AS HUGEINT) * {STEP} + {GROWING_SHIFT}) % {1 << BITS} < {(1 << BITS) * GROWING_PERMILLE // 1000}"""


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"))


CONTAINER = 2048


@_register
def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_texts(table(spark, sf_dir, "documents"), "doc_id", "text", CONTAINER)


@_register
def p8_room_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many containers there are, how many tokens they hold, the room left over in thousandths, and what placed the tokens, also in thousandths."""
    packed = pack_texts(table(spark, sf_dir, "documents"), "doc_id", "text", CONTAINER)
    by = [F.sum(F.when(F.col("placed") == how, F.col("tokens")).otherwise(0)).alias(how) for how in (WHOLE, SEED, INDEX, FIT)]
    total = packed.agg(F.countDistinct("container_id").alias("containers"), F.sum("tokens").alias("tokens"), *by)
    return total.select("containers", "tokens", F.expr(f"1000 - tokens * 1000 div (containers * {CONTAINER})").alias("room_permille"), *[F.expr(f"{how} * 1000 div tokens").alias(f"{how}_permille") for how in (WHOLE, SEED, INDEX, FIT)])


@_register
def p8_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per doc, whether its tokens are in containers once and without a gap, and how many there are; and how many containers are too full, which is 0."""
    packed = materialize(pack_texts(table(spark, sf_dir, "documents"), "doc_id", "text", CONTAINER), "packed")
    over = packed.groupBy("container_id").agg(F.sum("tokens").alias("n"), F.count(F.lit(1)).alias("pieces"), (F.max("position") + 1).alias("places"))
    over = over.agg(F.count_if((F.col("n") > CONTAINER) | (F.col("pieces") != F.col("places"))).alias("wrong_containers"))  # one row
    each = packed.groupBy("doc_id").agg(F.min("start_token").alias("first"), F.max(F.col("start_token") + F.col("tokens")).alias("last"), F.sum("tokens").alias("tokens"))
    each = each.select("doc_id", ((F.col("first") == 0) & (F.col("last") == F.col("tokens"))).alias("whole"))
    return each.join(F.broadcast(over))


#: Ids are unique in documents, so each has its tokens from 0 to their number in one run.
ORACLE["p8_invariants"] = "SELECT doc_id, TRUE AS whole, CAST(0 AS BIGINT) AS wrong_containers FROM documents WHERE length(text) > 0"


@_register
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("item_id", "doc_id")


@_register
def p9_items_leaked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per test item that leaked: in how many documents."""
    return _leaks(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))


@_register
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subject_areas(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_labels")).select("doc_id", "subject")


@_register
def p10_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each subject has in the corpus, and the mean share of their cues in thousandths."""
    areas = subject_areas(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_labels"))
    return areas.groupBy("subject").agg(F.count(F.lit(1)).alias("documents"), F.floor(F.avg("share") * 1000).alias("mean_share_permille"))


ORACLE["p3_found"] = r"""
    WITH RECURSIVE w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(snippet, '')), '[\p{L}\p{N}]+')) AS word FROM docs WHERE doc_id IS NOT NULL),
      s AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id),
      p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM w a JOIN w b ON a.word = b.word AND a.doc_id < b.doc_id GROUP BY ALL),
      l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE p.n >= 0.6 * (x.n + y.n - p.n)),
      e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
      r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
      SELECT a AS doc_a, b AS doc_b FROM r WHERE a < b"""

ORACLE["p5_found"] = """
    WITH u AS (SELECT DISTINCT doc_id, CAST(vector AS DOUBLE[]) AS v FROM docs WHERE doc_id IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      n AS (SELECT doc_id, v, sqrt(list_inner_product(v, v)) AS n FROM u WHERE list_inner_product(v, v) > 0),
      s AS (SELECT a.doc_id AS a, b.doc_id AS b, list_inner_product(a.v, b.v) / (a.n * b.n) AS s FROM n a JOIN n b ON a.doc_id <> b.doc_id),
      k AS (SELECT a, b FROM (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM s WHERE s >= 0.93) WHERE r <= 10)
      SELECT DISTINCT least(a, b) AS doc_a, greatest(a, b) AS doc_b FROM k"""

ORACLE["p3_groups"] = ORACLE["p3_found"].replace("SELECT a AS doc_a, b AS doc_b FROM r WHERE a < b", "SELECT a AS doc_id, min(b) AS group_id, count(*) AS group_size FROM r GROUP BY a")
