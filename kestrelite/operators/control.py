"""Control-plane analytics: query storms under injected faults, failover reports, quorum, safety audits of replicated logs, members, stages.

Defined results: null keys are a key of their own, ties are named at each function, empty tables give empty results (a report of no samples is one row
of zeros that didn't pass).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrelite.functions.scalars import TRACE_LEVELS, uniform_of
from kestrelite.operators.ordered import sliced, with_number, with_running


def query_storm(spark: SparkSession, qps: int, seconds: float, texts: list[str]) -> DataFrame:
    """(i, t, text): queries at a fixed rate, texts in turn. The schedule doesn't wait for answers."""
    pool = F.array(*[F.lit(t) for t in texts])
    i = spark.range(int(qps * seconds)).select(F.col("id").alias("i"))
    return i.select("i", (F.col("i") / qps).alias("t"), F.element_at(pool, (F.col("i") % len(texts)).cast("int") + 1).alias("text"))


def storm_samples(storm: DataFrame, shards: DataFrame, faults: DataFrame, base_ms: Column, seed: str = "fault") -> DataFrame:
    """(i, t, text, ok, answered, probed, missing, latency_ms) of a storm (i, t, text) over `shards` (shard_id) under `faults` (at, shard_id, kind, amount).

    Of each kind the last fault before a query holds, and none from before the last `clear`: `pause` holds answers back until at + amount ms, `slow` adds
    amount ms, `drop` loses an answer with probability amount, by a hash of query and shard. Shards are asked at once, so a query takes as long as the
    slowest one that answers. Faults are few, and are folded per shard; a query whose shards all fail has no coverage and isn't ok.
    """
    log = faults.groupBy("shard_id").agg(F.array_sort(F.collect_list(F.struct("at", "kind", "amount"))).alias("log"))
    asked = storm.join(F.broadcast(shards.select("shard_id").join(log, "shard_id", "left")), how="cross")  # each query asks each shard of the map
    past = F.filter(F.coalesce("log", F.array().cast("array<struct<at:double,kind:string,amount:double>>")), lambda f: f["at"] <= F.col("t"))
    cleared = F.coalesce(F.array_max(F.transform(F.filter("past", lambda f: f["kind"] == "clear"), lambda f: f["at"])), F.lit(-1.0))
    asked = asked.withColumn("past", past).withColumn("since", cleared)
    last = lambda kind: F.try_element_at(F.filter("past", lambda f: (f["kind"] == kind) & (f["at"] > F.col("since"))), F.lit(-1))
    for kind in ("pause", "slow", "drop"):
        asked = asked.withColumn(kind, last(kind))
    wait = F.greatest(F.lit(0.0), F.coalesce((F.col("pause.at") - F.col("t")) * 1000 + F.col("pause.amount"), F.lit(0.0)))
    lost = F.coalesce(uniform_of(F.lit(seed), F.col("i"), F.col("shard_id")) < F.col("drop.amount"), F.lit(False))
    asked = asked.withColumn("lost", lost).withColumn("ms", base_ms + wait + F.coalesce("slow.amount", F.lit(0.0)))
    out = asked.groupBy("i", "t", "text").agg(F.count(F.lit(1)).alias("probed"), F.count_if(~F.col("lost")).alias("answered"), F.array_sort(F.collect_list(F.when(F.col("lost"), F.col("shard_id")))).alias("missing"), F.max(F.when(~F.col("lost"), F.col("ms"))).alias("ms"))
    return out.select("i", "t", "text", (F.col("answered") > 0).alias("ok"), "answered", "probed", "missing", F.coalesce("ms", base_ms).alias("latency_ms"))


def element_at_share(rows: DataFrame, value: str, permille: int) -> DataFrame:
    """One row, the element at min(n - 1, floor(n x permille / 1000)) in order of `value`; no row if there is none. Values are counted first."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    run = with_running(sliced(counted, [], ["v"]), [], ["v"], "upto", F.col("n"), "sum")
    total = counted.agg(F.sum("n").alias("total"))  # one row
    at = F.least(F.col("total") - 1, F.expr(f"total * {permille} div 1000"))
    return run.join(F.broadcast(total)).where((F.col("upto") > at) & (F.col("upto") - F.col("n") <= at)).select(F.col("v").alias(value))


def failover_report(samples: DataFrame, kill_at: float, shards: int, recovers: bool = True, tail_s: float = 3.0, most_s: float = 5.0, floor_ms: float = 50.0) -> DataFrame:
    """One row on a run (t, ok, answered, probed, missing, latency_ms) with a fault at `kill_at`, and whether it passed.

    No query may fail; coverage has to be exact (every shard probed, no more answers than probes, a shortfall names shards, full coverage names none).
    With `recovers`, the last partial answer has to come within `most_s` of the fault, and the p99 of the last `tail_s` seconds has to be within
    `floor_ms` or four times the p99 before the fault; without, no answer may be partial. p99 is the element at min(n - 1, floor(0.99 n)).
    """
    part, missing = F.col("answered") < F.col("probed"), F.coalesce(F.size("missing"), F.lit(0))
    good = F.col("ok")
    facts = samples.agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(~good).alias("failed"), F.count_if(good & (F.col("probed") != shards)).alias("misprobed"), F.count_if(good & (F.col("answered") > F.col("probed"))).alias("impossible"),
        F.count_if(good & part & (missing <= 0)).alias("unnamed"), F.count_if(good & (F.col("answered") == F.col("probed")) & (missing > 0)).alias("contradicted"),
        F.count_if(good & part & (F.col("t") >= kill_at)).alias("degraded"), F.max(F.when(good & part & (F.col("t") >= kill_at), F.col("t"))).alias("last_partial"), F.max("t").alias("last"),
    )
    last = facts.select("last")
    before = element_at_share(samples.where(F.col("t") < kill_at), "latency_ms", 990).select(F.col("latency_ms").alias("before_p99"))
    tail = element_at_share(samples.join(F.broadcast(last)).where(F.col("t") >= F.col("last") - tail_s), "latency_ms", 990).select(F.col("latency_ms").alias("tail_p99"))
    one = facts.withColumn("_k", F.lit(1)).join(before.withColumn("_k", F.lit(1)), "_k", "left").join(tail.withColumn("_k", F.lit(1)), "_k", "left").drop("_k")  # one row each
    one = one.withColumn("before_p99", F.coalesce("before_p99", F.lit(0.0))).withColumn("tail_p99", F.coalesce("tail_p99", F.lit(0.0)))
    one = one.withColumn("recovery_s", F.coalesce(F.col("last_partial") - kill_at, F.lit(0.0)))
    exact = (F.col("samples") > 0) & (F.col("failed") + F.col("misprobed") + F.col("impossible") + F.col("unnamed") + F.col("contradicted") == 0)
    back = (F.col("recovery_s") < most_s) & (F.col("tail_p99") <= F.greatest(F.lit(floor_ms), F.col("before_p99") * 4)) if recovers else F.col("degraded") == 0
    return one.select("samples", "failed", "misprobed", "impossible", "unnamed", "contradicted", "degraded", "recovery_s", "before_p99", "tail_p99", (exact & back).alias("passed"))


def quorum_commit(match: DataFrame, log: DataFrame, group: str) -> DataFrame:
    """(group, majority_index, commit_index): the highest entry that a majority has and that is of the leader's current term; 0 if there is none.

    match: (group, match_index), a row per member, the leader with its own last index; log: (group, index, term), the leader's. Entries of earlier terms
    aren't committed by counting, only with a later one. Members of a group are few.
    """
    ranked = match.groupBy(group).agg(F.sort_array(F.collect_list("match_index"), asc=False).alias("m"))
    reached = ranked.select(group, F.element_at("m", (F.size("m") / 2).cast("int") + 1).alias("majority_index"))
    term = log.groupBy(group).agg(F.max("term").alias("term"))
    of = log.join(term, [group, "term"]).join(reached, group).where("index <= majority_index").groupBy(group).agg(F.max("index").alias("commit_index"))
    return reached.join(of, group, "left").select(group, "majority_index", F.coalesce("commit_index", F.lit(0)).alias("commit_index"))


def leader_conflicts(claims: DataFrame, group: str) -> DataFrame:
    """(group, term, leaders): terms with more than one leader. claims: (group, term, member), a row whenever a member said that it leads."""
    return claims.groupBy(group, "term").agg(F.countDistinct("member").alias("leaders")).where("leaders > 1")


def log_mismatches(entries: DataFrame, group: str) -> DataFrame:
    """(group, a, b, diverged_at, agreed_at): pairs of members whose logs have the same term again after an index where they differ.

    entries: (group, member, index, term). Two logs that share an entry's index and term have to agree up to it, so the last index with equal terms
    can't lie after the first one with different terms: two aggregates tell, and no log is held as a whole. Members of a group are few.
    """
    a = entries.select(group, "index", F.col("member").alias("a"), F.col("term").alias("ta"))
    b = entries.select(group, "index", F.col("member").alias("b"), F.col("term").alias("tb"))
    both = a.join(b, [group, "index"]).where("a < b")
    out = both.groupBy(group, "a", "b").agg(F.min(F.when(F.col("ta") != F.col("tb"), F.col("index"))).alias("diverged_at"), F.max(F.when(F.col("ta") == F.col("tb"), F.col("index"))).alias("agreed_at"))
    return out.where("agreed_at > diverged_at")


def commit_conflicts(entries: DataFrame, group: str) -> DataFrame:
    """(group, index, versions): indexes that were committed with different entries. entries: (group, member, index, term, epoch), committed ones."""
    return entries.groupBy(group, "index").agg(F.countDistinct(F.struct("term", "epoch")).alias("versions")).where("versions > 1")


def member_panel(reports: DataFrame, group: str, stale: float) -> DataFrame:
    """(group, member, role, term, down, leads) by each member's last report (group, member, role, term, seen in seconds; ties to the higher term).

    A member is down that was silent for more than `stale` seconds before the group's last report. The leader is the live member that says so in the
    highest term of the live ones; one that still says so in an older term, or is down, doesn't lead.
    """
    last = reports.groupBy(group, "member").agg(F.max_by(F.struct("role", "term"), F.struct("seen", "term", "role")).alias("r"), F.max("seen").alias("seen"))
    now = last.groupBy(group).agg(F.max("seen").alias("now"))
    last = last.join(now, group).select(group, "member", "r.role", "r.term", (F.col("now") - F.col("seen") > stale).alias("down"))
    top = last.where("NOT down").groupBy(group).agg(F.max("term").alias("top"))
    return last.join(top, group, "left").select(group, "member", "role", "term", "down", (~F.col("down") & (F.col("role") == "leader") & (F.col("term") == F.col("top"))).alias("leads"))


def stage_spans(answers: DataFrame) -> DataFrame:
    """(trace_id, kind, t_start_us, t_end_us) of each answer (trace_id, level, timings): the spans that its trace level lets out.

    Stages follow each other in the order of the timings; a missing number is zero. Level NONE emits nothing; the walk of a shard itself comes out at FULL
    only, as a trace beside the spans, and isn't made here.
    """
    z = lambda c: F.coalesce(F.col(f"timings.{c}"), F.lit(0)).cast("long")
    rank = F.lit(None).cast("int")
    for name, level in TRACE_LEVELS.items():
        rank = F.when(F.col("level") == name, level).otherwise(rank)
    held = answers.where(rank >= TRACE_LEVELS["TRACE_SPANS"]).select("trace_id", z("embed_us").alias("e"), z("plan_us").alias("p"), z("fanout_us").alias("f"), z("merge_us").alias("m"), z("total_us").alias("t"))
    e, p, f, m = (F.col(c) for c in "epfm")
    zero = F.lit(0).cast("long")
    stages = [("SPAN_QUERY_RECEIVED", zero, zero), ("SPAN_EMBED", zero, e), ("SPAN_PLAN", e, e + p), ("SPAN_SHARD_RPC", e + p, e + p + f), ("SPAN_MERGE", e + p + f, e + p + f + m), ("SPAN_QUERY_DONE", zero, F.col("t"))]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), a.alias("t_start_us"), b.alias("t_end_us")) for k, a, b in stages]))
    return held.select("trace_id", each.alias("s")).select("trace_id", "s.*")


def overhead_by_level(latencies: DataFrame) -> DataFrame:
    """(level, n, p50_us, over_percent): the median time (level, us) of each trace level, and by how much it lies above TRACE_NONE's."""
    g = latencies.groupBy("level").agg(F.count("us").alias("n"), F.percentile("us", 0.5).alias("p50_us"))
    base = g.where("level = 'TRACE_NONE'").select(F.col("p50_us").alias("base")).limit(1)
    return g.withColumn("_k", F.lit(1)).join(base.withColumn("_k", F.lit(1)), "_k", "left").select("level", "n", "p50_us", (100 * (F.col("p50_us") - F.col("base")) / F.col("base")).alias("over_percent"))


def publish_batches(events: DataFrame, node: str, time_ns: str, order: list[str], most: int = 512, flush_ms: int = 50) -> DataFrame:
    """`events` with the `window` and `batch` that publish them: every `flush_ms`, at most `most` a batch, in order."""
    held = events.withColumn("window", F.expr(f"`{time_ns}` div {flush_ms * 1_000_000}"))
    by = [node, "window"]
    numbered = with_number(sliced(held, by, order), by, order, "_i")
    return numbered.withColumn("batch", F.expr(f"(_i - 1) div {most}")).drop("_i", "_slice")


def ring_drops(events: DataFrame, node: str, time_ns: str, order: list[str], capacity: int, flush_ms: int = 50) -> DataFrame:
    """(node, kept, dropped): what a bounded buffer that is emptied every `flush_ms` lets through. It holds `capacity` events, rounded up to a power of two;
    when it is full the newest are dropped and counted."""
    most = 1 << max(0, capacity - 1).bit_length()
    held = events.withColumn("window", F.expr(f"`{time_ns}` div {flush_ms * 1_000_000}"))
    by = [node, "window"]
    place = with_number(sliced(held, by, order), by, order, "_i")
    return place.groupBy(node).agg(F.count_if(F.col("_i") <= most).alias("kept"), F.count_if(F.col("_i") > most).alias("dropped"))


def live_frames(batches: DataFrame, at_ms: str, order: list[str], flush_ms: int = 33, cap: int = 1000) -> DataFrame:
    """(flush, topic, events, dropped): what a subscriber gets at each flush: one frame a topic, and how many batches were dropped from its queue.

    batches: (`at_ms`, topic, events), in `order`. The queue is emptied at each flush and holds the last `cap` batches; each batch beyond it is one drop,
    told in a notice (topic `meta`, without events) after the frames.
    """
    held = batches.withColumn("flush", F.expr(f"`{at_ms}` div {flush_ms}"))
    numbered = with_number(sliced(held, ["flush"], order), ["flush"], order, "_i").drop("_slice")
    n = held.groupBy("flush").agg(F.count(F.lit(1)).alias("_n"))
    kept = numbered.join(n, "flush").where(F.col("_i") > F.col("_n") - cap)
    frames = kept.groupBy("flush", "topic").agg(F.sum("events").alias("events")).withColumn("dropped", F.lit(0).cast("long"))
    notices = n.where(F.col("_n") > cap).select("flush", F.lit("meta").alias("topic"), F.lit(0).cast("long").alias("events"), (F.col("_n") - cap).alias("dropped"))
    return frames.union(notices)


def live_nodes(events: DataFrame, node: str, order: list[str]) -> DataFrame:
    """(node, state, building): the last state that a node told, in statistics or as a change, and whether its build is still under way.

    events: (node, order columns, stats_state, to_state). A build is told by statistics in NODE_STATE_LOADING, and a change to NODE_STATE_SERVING ends it.
    """
    told = F.coalesce("stats_state", "to_state")
    at = F.struct(*order)
    g = events.groupBy(node).agg(
        F.max_by(F.when(told.isNotNull(), told), F.when(told.isNotNull(), at)).alias("state"), F.max(F.when(F.col("stats_state") == "NODE_STATE_LOADING", at)).alias("_build"),
        F.max(F.when(F.coalesce("to_state", "stats_state") == "NODE_STATE_SERVING", at)).alias("_serving"),
    )
    building = F.col("_build").isNotNull() & (F.col("_serving").isNull() | (F.col("_build") > F.col("_serving")))
    return g.select(node, "state", building.alias("building"))


def build_progress(rows: DataFrame, shard: str, order: list[str], every: int = 512) -> DataFrame:
    """(shard, inserted, total): a report after every `every` rows of a shard, and one after its last."""
    numbered = with_number(sliced(rows.select(shard, *order), [shard], order), [shard], order, "inserted")
    total = rows.groupBy(shard).agg(F.count(F.lit(1)).alias("total"))
    return numbered.join(total, shard).where((F.col("inserted") % every == 0) | (F.col("inserted") == F.col("total"))).select(shard, "inserted", "total")


def log_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """(kept, dropped, appended, rewrite): what has to be written so that a stored log (index, term, entry) becomes another.

    Entries before the first difference stay. If the stored log goes on behind it, it diverged and is written anew; else the rest is appended.
    """
    both = before.select("index", F.struct("term", "entry").alias("was")).join(after.select("index", F.struct("term", "entry").alias("now")), "index", "full_outer")
    first = both.where("NOT (was <=> now)").agg(F.min("index").alias("first"))  # one row
    out = both.join(F.broadcast(first))
    same = F.col("first").isNull() | (F.col("index") < F.col("first"))
    counts = out.agg(F.count_if(same).alias("kept"), F.count_if(~same & F.col("was").isNotNull()).alias("dropped"), F.count_if(~same & F.col("now").isNotNull()).alias("appended"))
    return counts.withColumn("rewrite", F.col("dropped") > 0)


def trace_lookup(spans: DataFrame, traces: DataFrame, order: list[str]) -> DataFrame:
    """`spans` of the given traces (trace_id) with their `place`, oldest first. A trace has few spans."""
    found = spans.join(traces.select("trace_id").distinct(), "trace_id", "left_semi")
    return found.withColumn("place", F.row_number().over(Window.partitionBy("trace_id").orderBy(*order)))
