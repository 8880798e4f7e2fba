"""Samples whose shares of categories match given proportions, by swap repair.

Per draw: records are grouped by signature, here their category, and only counts per signature are worked on. The start is a random sample of
the right size that has each category's minimum; then members are exchanged between signatures, each time the exchange that lowers the total
deviation from the targets most, until none lowers it. The counts are then made real by taking, per signature, the records of smallest hash.

The counts per wanted category come to the driver: at most as many rows as there are targets. The cut-off hash of a (draw, category) is found by a
histogram of the hashes' upper bits; only the records of the one bucket with the cut-off are ranked, so no category, however large, is sorted.

Defined results: an id counts once, with its smallest category if it has several; null, empty or unknown categories count to N and fill up a
sample where targets leave room, under no target; ties of hashes go to the smaller id; a draw from no records is empty and each target with a
need above 0 is reported as not met.
"""

from __future__ import annotations

import random
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrelite.scratch import materialize

BUCKETS = 4096
#: Targets are a table made by hand: they come to the driver, and more than these are an error.
MOST_TARGETS = 100_000
OTHER = ""


def first_code(column: str) -> F.Column:
    """The first code of a list of codes, in lower case, without blanks or tabs; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(F.col(f"`{column}`"), r"^[\s,;|/]*([^\s,;|/]+)", 1)), F.lit(OTHER))


def members(rows: DataFrame, id_column: str, category_column: str) -> DataFrame:
    """(doc_id, category), once per id."""
    held = rows.select(F.col(f"`{id_column}`").alias("doc_id"), first_code(category_column).alias("category")).where("doc_id IS NOT NULL")
    return held.groupBy("doc_id").agg(F.coalesce(F.min(F.when(F.col("category") != OTHER, F.col("category"))), F.lit(OTHER)).alias("category"))


def repair(have: dict[str, int], targets: dict[str, tuple[int, int]], size: int, seed: int) -> dict[str, int]:
    """How many to take of each signature. have: members; targets: category to (wanted, minimum); sums to min(size, all members)."""
    rng = random.Random(seed)
    total = sum(have.values())
    size = min(size, total)
    wanted = {c: targets.get(c, (0, 0))[0] for c in have}
    floor = {c: min(have[c], targets[c][1]) if c in targets else 0 for c in have}
    take = dict(floor)
    left = size - sum(take.values())
    names = sorted(have)
    if left < 0:  # minima beyond the size of the sample: the largest ones give way
        for c in sorted(names, key=lambda c: (-take[c], c)):
            cut = min(take[c], -left)
            take[c] -= cut
            left += cut
        floor = dict.fromkeys(have, 0)
    pool = {c: have[c] - take[c] for c in names}
    # A random start: the rest of the sample falls on the signatures in proportion to what they have, up to chance.
    free = sum(pool.values())
    for c in names:
        k = min(pool[c], left, int(left * pool[c] / free + rng.random())) if free else 0
        free -= pool[c]
        take[c] += k
        left -= k
    for c in names:
        k = min(have[c] - take[c], left)
        take[c] += k
        left -= k
    while True:  # exchange members of the most over-filled signature for those of the most under-filled one
        over = [c for c in names if take[c] > max(wanted[c], floor[c])]
        under = [c for c in names if take[c] < min(wanted[c], have[c])]
        if not over or not under:
            return take
        a, b = max(over, key=lambda c: (take[c] - wanted[c], c)), max(under, key=lambda c: (wanted[c] - take[c], c))
        k = min(take[a] - max(wanted[a], floor[a]), min(wanted[b], have[b]) - take[b])
        take[a] -= k
        take[b] += k


def plan_draws(who: DataFrame, targets: DataFrame, seed: int = 0) -> tuple[list[tuple], list[tuple]]:
    """(draw_id, category, wanted, need, have, take, met) of all targets, and (draw_id, category, take) of everything that is taken."""
    rows = [r.asDict() for r in targets.limit(MOST_TARGETS + 1).collect()]
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    wanted_names = {str(r["category"] or "").strip(" \t").lower() for r in rows}
    named = who.withColumn("category", F.when(F.col("category").isin(*sorted(wanted_names)), F.col("category")).otherwise(F.lit(OTHER)))
    have = {r["category"]: r["n"] for r in named.groupBy("category").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(have.values())
    report, taken = [], []
    draws: dict[int, list[dict]] = defaultdict(list)
    for r in rows:
        draws[r["draw_id"]].append(r)
    for draw, of in sorted(draws.items()):
        n = total * of[0]["sample_percent"] // 100
        want = {}
        for r in of:
            c = str(r["category"] or "").strip(" \t").lower()
            share = n * r["target_permille"] // 1000
            want[c] = (max(share, r["min_docs"]), r["min_docs"])
        take = repair(have, want, n, seed * 1_000_003 + draw)
        for r in of:
            c = str(r["category"] or "").strip(" \t").lower()
            need = want[c][0]
            report.append((draw, r["category"], n * r["target_permille"] // 1000, need, have.get(c, 0), take.get(c, 0), have.get(c, 0) >= need))
        taken += [(draw, c, k) for c, k in take.items() if k]
    return report, taken


REPORT = "draw_id int, category string, wanted long, need long, have long, take long, met boolean"


def target_report(rows: DataFrame, id_column: str, category_column: str, targets: DataFrame, seed: int = 0) -> DataFrame:
    """A row per target: what it needs, what there is, what the sample takes, and whether the records can meet it."""
    report, _ = plan_draws(members(rows, id_column, category_column), targets, seed)
    return rows.sparkSession.createDataFrame(report, REPORT)


def draw_samples(rows: DataFrame, id_column: str, category_column: str, targets: DataFrame, seed: int = 0) -> DataFrame:
    """(draw_id, doc_id, category) of all draws; category is empty for records under no target."""
    spark = rows.sparkSession
    who = materialize(members(rows, id_column, category_column), "quota-members")
    report, taken = plan_draws(who, targets, seed)
    names = sorted({c for _, c, _ in taken})
    known = sorted({str(r[1] or "").strip(" \t").lower() for r in report})
    of = F.when(F.col("category").isin(*known), F.col("category")).otherwise(F.lit(OTHER))
    quota = F.broadcast(spark.createDataFrame(taken, "draw_id int, category string, take long"))  # as many rows as targets, and one a draw
    ranked = who.withColumn("category", of).where(F.col("category").isin(*names)).join(quota, "category")
    ranked = ranked.withColumn("h", F.xxhash64("doc_id", "draw_id", F.lit(seed))).withColumn("bucket", F.shiftrightunsigned("h", 52).cast("int"))
    hist = ranked.groupBy("draw_id", "category", "take", "bucket").agg(F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy("draw_id", "category").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = hist.withColumn("upto", F.sum("n").over(run)).where("upto >= take AND upto - n < take").select("draw_id", "category", F.col("bucket").alias("edge"), (F.col("take") - F.col("upto") + F.col("n")).alias("rest"))
    cut = ranked.join(F.broadcast(edge), ["draw_id", "category"]).where("bucket <= edge")  # a row a quota
    inside = cut.where("bucket < edge").select("draw_id", "doc_id", "category")
    last = Window.partitionBy("draw_id", "category").orderBy("h", "doc_id")
    border = cut.where("bucket = edge").withColumn("r", F.row_number().over(last)).where("r <= rest").select("draw_id", "doc_id", "category")
    return inside.union(border)
