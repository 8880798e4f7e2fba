"""Health of nodes, failover, membership commands and replay of a replicated log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrelite.operators.ordered import fold_slices, sliced, with_lag, with_number, with_running

SUSPECT, DOWN = 2, 5
HEALTHS = ("HEALTHY", "SUSPECT", "DOWN")


def health_states(probes: DataFrame, node: str, order: list[str], alive: str) -> DataFrame:
    """Each probe with the `misses` in a row up to it, the node's `state` after it and `before` it, and whether it was `ever_healthy` by then.

    Two misses in a row make a node suspect, five make it down, any answer makes it healthy. The streak is the distance to the last answer, so no
    node's probes have to be folded in one task.
    """
    p = with_number(sliced(probes, [node], order), [node], order, "_k")
    p = with_running(p, [node], order, "_ok", F.when(F.col(alive), F.col("_k")).otherwise(F.lit(0)), "max")
    p = p.withColumn("misses", (F.col("_k") - F.col("_ok")).cast("long"))
    state = F.when(F.col("misses") >= DOWN, "DOWN").when(F.col("misses") >= SUSPECT, "SUSPECT").otherwise("HEALTHY")
    p = p.withColumn("state", state).withColumn("ever_healthy", F.col("_ok") > 0)
    p = with_lag(p, [node], order, {"before": "state"}).withColumn("before", F.coalesce("before", F.lit("HEALTHY")))
    return p.drop("_k", "_ok", "_slice")


def _moments(rows: DataFrame, at: str) -> tuple[list[str], list[Column]]:
    """(names, columns) of an order that is one column or a struct of several."""
    kind = rows.schema[at].dataType
    parts = [f"{at}.{n}" for n in kind.fieldNames()] if kind.typeName() == "struct" else [at]
    names = [f"_at{i}" for i in range(len(parts))]
    return names, [F.col(p).alias(n) for p, n in zip(parts, names, strict=True)]


def fold_failovers(changes: DataFrame) -> DataFrame:
    """(shard_id, primary, backup, epoch, failovers) after all changes of state.

    changes: (shard_id, at, is_a, state, ever_healthy), one row per change of state of one of a shard's two nodes, a and b; a is primary at first.
    The roles swap when the primary goes down that was ever healthy, if the backup is healthy then; a primary that goes down while its backup
    isn't healthy isn't tried again. Only changes are folded, not probes, and those of a shard slice by slice: for each of the 18 states that a pair of
    nodes can be in, a slice says where it leads.
    """
    moments, at = _moments(changes, "at")
    flat = changes.select("shard_id", *at, "is_a", "state", "ever_healthy")
    order = [*moments, "is_a"]

    def summarise(table) -> list[tuple[str, str, int]]:
        rows = list(zip(table["is_a"].to_pylist(), table["state"].to_pylist(), table["ever_healthy"].to_pylist(), strict=True))
        out = []
        for a_first in (True, False):
            for a in HEALTHS:
                for b in HEALTHS:
                    first, x, y, n = a_first, a, b, 0
                    for is_a, state, ever in rows:
                        if state == "DOWN" and ever and is_a == first and (y if is_a else x) == "HEALTHY":
                            first, n = not first, n + 1
                        x, y = (state, y) if is_a else (x, state)
                    out.append((f"{'a' if a_first else 'b'} {a} {b}", f"{'a' if first else 'b'} {x} {y}", n))
        return out

    out = fold_slices(sliced(flat, ["shard_id"], order), "shard_id", order, summarise, "a HEALTHY HEALTHY")
    first = F.substring("state", 1, 1)
    return out.select("shard_id", first.alias("primary"), F.when(first == "a", "b").otherwise("a").alias("backup"), (F.col("applied") + 1).cast("int").alias("epoch"), F.col("applied").cast("int").alias("failovers"))


def replay_cas(entries: DataFrame, log: str, at: str, expected: str, proposed: str, first: int) -> DataFrame:
    """(log, entries, applied, value): a log of compare-and-set entries replayed in order; an entry is applied if its expected value is current.

    Slice by slice, and within a slice from its last entry backwards: what an expected value leads to is what the entry's proposal leads to after it, so
    a slice is summed up in one pass, by as many values as its entries expect.
    """
    order, moments = _moments(entries, at)
    flat = entries.select(F.col(log), *moments, F.col(expected).cast("long").alias("e"), F.col(proposed).cast("long").alias("p"))

    def summarise(table) -> list[tuple[str, str, int]]:
        leads: dict[int, tuple[int, int]] = {}
        for e, p in zip(reversed(table["e"].to_pylist()), reversed(table["p"].to_pylist()), strict=True):
            if e is not None and p is not None:  # an entry without either is never applied
                to, n = leads.get(p, (p, 0))
                leads[e] = (to, n + 1)
        return [(str(e), str(to), n) for e, (to, n) in leads.items()]

    out = fold_slices(sliced(flat, [log], order), log, order, summarise, str(first))
    n = entries.groupBy(log).agg(F.count(F.lit(1)).alias("entries"))
    return n.join(out, log, "left").select(log, "entries", F.coalesce("applied", F.lit(0)).alias("applied"), F.coalesce(F.col("state").cast("long"), F.lit(first)).alias("value"))


def apply_commands(shard_map: DataFrame, commands: DataFrame) -> DataFrame:
    """Membership commands (shard_id, at, verb, node) against the newest map: the outcome of each, and the map's epoch after it.

    `add` needs a shard without a backup and a node that isn't its primary; `remove` needs the node to be the backup. Each success raises the epoch
    by one; a refused command changes nothing. Commands on one shard are few and folded in order; epochs count successes over all shards.
    """
    log = commands.groupBy("shard_id").agg(F.array_sort(F.collect_list(F.struct("at", "verb", "node"))).alias("log"))
    at = shard_map.select("shard_id", "primary_node", "backup_node", "epoch")
    joined = log.join(at, "shard_id", "left")
    start = F.struct(F.col("backup_node").alias("backup"), F.array().cast("array<struct<at:bigint,verb:string,node:string,ok:boolean>>").alias("out"))

    def step(s: Column, e: Column) -> Column:
        known = F.col("primary_node").isNotNull()
        add = known & (e["verb"] == "add") & s["backup"].isNull() & (e["node"] != F.col("primary_node"))
        remove = known & (e["verb"] == "remove") & s["backup"].isNotNull() & (e["node"] == s["backup"])
        done = F.struct(e["at"].cast("long").alias("at"), e["verb"].alias("verb"), e["node"].alias("node"), F.coalesce(add | remove, F.lit(False)).alias("ok"))
        return F.struct(F.when(add, e["node"]).when(remove, F.lit(None).cast("string")).otherwise(s["backup"]).alias("backup"), F.concat(s["out"], F.array(done)).alias("out"))

    each = joined.select("shard_id", "epoch", F.explode(F.aggregate("log", start, step)["out"]).alias("c")).select("shard_id", "epoch", "c.*")
    ranked = with_running(sliced(each, [], ["at", "shard_id"]), [], ["at", "shard_id"], "_done", F.when(F.col("ok"), F.lit(1)).otherwise(F.lit(0)), "sum")
    newest = shard_map.agg(F.max("epoch").alias("_e"))
    return ranked.join(F.broadcast(newest)).select("at", "shard_id", "verb", "node", "ok", (F.col("_e") + F.col("_done")).alias("epoch"))


def map_changes(shard_map: DataFrame, from_epoch: int = 0) -> DataFrame:
    """(epoch, shard_id, was, now, swapped): what each epoch from `from_epoch` on changes against the one before it; the first epoch changes nothing.

    Epochs are few, one row each; an epoch is told once, and never after a later one.
    """
    from pyspark.sql import Window

    epochs = shard_map.select("epoch").where("epoch IS NOT NULL").distinct().withColumn("before", F.lag("epoch").over(Window.orderBy("epoch")))
    new = shard_map.join(F.broadcast(epochs.where(F.col("epoch") >= from_epoch)), "epoch").select("epoch", "before", "shard_id", "primary_node", "backup_node")
    old = shard_map.select(F.col("epoch").alias("before"), "shard_id", F.col("primary_node").alias("was"), F.col("backup_node").alias("was_backup"))
    both = new.join(old, ["before", "shard_id"]).where("NOT (primary_node <=> was AND backup_node <=> was_backup)")
    return both.select("epoch", "shard_id", "was", F.col("primary_node").alias("now"), (F.col("primary_node") == F.col("was_backup")).alias("swapped"))


def map_after(shard_map: DataFrame, shard: int, verb: str, node: str) -> DataFrame:
    """The map of the next epoch, after a command on `shard` that `apply_commands` accepted."""
    newest = shard_map.join(F.broadcast(shard_map.agg(F.max("epoch").alias("epoch"))), "epoch")  # one row
    backup = F.when(F.col("shard_id") == shard, F.lit(node if verb == "add" else None).cast("string")).otherwise(F.col("backup_node"))
    return newest.withColumn("epoch", F.col("epoch") + 1).withColumn("backup_node", backup).select(*shard_map.columns)
