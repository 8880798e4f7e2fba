"""Texts put into containers of a fixed number of tokens, by lexical retrieval packing.

Texts are measured in tokens of a public tokenizer. One longer than a container fills containers of its own; what is left of it, if anything, is an
item like the shorter texts, which are never split. Items are spread over shards of about `shard_items` by hash of id, text and, for repeated rows,
the number of the copy; so containers are the same however the table is partitioned. Each shard has a BM25 inverted index of its items (document
frequencies are those of all documents, by a table of 2^20 counters); nearest means nearest in the shard. The largest unused item is the seed of the
next container; the index returns the unused items nearest to it, which fill the container in that order as they fit. If more than CLOSE tokens
are then left, the last one is exchanged for the nearest unused item that leaves no more than that, or else for the one that leaves least; what
room there still is is filled with the largest items that fit. `placed` says what put a piece where it is: whole (a container of its own), seed,
index (nearness, by words in common), fit (size alone).

Defined results: texts without tokens (null, empty) take no place; each row is a text, also if its id or text repeats, and null ids are kept; ties of
score or size go to the first in order of (id, tokens, terms); empty tables give empty results; texts are read whole.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelite.llm.neardup import SLOTS, WORD, _Hashes
from kestrelite.scratch import materialize

#: Where the vocabulary of the tokenizer lies by default; a parameter of every function here.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that splits text into pieces before byte pairs are merged, as published with these vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TERM = np.dtype([("slot", "<u4"), ("tf", "u1")])
K1, B = 1.2, 0.75


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    return tiktoken.Encoding("kestrelite", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, path: str = TOKENIZER) -> int:
    return len(_encoding(path).encode_ordinary(text))


def _measure(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        encode = _encoding(tokenizer).encode_ordinary
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep, tokens, terms = [], [], []
            for i, text in enumerate(texts):
                n = len(encode(text)) if text else 0
                if n:
                    of = Counter(WORD.findall(text.lower()))
                    row = np.empty(len(of), TERM)
                    row["slot"] = (np.fromiter(map(hashes.__getitem__, of), np.uint64, len(of)) % np.uint64(SLOTS)).astype(np.uint32)
                    row["tf"] = np.minimum(np.fromiter(of.values(), np.int64, len(of)), 255)
                    word = np.array([not w.isdigit() for w in of], bool)  # times and numbers say nothing
                    keep.append(ids[i])
                    tokens.append(n)
                    terms.append(row[word].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.array(tokens, pa.int32()), pa.array(terms, pa.binary())], ["doc_id", "tokens", "terms"])

    return run


def _frequencies(measured: DataFrame) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SLOTS, np.int64)
        for batch in batches:
            flat = np.frombuffer(b"".join(np.unique(np.frombuffer(t, TERM)["slot"]).tobytes() for t in batch.column(0).to_pylist()), np.uint32)
            seen += np.bincount(flat.astype(np.int64), minlength=SLOTS)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], ["slot", "n"])

    total = measured.select("terms").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.int64)  # at most SLOTS rows come back, whatever the collection
    out[total["slot"].to_numpy()] = total["n"].to_numpy()
    return out


class _ShardIndex:
    """BM25 inverted index of a shard: per term the items that have it, with their impacts."""

    def __init__(self, terms: list[np.ndarray], df: np.ndarray, documents: int):
        lengths = np.array([len(t) for t in terms], np.int64)
        size = np.array([t["tf"].astype(np.int64).sum() for t in terms], float)
        item = np.repeat(np.arange(len(terms)), lengths)
        flat = np.concatenate(terms) if terms else np.empty(0, TERM)
        self.slots, term = np.unique(flat["slot"], return_inverse=True)
        tf = flat["tf"].astype(float)
        norm = K1 * (1 - B + B * size / max(size.mean() if len(size) else 1, 1))
        n = df[self.slots.astype(np.int64)]
        self.idf = np.log(1 + (documents - n + 0.5) / (n + 0.5))
        order = np.argsort(term, kind="stable")
        self.items = item[order].astype(np.int32)
        self.impact = (self.idf[term] * tf * (K1 + 1) / (tf + norm[item]))[order].astype(np.float32)
        self.start = np.searchsorted(term[order], np.arange(len(self.slots) + 1))
        self.of = np.split(term, np.cumsum(lengths)[:-1]) if terms else []
        self.count = len(terms)

    def scores(self, seed: int) -> np.ndarray:
        of = np.unique(self.of[seed])
        lo, hi = self.start[of], self.start[of + 1]
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.bincount(self.items[at], self.impact[at], self.count)


WHOLE, SEED, INDEX, FIT = "whole", "seed", "index", "fit"
#: Tokens that may be left over for the sake of nearness.
CLOSE = 16


def fill(sizes: np.ndarray, capacity: int, scores) -> list[list[tuple[int, str]]]:
    """Items (by position, with what placed them) of each container; `scores(seed)` gives each item's nearness to the seed."""
    unused = np.ones(len(sizes), bool)
    out = []
    for seed in np.argsort(-sizes, kind="stable").tolist():
        if not unused[seed]:
            continue
        unused[seed] = False
        taken, room = [(seed, SEED)], capacity - int(sizes[seed])
        fits = np.flatnonzero(unused & (sizes <= room))
        if len(fits):
            near = scores(seed)

            def best_of(may: np.ndarray, space: int, near=near) -> tuple[int, str]:
                close = may[sizes[may] >= space - CLOSE]
                if len(close):
                    i = int(close[near[close].argmax()])
                    return i, INDEX if near[i] > 0 else FIT
                return int(may[sizes[may].argmax()]), FIT

            for i in fits[np.argsort(-near[fits], kind="stable")].tolist():
                if sizes[i] <= room:
                    taken.append((i, INDEX if near[i] > 0 else FIT))
                    unused[i] = False
                    room -= int(sizes[i])
                    if room < 8:
                        break
            if room > CLOSE and len(taken) > 1:  # another last item, if it leaves less room
                last = taken[-1][0]
                may = np.flatnonzero(unused & (sizes <= room + sizes[last]) & (sizes > sizes[last]))
                if len(may):
                    best, how = best_of(may, room + int(sizes[last]))
                    unused[last], unused[best] = True, False
                    room += int(sizes[last] - sizes[best])
                    taken[-1] = (best, how)
            while room:
                may = np.flatnonzero(unused & (sizes <= room))
                if not len(may):
                    break
                best, how = best_of(may, room)
                unused[best] = False
                taken.append((best, how))
                room -= int(sizes[best])
        out.append(taken)
    return out


OUT = "container_id long, position int, doc_id long, start_token int, tokens int, placed string"


def _pack_shard(capacity: int, df, documents: int):
    def run(table: pa.Table) -> pa.Table:
        shard = int(table["shard"][0].as_py())
        ids = table["doc_id"].to_pandas().to_numpy(dtype=object)
        tokens = table["tokens"].to_numpy().astype(np.int64)
        column = table["terms"].to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None or ids[i] != ids[i], ids[i] if ids[i] == ids[i] and ids[i] is not None else 0, tokens[i], column[i]))
        ids, tokens = ids[order], tokens[order]
        whole, rest = tokens // capacity, tokens % capacity
        rows: list[tuple] = []
        number = 0
        for i in np.flatnonzero(whole).tolist():
            for k in range(int(whole[i])):
                rows.append((number, 0, ids[i], k * capacity, capacity, WHOLE))
                number += 1
        items = np.flatnonzero(rest)
        index = _ShardIndex([np.frombuffer(column[order[i]], TERM) for i in items.tolist()], df.value, documents)
        for taken in fill(rest[items], capacity, index.scores):
            for position, (t, how) in enumerate(taken):
                i = int(items[t])
                rows.append((number, position, ids[i], int(whole[i]) * capacity, int(rest[i]), how))
            number += 1
        c = list(zip(*rows, strict=True)) if rows else [[]] * 6
        doc = [None if d is None or d != d else int(d) for d in c[2]]
        return pa.table({"container_id": pa.array([(shard << 32) | n for n in c[0]], pa.int64()), "position": pa.array(c[1], pa.int32()), "doc_id": pa.array(doc, pa.int64()), "start_token": pa.array(c[3], pa.int32()), "tokens": pa.array(c[4], pa.int32()), "placed": pa.array(c[5], pa.string())})

    return run


def _copies(measured: DataFrame) -> DataFrame:
    """`measured` with `copy`, which numbers rows that are alike, so that each of them can go its own way. Only repeated rows are shuffled, once a kind."""
    h = F.xxhash64("doc_id", "tokens", "terms")
    again = measured.groupBy(h.alias("h")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    if not again.limit(1).count():
        return measured.withColumn("copy", F.lit(0).cast("long"))
    again, keyed = materialize(again, "packing-repeats"), measured.withColumn("h", h)
    once = keyed.join(again, "h", "left_anti").select("doc_id", "tokens", "terms", F.lit(0).cast("long").alias("copy"))
    kinds = keyed.join(again, "h", "left_semi").groupBy("doc_id", "tokens", "terms").agg(F.count(F.lit(1)).alias("n"))
    return once.union(kinds.select("doc_id", "tokens", "terms", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy")))


def pack_texts(documents: DataFrame, id_column: str, text_column: str, capacity: int = 2048, tokenizer: str = TOKENIZER, shard_items: int = 2000) -> DataFrame:
    """(container_id, position, doc_id, start_token, tokens): each text, or the piece of it that begins at start_token, and its container."""
    spark = documents.sparkSession
    texts = documents.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))
    measured = materialize(texts.mapInArrow(_measure(tokenizer), "doc_id long, tokens int, terms binary"), "packing")
    n = measured.count()
    df = spark.sparkContext.broadcast(_frequencies(measured))
    shards = max(1, round(n / shard_items))
    spread = _copies(measured).withColumn("shard", F.pmod(F.xxhash64("doc_id", "tokens", "terms", "copy"), F.lit(shards)).cast("int"))
    return spread.groupBy("shard").applyInArrow(_pack_shard(capacity, df, n), OUT)
