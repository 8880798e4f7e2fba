"""Groups of records that share most of their words.

Two records are linked if the distinct words in both are at least `threshold` of the distinct words in either; a group is everything
connected by links. The overlap counts are entries of a sparse matrix product, documents by words (n-grams of one word), computed in blocks of columns:

  1. A table of 2^20 counters holds how many documents have a word (by hash, so a counter is never too low and its size is fixed).
  2. Documents with the same set of words become one class; only classes are multiplied.
  3. Each class has its words in order of rarity, words of no other document last. Common words, of more than 1/64 of the documents, have no columns.
     Of the others only the prefix is multiplied, by the size-derived bound in full: a link leaves at most a - ceil(threshold * a) words of a
     record of a words unmatched, so two linked records that share `ngram` words that aren't common have `ngram` of them in their first
     a - ceil(threshold * a) + ngram words, and no such link can be lost. A shorter prefix is a parameter.
  4. A column, that is a word, goes to a block by hash, and a block, a bounded share of the columns, is multiplied in one task. What a class has
     in a column is a stem: the word and the words after it in the prefix, with size and sketch. Two stems of a column that have another word in
     common, or two where that word has many classes, are one entry of the product; entries that sizes or the 128-bit sketch (each word flips a
     bit, so two sketches differ in at most as many bits as there are words in only one record) rule out are discarded at once.
  5. For the other entries the overlap count is accumulated: all words that both stems have. In the column of the first shared word that is the
     whole overlap of the prefixes, and beyond it only words after a prefix can be shared; a pair whose count plus those can't reach
     threshold / (1 + threshold) of both sizes together is discarded.
  6. Words of more than `STEM` documents have too many stems for a block. Their columns are combinations of `ngram` words of the prefix, written
     out; pairs that share one are discarded by the sketch. A column of more than `hot` classes, of stems `DENSE` times as many, isn't multiplied
     in its block: its rows are cut into sub-blocks, and each pair of sub-blocks is one dense product in a task. One of `huge` classes, too many
     for a block, is found by a sample beforehand and spread over several blocks on its way there.
  7. Two linked records that share fewer than `ngram` other words have nearly the same common words: all words in only one of them are at most
     (1 - threshold) / (1 + threshold) of both sizes together, and nearly all that aren't common are among these. What is left for the common words
     is a sum of two numbers, one of each record (`slack`). If at most e of them may differ, one of e + 1 parts of them is alike: each class has
     an entry for each part, at a few levels of e, and a pair counts at the level of its sum. So no link can be lost here either.
  8. What is left is decided by exact counts over the whole sets of words.

Defined results
  * A null text counts as empty; a record without any word is in no group; a null id is left out.
  * Repeated rows of an id count once if their words agree; if not, the id belongs to the groups of each version, joined into one.
  * Texts of any length are read whole. Empty tables give empty results. Other columns, of any name, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelite.operators.components import connected_components
from kestrelite.scratch import materialize, release

SLOTS = 1 << 20
#: Bytes of one block of columns, as one task holds it.
BLOCK_BYTES = 16 << 20
#: A word of more documents has too many stems for one block.
STEM = 20_000
#: Classes of a column that are paired before all `ngram` words are used.
FEW = 64
#: A word is common, and no column, in more than this share of the records, but not in fewer records than the second number.
COMMON, COMMON_LEAST = 1 / 64, 400
#: The common words are cut into one part more than may differ: up to 2, 5, 9, 15, ... of them, to more than a text can have.
LEVELS = [2, 5, 9]
while LEVELS[-1] < 1 << 31:
    LEVELS.append(int(LEVELS[-1] * 1.62) + 1)
#: A column of stems is compared by sketches in its block up to so many times `hot` classes.
DENSE = 32
WORD = re.compile(r"[^\W_]+")


class _Hashes(dict):
    """Hash by word, kept for words seen before; emptied at a size so that it stays bounded."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(parts: list[str | None]) -> set[str]:
    """The distinct words, the longest runs of letters and digits in lower case."""
    return set(WORD.findall("\n".join(p for p in parts if p).lower()))


def _word_sets(batch: pa.RecordBatch, hashes: _Hashes) -> list[np.ndarray]:
    columns = [batch.column(i).to_pylist() for i in range(1, batch.num_columns)]
    out = []
    for parts in zip(*columns, strict=True):
        words = words_of(list(parts))
        out.append(np.unique(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))))
    return out


def _document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many records have a word, by slot; how many records have any."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = _Hashes(), np.zeros(SLOTS + 1, np.int64)
        for batch in batches:
            sets = _word_sets(batch, hashes)
            if sets:
                seen += np.bincount((np.concatenate(sets) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS + 1)
                seen[SLOTS] += sum(len(s) > 0 for s in sets)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], ["slot", "n"])

    total = docs.mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(SLOTS + 1, np.int64)  # at most SLOTS + 1 rows come back, whatever the collection
    df[total["slot"].to_numpy()] = total["n"].to_numpy()
    return df[:SLOTS], int(df[SLOTS])


def _classes(docs: DataFrame, frequency, most: int) -> DataFrame:
    """(doc_id, cls, size, shared, common, words): the words as 8-byte hashes in order of rarity, the first `shared` of them occurring elsewhere,
    the last `common` of those in more than `most` records."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes, df = _Hashes(), frequency.value
        for batch in batches:
            ids, cls, size, shared, common, words, sketch = [], [], [], [], [], [], []
            for doc_id, s in zip(batch.column(0).to_pylist(), _word_sets(batch, hashes), strict=True):
                if len(s):
                    n = df[(s % np.uint64(SLOTS)).astype(np.int64)]
                    k = int((n > 1).sum())
                    order = np.argsort(np.where(n > 1, n, np.iinfo(np.int64).max), kind="stable")
                    ids.append(doc_id)
                    cls.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63))
                    size.append(len(s))
                    shared.append(k)
                    common.append(int((n > most).sum()))
                    words.append(s[order].tobytes())
                    odd = np.bincount((s >> np.uint64(32)).astype(np.int64) % 128, minlength=128) & 1
                    sketch.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            sketch = np.array(sketch, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cls, pa.int64()), pa.array(size, pa.int32()), pa.array(shared, pa.int32()), pa.array(common, pa.int32()), pa.array(words, pa.binary()), pa.array(sketch[:, 0]), pa.array(sketch[:, 1])], ["doc_id", "cls", "size", "shared", "common", "words", "s0", "s1"])

    return docs.mapInArrow(make, "doc_id long, cls long, size int, shared int, common int, words binary, s0 long, s1 long")


def _combos(n: int, k: int) -> np.ndarray:
    from itertools import combinations

    return np.array(list(combinations(range(n), k)), np.int64).reshape(-1, k)


def _mix(columns: np.ndarray) -> np.ndarray:
    """One 64-bit key for each row of word hashes."""
    key = np.zeros(len(columns), np.uint64)
    for i in range(columns.shape[1]):
        key = (key ^ columns[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def _prefix_of(sizes: np.ndarray, shared: np.ndarray, threshold: float, prefix: int | None, ngram: int) -> np.ndarray:
    bound = np.minimum(sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + ngram, shared)
    return bound if prefix is None else np.minimum(bound, prefix)


def _keys_of(words: list[np.ndarray], sizes: np.ndarray, shared: np.ndarray, threshold: float, prefix: int | None, ngram: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all incidence entries of the given classes, without combinations that begin in the first `skip` words of a class."""
    rows, keys = [], []
    skip = np.zeros(len(sizes), np.int64) if skip is None else skip
    take = _prefix_of(sizes, shared, threshold, prefix, ngram) - skip
    #: Records of two or three words can be linked by fewer words than `ngram`.
    for k, which in ((ngram, take >= ngram), (2, (sizes <= 3) & (ngram > 2)), (1, (sizes <= 2) & (ngram > 1))):
        for n in np.unique(take[which] if k == ngram else shared[which]):
            at = np.flatnonzero(which & ((take if k == ngram else shared) == n))
            combo = _combos(int(n), k)
            if not len(at) or not len(combo):
                continue
            step = max(1, 4_000_000 // len(combo))
            for i in range(0, len(at), step):
                part = at[i : i + step]
                head = np.stack([words[r][(at_word := int(skip[r]) if k == ngram else 0) : at_word + int(n)] for r in part])
                keys.append(_mix(head[:, combo].reshape(-1, k)))
                rows.append(np.repeat(part, len(combo)))
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(rows), np.concatenate(keys)


ENTRY = np.dtype([("key", "<u4"), ("cls", "<i8")])
#: One of the first words of a class; `n` words after it follow elsewhere, and `rest` words that others may have come after the prefix.
HEAD = np.dtype([("cls", "<i8"), ("s0", "<i8"), ("s1", "<i8"), ("size", "<i4"), ("rest", "<i4"), ("word", "<u4"), ("n", "<i4")])
#: A part of the common words of a class; `slack` in quarters.
PART = np.dtype([("key", "<u4"), ("level", "<i2"), ("cls", "<i8"), ("s0", "<i8"), ("s1", "<i8"), ("size", "<i4"), ("slack", "<i4")])
#: What comes out of a block: pairs that the sketch hasn't seen yet, rows of a hot column, pairs that sketch and overlap count allow.
PLAIN, HOT, COUNTED = 0, 1, 2


def _stems(cls: np.ndarray, sketch: np.ndarray, sizes: np.ndarray, shared: np.ndarray, words: list[np.ndarray], take: np.ndarray, skip: np.ndarray, ngram: int) -> tuple[np.ndarray, np.ndarray]:
    """(heads, positions of the words after each in the tail): stems of the first `skip` words of each class. The tail is its words up to `take`."""
    count = np.minimum(skip, np.maximum(take - ngram + 1, 0))
    row = np.repeat(np.arange(len(cls)), count)
    i = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    begin = (np.cumsum(take) - take)[row] + i
    tail = np.concatenate([w[:n] for w, n in zip(words, take.tolist(), strict=True)]).astype(np.uint32)  # the lower half of a hash
    heads = np.empty(len(row), HEAD)
    heads["cls"], heads["s0"], heads["s1"], heads["size"] = cls[row], sketch[row, 0], sketch[row, 1], sizes[row]
    heads["word"], heads["n"], heads["rest"] = tail[begin] if len(row) else 0, take[row] - i - 1, (shared - take)[row]
    return heads, tail[_ranges(begin + 1, heads["n"])] if len(row) else tail[:0]


def _packed(heads: np.ndarray, tail: np.ndarray) -> tuple[bytes, bytes]:
    """Bytes of a place together, of which many are 0 throughout, and 24 bits a word of the tail: one taken for another costs a candidate only."""
    return heads.view(np.uint8).reshape(-1, HEAD.itemsize).T.tobytes(), tail.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def _unpacked(heads: list[bytes], tails: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    place = [np.frombuffer(h, np.uint8).reshape(HEAD.itemsize, -1).T for h in heads]
    three = np.frombuffer(b"".join(tails), np.uint8).reshape(-1, 3)
    tail = np.zeros((len(three), 4), np.uint8)
    tail[:, :3] = three
    return np.ascontiguousarray(np.concatenate(place)).view(HEAD).ravel(), tail.view("<u4").ravel()


def _slack(size, common, threshold: float, ngram: int, floor=np.ceil):
    """Quarters, rounded up, of how many common words a class lets differ: of two linked classes with fewer than `ngram` other words in both, as many as both together."""
    return floor(((1 - threshold) / (1 + threshold) * size - (size - common) + ngram - 1) * 4 - 1e-6)


def _places(frequency: np.ndarray, most: int, records: int) -> np.ndarray:
    """The common words, by slot, numbered from those that tell most apart on: dealt out in turn, they make parts of about the same weight."""
    slots = np.flatnonzero(frequency > most)
    order = np.argsort(np.abs(2 * frequency[slots] - records), kind="stable")
    places = np.zeros(SLOTS, np.int32)
    places[slots[order]] = np.arange(len(slots))
    return places


def _parts(cls: np.ndarray, sketch: np.ndarray, size: np.ndarray, shared: np.ndarray, common: np.ndarray, words: list[np.ndarray], places: np.ndarray, threshold: float, ngram: int, top: int, blocks: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(entries, block), in order of blocks: the common words of each class in parts, at each level that a pair with the class can have."""
    slack = _slack(size, common, threshold, ngram).astype(np.int64)
    # What a class as large as a link allows can have; no class has more than `top`.
    most_both = slack + np.minimum(top, _slack(size / threshold, size / threshold, threshold, ngram)).astype(np.int64)
    # Without common words only classes of fewer than `ngram` / threshold words have a link here, and a single word none that isn't its own class.
    may = (common > 0) | ((size <= (ngram - 1) / threshold) & ((size > 1) | (threshold <= 0.5)))
    least = 0
    for level, most in enumerate(LEVELS):
        left = np.flatnonzero(may & (most_both >= 4 * least))
        if not len(left):
            break
        n, least = most + 1, most + 1
        step = max(1, 500_000 // n)
        for at in np.split(left, range(step, len(left), step)):
            flat = np.concatenate([words[r][shared[r] - common[r] : shared[r]] for r in at])
            turn = places[(flat % np.uint64(SLOTS)).astype(np.int64)] % (2 * n)
            of = np.repeat(np.arange(len(at)), common[at]) * n + np.minimum(turn, 2 * n - 1 - turn)
            total = np.zeros(len(at) * n, np.uint64)
            np.add.at(total, of, flat)
            key = _mix(np.stack([total, np.tile(np.arange(n, dtype=np.uint64), len(at)) + np.uint64(level << 40)], 1))
            entries, row = np.empty(len(key), PART), np.repeat(at, n)
            entries["key"], entries["level"], entries["cls"], entries["s0"], entries["s1"] = key.astype(np.uint32), level, cls[row], sketch[row, 0], sketch[row, 1]
            entries["size"], entries["slack"] = size[row], slack[row]
            block = ((key >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            yield entries[order], block[order]


def _ranges(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers begin, begin + 1, ... of each range, one after another."""
    n = n.astype(np.int64)
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _huge_columns(classes: DataFrame, n: int, huge: int, threshold: float, prefix: int | None, ngram: int, sample_rows: int = 50_000) -> np.ndarray:
    """Columns of about `huge` classes or more, too many for one block, by a bounded sample of the classes. Below `huge` classes there are none.

    One that the sample misses is still handled, only in a larger task; one that it takes wrongly costs time only.
    """
    if n <= huge:
        return np.empty(0, np.uint64)
    part = min(1.0, sample_rows / n)
    taken = classes.select("cls", "size", (F.col("shared") - F.col("common")).alias("rare"), "words").where(F.pmod(F.xxhash64("cls"), F.lit(1 << 20)) < int((1 << 20) * part))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [np.frombuffer(w, np.uint64) for w in batch.column(3).to_pylist()]
            keys = _keys_of(words, batch.column(1).to_numpy().astype(np.int64), batch.column(2).to_numpy().astype(np.int64), threshold, prefix, ngram)[1]
            at, count = np.unique(keys, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), pa.array(count)], ["key", "n"])

    found = taken.mapInArrow(emit, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= max(2, int(huge * part))).select("key")
    return np.sort(found.toArrow()["key"].to_numpy().view(np.uint64))  # at most the sample's entries over that count


def _blocks(classes: DataFrame, blocks: int, threshold: float, prefix: int | None, ngram: int, huge: np.ndarray, salts: int, frequency, stem: int, most: int, records: int, top: int) -> DataFrame:
    """(block, entries, tail): the incidence matrix by blocks of columns; a few large binary rows instead of one row an entry.

    Entries of huge columns are spread by class over `salts` further blocks, numbered from `blocks` on. Words of at most `stem` documents
    have stems, in blocks below 0, whose tail holds the words after each. Parts of the common words are in blocks below -`blocks`; `top` is the largest slack.
    """
    held = classes.sparkSession.sparkContext.broadcast(huge)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _places(frequency.value, most, records)
        done: set[int] = set()  # exact copies of a class within a task are multiplied once
        for batch in batches:
            cls = batch.column(0).to_numpy()
            fresh = []
            for i, c in enumerate(cls.tolist()):
                if c not in done:
                    done.add(c)
                    fresh.append(i)
            if len(done) > 2_000_000:
                done.clear()  # only a saving: a block drops repeated entries too
            if not fresh:
                continue
            size, shared = batch.column(1).to_numpy()[fresh].astype(np.int64), batch.column(2).to_numpy()[fresh].astype(np.int64)
            column = batch.column(3)
            words = [np.frombuffer(column[i].as_py(), np.uint64) for i in fresh]
            sketch, common = np.stack([batch.column(4).to_numpy()[fresh], batch.column(5).to_numpy()[fresh]], 1), batch.column(6).to_numpy()[fresh].astype(np.int64)
            for parts, block in _parts(cls[fresh], sketch, size, shared, common, words, places, threshold, ngram, top, blocks):
                cut = np.flatnonzero(np.diff(block)) + 1
                packed = [p.view(np.uint8).reshape(-1, PART.itemsize).T.tobytes() for p in np.split(parts, cut)]
                yield pa.RecordBatch.from_arrays([pa.array((-1 - blocks - block[np.concatenate([[0], cut])]).astype(np.int32)), pa.array(packed, pa.binary()), pa.array([b""] * len(packed), pa.binary())], ["block", "entries", "tail"])
            known, shared = shared, shared - common
            skip = np.zeros(len(size), np.int64)
            if ngram > 1:
                take = np.maximum(_prefix_of(size, shared, threshold, prefix, ngram), 0)
                rare = frequency.value[(np.concatenate([w[:n] for w, n in zip(words, take.tolist(), strict=True)]) % np.uint64(SLOTS)).astype(np.int64)] <= stem
                skip = np.bincount(np.repeat(np.arange(len(size)), take)[rare], minlength=len(size))
                heads, tail = _stems(cls[fresh], sketch, size, known, words, take, skip, ngram)
                if len(heads):
                    block = (_mix(heads["word"].astype(np.uint64)[:, None]) >> np.uint64(32)) % np.uint64(blocks)
                    order = np.argsort(block, kind="stable")
                    begin = np.cumsum(heads["n"], dtype=np.int64) - heads["n"]
                    heads, block, begin = heads[order], block[order], begin[order]
                    tail = tail[_ranges(begin, heads["n"])]
                    cut = np.flatnonzero(np.diff(block)) + 1
                    ends = np.cumsum(heads["n"], dtype=np.int64)[cut - 1]
                    packed = list(zip(*map(_packed, np.split(heads, cut), np.split(tail, ends)), strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(-1 - block[np.concatenate([[0], cut])].astype(np.int32), pa.int32()), pa.array(packed[0], pa.binary()), pa.array(packed[1], pa.binary())], ["block", "entries", "tail"])
            rows, keys = _keys_of(words, size, shared, threshold, prefix, ngram, skip)
            if not len(rows):
                continue
            block = ((keys >> np.uint64(32)) % np.uint64(blocks)).astype(np.int32)
            if len(held.value):
                of = np.isin(keys, held.value)
                salt = cls[fresh][rows[of]].view(np.uint64) % np.uint64(salts) + np.uint64(1)
                block[of] += (salt * np.uint64(blocks)).astype(np.int32)
            entries = np.empty(len(rows), ENTRY)
            entries["key"], entries["cls"] = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), cls[fresh][rows]
            order = np.argsort(block, kind="stable")
            entries, block = entries[order], block[order]
            cut = np.flatnonzero(np.diff(block)) + 1
            parts = np.split(entries, cut)
            yield pa.RecordBatch.from_arrays([pa.array(block[np.concatenate([[0], cut])]), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array([b""] * len(parts), pa.binary())], ["block", "entries", "tail"])

    return classes.select("cls", "size", "shared", "words", "s0", "s1", "common").mapInArrow(emit, "block int, entries binary, tail binary")


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.concatenate([[0], np.flatnonzero(np.diff(sorted_keys)) + 1])
    return start, np.diff(np.concatenate([start, [len(sorted_keys)]]))


def _pairs_in(start: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of both ends of all pairs within runs, in bounded parts."""
    for n in np.unique(length):
        i, j = np.triu_indices(int(n), 1)
        begin = start[length == n]
        step = max(1, 2_000_000 // max(1, len(i)))
        for k in range(0, len(begin), step):
            s = begin[k : k + step, None]
            yield (s + i).ravel(), (s + j).ravel()


def _close(start: np.ndarray, length: np.ndarray, s0: np.ndarray, s1: np.ndarray, size: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of both ends of the pairs within runs that sketches and sizes allow, in bounded parts."""
    most = ((1 - threshold) / (1 + threshold) * size + 1e-6).astype(np.float32)

    def similar(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9
        return i[ok], j[ok]

    for i, j in _pairs_in(start[length <= 2 * FEW], length[length <= 2 * FEW]):
        ok = np.flatnonzero(np.bitwise_count(s0[i] ^ s0[j]) + np.bitwise_count(s1[i] ^ s1[j]) <= most[i] + most[j])
        yield similar(i[ok], j[ok])
    for b, n in zip(start[length > 2 * FEW].tolist(), length[length > 2 * FEW].tolist(), strict=True):
        for lo in range(b, b + n, 256):
            for at in range(lo, b + n, 2048):
                x, y = slice(lo, min(lo + 256, b + n)), slice(at, min(at + 2048, b + n))
                apart = np.bitwise_count(s0[x, None] ^ s0[y]) + np.bitwise_count(s1[x, None] ^ s1[y])
                i, j = np.nonzero(apart <= most[x, None] + most[y])
                i, j = i + lo, j + at
                yield similar(i[i < j], j[i < j])


def _multiply_parts(table: pa.Table, threshold: float) -> pa.Table:
    """Pairs of classes that have a part of the common words alike, at the level of what both together let differ, and that the sketch allows."""
    entries = np.concatenate([np.frombuffer(e, np.uint8).reshape(PART.itemsize, -1).T for e in table["entries"].to_pylist()])
    entries = np.ascontiguousarray(entries).view(PART).ravel()
    slack = entries["slack"].astype(np.int64)
    base = int(slack.min())
    group = (entries["level"].astype(np.int64) << 32) | entries["key"].astype(np.int64)
    order = np.lexsort((entries["cls"], slack, group))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(entries["cls"][order]) != 0) | (np.diff(group[order]) != 0)
    entries, slack, group = entries[order[new]], slack[order[new]], group[order[new]]
    width = int(slack.max()) - base + 2
    rank = np.cumsum(np.concatenate([[0], np.diff(group) != 0])) * width
    code = rank + slack - base
    level = entries["level"].astype(np.int64)
    lowest = 4 * np.concatenate([[0], np.array(LEVELS[:-1]) + 1])[level] - slack - base
    highest = 4 * (np.array(LEVELS)[level] + 1) - slack - base
    at = np.arange(len(code))
    lo = np.maximum(np.searchsorted(code, rank + np.clip(lowest, 0, width - 1)), at + 1)
    count = np.maximum(np.searchsorted(code, rank + np.clip(highest, 0, width - 1)) - lo, 0)
    cls, s0, s1, size = entries["cls"].copy(), entries["s0"].astype(np.uint64), entries["s1"].astype(np.uint64), entries["size"].astype(np.int64)
    most = ((1 - threshold) / (1 + threshold) * size + 1e-6).astype(np.float32)
    total, found, done = np.cumsum(count), [np.empty((0, 2), np.int64)], 0
    while done < len(at):
        upto = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + 2_000_000)))
        i, j = np.repeat(at[done:upto], count[done:upto]), _ranges(lo[done:upto], count[done:upto])
        ok = np.flatnonzero(np.bitwise_count(s0[i] ^ s0[j]) + np.bitwise_count(s1[i] ^ s1[j]) <= most[i] + most[j])
        i, j = i[ok], j[ok]
        ok = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9
        a, b = cls[i[ok]], cls[j[ok]]
        found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
        done = upto
    found = np.unique(np.concatenate(found), axis=0)
    return pa.table({"a": pa.array(found[:, 0]), "b": pa.array(found[:, 1]), "kind": pa.array(np.full(len(found), COUNTED, np.int8))})


def _overlaps(i: np.ndarray, j: np.ndarray, begin: np.ndarray, end: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """How many words the tails of the stems i and j have in common, pair by pair; words that collide can only make it more."""
    out = np.zeros(len(i), np.int64)
    for lo in range(0, len(i), 100_000):
        a, b = i[lo : lo + 100_000], j[lo : lo + 100_000]
        pair = np.arange(len(a), dtype=np.uint64) << np.uint64(32)
        codes = [np.repeat(pair, end[x] - begin[x]) | tail[_ranges(begin[x], end[x] - begin[x])].astype(np.uint64) for x in (a, b)]
        both = np.sort(np.concatenate(codes))
        met = both[1:][both[1:] == both[:-1]]
        out[lo : lo + len(a)] = np.bincount((met >> np.uint64(32)).astype(np.int64), minlength=len(a))
    return out


def _multiply_stems(table: pa.Table, hot: int, threshold: float, ngram: int) -> pa.Table:
    """The product of a block of stems: pairs that sizes, sketch and accumulated overlap allow. A column grows by a word while it is large."""
    heads, tail = _unpacked(table["entries"].to_pylist(), table["tail"].to_pylist())
    begin = np.cumsum(heads["n"], dtype=np.int64) - heads["n"]
    order = np.lexsort((heads["cls"], heads["word"]))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(heads["cls"][order]) != 0) | (np.diff(heads["word"][order].astype(np.int64)) != 0)
    heads, begin = heads[order[new]], begin[order[new]]
    cls, s0, s1, size, end = heads["cls"].copy(), heads["s0"].astype(np.uint64), heads["s1"].astype(np.uint64), heads["size"].astype(np.int64), begin + heads["n"]
    entries, rows = [np.empty(0, np.int64)], [np.empty((0, 2), np.int64)]
    row, key, after = np.arange(len(heads)), heads["word"].astype(np.uint64), begin
    for depth in range(2, ngram + 1):
        n = end[row] - after
        at = _ranges(after, n)
        row, key = np.repeat(row, n), _mix(np.stack([np.repeat(key, n), tail[at].astype(np.uint64)], 1))
        order = np.argsort(key)
        row, key, after = row[order], key[order], at[order] + 1
        start, length = _runs(key) if len(key) else (np.empty(0, np.int64), np.empty(0, np.int64))
        most = DENSE * hot if depth == ngram else min(FEW, hot)
        of = (length > 1) & (length <= most)
        for i, j in _close(start[of], length[of], s0[row], s1[row], size[row], threshold):
            i, j = row[i], row[j]
            entries.append(np.unique(np.minimum(i, j) * len(heads) + np.maximum(i, j)))
        large = np.repeat(length > most, length)
        row, key, after = row[large], key[large], after[large]
    rows.append(np.stack([cls[row], key.view(np.int64)], 1))
    code = np.unique(np.concatenate(entries))
    i, j = code // max(len(heads), 1), code % max(len(heads), 1)
    least = threshold / (1 + threshold) * (size[i] + size[j]) - 1e-9
    enough = 1 + _overlaps(i, j, begin, end, tail) + np.maximum(heads["rest"][i], heads["rest"][j]) >= least
    a, b = cls[i[enough]], cls[j[enough]]
    found, rows = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b], axis=0), np.concatenate(rows)
    both = np.concatenate([found, rows])
    return pa.table({"a": pa.array(both[:, 0]), "b": pa.array(both[:, 1]), "kind": pa.array(np.repeat([COUNTED, HOT], [len(found), len(rows)]).astype(np.int8))})


def _multiply(hot: int, blocks: int, threshold: float, ngram: int):
    """Accumulate the products of one block of columns: pairs of classes that share a column; rows of a hot column come out as they are."""

    def run(table: pa.Table) -> pa.Table:
        if table["block"][0].as_py() < -blocks:
            return _multiply_parts(table, threshold)
        if table["block"][0].as_py() < 0:
            return _multiply_stems(table, hot, threshold, ngram)
        entries = np.frombuffer(b"".join(table["entries"].to_pylist()), ENTRY)
        block = int(table["block"][0].as_py())
        entries = entries[np.lexsort((entries["cls"], entries["key"]))]
        new = np.ones(len(entries), bool)
        new[1:] = (entries["key"][1:] != entries["key"][:-1]) | (entries["cls"][1:] != entries["cls"][:-1])
        entries = entries[new]
        if block >= blocks:  # a part of the huge columns
            flat = pa.array(entries["cls"]), pa.array(((block % blocks) << 32) + entries["key"].astype(np.int64))
            return pa.table({"a": flat[0], "b": flat[1], "kind": pa.array(np.full(len(entries), HOT, np.int8))})
        start, length = _runs(entries["key"])
        cls, a, b = entries["cls"], [], []
        for n in np.unique(length[(length > 1) & (length <= hot)]):
            i, j = np.triu_indices(int(n), 1)
            begin = start[length == n]
            step = max(1, 2_000_000 // len(i))
            for k in range(0, len(begin), step):
                s = begin[k : k + step, None]
                pair = np.stack([cls[(s + i).ravel()], cls[(s + j).ravel()]], 1)
                a.append(pair.min(1))
                b.append(pair.max(1))
            pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
            a, b = [pairs[:, 0]], [pairs[:, 1]]
        kind = [np.full(sum(map(len, a)), PLAIN, np.int8)]
        for s, n in zip(start[length > hot], length[length > hot], strict=True):
            a.append(cls[s : s + n])
            b.append(np.full(n, (block << 32) | int(entries["key"][s]), np.int64))
            kind.append(np.full(n, HOT, np.int8))
        flat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b)]
        return pa.table({"a": pa.array(flat[0], pa.int64()), "b": pa.array(flat[1], pa.int64()), "kind": pa.array(np.concatenate(kind), pa.int8())})

    return run


def _overlap(x: bytes, y: bytes) -> int:
    return len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))


def _linked(n_both: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, threshold: float) -> np.ndarray:
    return n_both >= threshold * (size_a + size_b - n_both) - 1e-9


def _may_hold(classes: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """The classes that may occur in the `n` pairs, by a bitmap of 32 bits a pair, of 1 to 16 MB: only those go on to the join that follows."""
    bits = 1 << min(27, max(23, (n * 32).bit_length()))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("end")).select(F.pmod(F.xxhash64("end"), F.lit(bits)).alias("slot"))
    marked = ends.groupBy(F.shiftright("slot", 6).cast("int").alias("word"))
    found = marked.agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(slot, 64) as int))")).alias("set")).toArrow()  # at most bits / 64 rows
    seen = np.zeros(bits // 64, np.int64)
    seen[found["word"].to_numpy()] = found["set"].to_numpy()
    held = classes.sparkSession.sparkContext.broadcast(seen)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(3).to_numpy()
            yield pa.RecordBatch.from_arrays(batch.columns[:3], ["cls", "size", "words"]).filter(pa.array((held.value[at >> 6] >> (at & 63)) & 1 == 1))

    return classes.select("cls", "size", "words", F.pmod(F.xxhash64("cls"), F.lit(bits)).alias("slot")).mapInArrow(keep, "cls long, size int, words binary")


def _verify(classes: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that are linked, by exact counts."""
    plain, counted = pairs.where(F.col("kind") == PLAIN).select("a", "b"), pairs.where(F.col("kind") == COUNTED).select("a", "b")
    if plain.limit(1).count():
        brief = classes.select("cls", "size", "s0", "s1").dropDuplicates(["cls"])
        of = lambda x: brief.select(F.col("cls").alias(x), F.col("size").alias(f"n_{x}"), F.col("s0").alias(f"s0_{x}"), F.col("s1").alias(f"s1_{x}"))
        apart = F.bit_count(F.col("s0_a").bitwiseXOR(F.col("s0_b"))) + F.bit_count(F.col("s1_a").bitwiseXOR(F.col("s1_b")))
        most = F.lit((1 - threshold) / (1 + threshold)) * (F.col("n_a") + F.col("n_b")) + F.lit(1e-9)
        counted = counted.union(plain.distinct().join(of("a"), "a").join(of("b"), "b").where(apart <= most).select("a", "b"))
    pairs = materialize(counted.distinct(), "neardup-counted")
    one = _may_hold(classes, pairs, pairs.count()).dropDuplicates(["cls"])
    side = lambda x: one.select(F.col("cls").alias(x), F.col("size").alias(f"size_{x}"), F.col("words").alias(f"words_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where(F.least("size_a", "size_b") >= F.lit(threshold) * F.greatest("size_a", "size_b") - F.lit(1e-9))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.array([_overlap(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)], np.int64)
            ok = _linked(n, batch.column(2).to_numpy(), batch.column(3).to_numpy(), threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "size_a", "size_b", "words_a", "words_b").mapInArrow(check, "a long, b long")


def _hot_links(classes: DataFrame, rows: DataFrame, hot: int, threshold: float) -> DataFrame:
    """Links within hot columns: their classes are cut into sub-blocks, and each pair of sub-blocks is one dense product in one task."""
    side = rows.select(F.col("b").alias("column"), F.col("a").alias("cls")).distinct()
    n = side.groupBy("column").agg(F.ceil(F.count(F.lit(1)) / hot).cast("int").alias("n"))
    cut = side.join(n, "column").withColumn("i", F.pmod(F.xxhash64("cls"), F.col("n")).cast("int"))
    cut = cut.select("column", "cls", "i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"))
    cut = cut.select("column", "cls", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"))
    full = cut.join(classes.select("cls", "size", "words").dropDuplicates(["cls"]), "cls")

    def product(table: pa.Table) -> pa.Table:
        cls, size = table["cls"].to_numpy(), table["size"].to_numpy()
        words = [np.frombuffer(w, np.uint64) for w in table["words"].to_pylist()]
        vocabulary, at = np.unique(np.concatenate(words), return_inverse=True)
        row = np.repeat(np.arange(len(words)), [len(w) for w in words])
        total = np.zeros((len(words), len(words)), np.float32)
        for lo in range(0, len(vocabulary), 4096):  # a block of columns at a time
            m, of = np.zeros((len(words), min(4096, len(vocabulary) - lo)), np.float32), (at >= lo) & (at < lo + 4096)
            m[row[of], at[of] - lo] = 1
            total += m @ m.T
        i, j = np.nonzero(np.triu(_linked(total, size[:, None], size[None, :], threshold), 1))
        return pa.table({"a": pa.array(np.minimum(cls[i], cls[j]), pa.int64()), "b": pa.array(np.maximum(cls[i], cls[j]), pa.int64())})

    return full.groupBy("column", "lo", "hi").applyInArrow(product, "a long, b long").distinct()


def near_duplicate_groups(docs: DataFrame, id_column: str, text_columns: list[str], threshold: float = 0.8, prefix: int | None = None, ngram: int = 2, hot: int = 512, huge: int = 1_000_000) -> DataFrame:
    """(doc_id, group_id, group_size) for each id that shares a group with another id; group_id is the smallest id of the group."""
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), *[F.col(f"`{c}`").alias(f"text_{i}") for i, c in enumerate(text_columns)]).where("doc_id IS NOT NULL")
    counts, records = _document_frequency(texts)
    frequency = spark.sparkContext.broadcast(counts)
    most = max(COMMON_LEAST, int(COMMON * records))
    classes = materialize(_classes(texts, frequency, most), "neardup-classes")
    columns = len(_combos(prefix, ngram)) if prefix else 400
    slack = _slack(F.col("size"), F.col("common"), threshold, ngram, F.ceil)
    n, top = classes.agg(F.count(F.lit(1)), F.coalesce(F.max(slack), F.lit(0))).first()
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * columns * ENTRY.itemsize // BLOCK_BYTES))
    spread = _blocks(classes, blocks, threshold, prefix, ngram, _huge_columns(classes, n, huge, threshold, prefix, ngram), max(1, -(-n // huge)) * 8, frequency, min(STEM, huge), most, records, int(top))
    # As many partitions as there are blocks, so that what a task reads doesn't grow with the table.
    spread = spread.repartition(2 * blocks, "block")
    pairs = materialize(spread.groupBy("block").applyInArrow(_multiply(hot, blocks, threshold, ngram), "a long, b long, kind tinyint"), "neardup-pairs")
    links = _verify(classes, pairs, threshold)
    of_hot = pairs.where(F.col("kind") == HOT)
    if of_hot.limit(1).count():
        links = links.union(_hot_links(classes, of_hot, hot, threshold))
    members = classes.select("doc_id", "cls").distinct()
    # An id inserted with different words ties its classes together.
    several = members.groupBy("doc_id").agg(F.min("cls").alias("a"), F.max("cls").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    tied = members.join(several.select("doc_id", "a"), "doc_id").where("cls <> a").select("a", F.col("cls").alias("b"))
    component = connected_components(links.union(tied), "a", "b").select(F.col("node").alias("cls"), "component")
    release(pairs)
    grouped = members.join(component, "cls", "left").select("doc_id", F.coalesce("component", "cls").alias("component")).distinct()
    whole = grouped.groupBy("component").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    return grouped.join(whole, "component").select("doc_id", "group_id", "group_size")


def group_pairs(groups: DataFrame) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: all pairs within a group, where a result is defined that way."""
    left = groups.select("group_id", F.col("doc_id").alias("doc_a"))
    right = groups.select("group_id", F.col("doc_id").alias("doc_b"))
    return left.join(right, "group_id").where("doc_a < doc_b").select("doc_a", "doc_b")
