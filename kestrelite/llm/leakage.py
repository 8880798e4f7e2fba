"""Held-out test items that occur, whole or in part, in the spoken lines of a large corpus.

Items come in sets of at most `SET` (one set, for a usual test suite); a set's BM25 inverted index goes to every task: per term its postings, the
items that have it in order with their impacts, cut into blocks of `BLOCK` items with the largest impact of each. Every passage of every document
is a query: windows of words that overlap by half. Block-max WAND: postings are walked in order of item; the pivot is the first item at which the
largest impacts of the terms met so far reach the least threshold; if the blocks' largest impacts don't reach it, the walk goes on after the block,
else the item is scored; all items at or above their threshold are retrieved. An item's threshold is the least score that a passage with enough
of its words can have, found exactly (least total impact of terms with that many occurrences), less `slack` for words too damaged to be known.
Windows are as long as the items need: items are indexed by the length of the longest passage that the alignment below accepts, in powers of two,
and half a window is the longest such length, so no accepted passage lies across windows.
A retrieved item is verified by alignment: the longest chain of its words in the document in the item's order, in which at most
`gap` - 1 words of either side are passed over between two matches, must hold at least `share` of the item's words.

Words are compared in a form that damage leaves alone: lower case; Latin letters beyond ASCII, which wrong encodings spoil, and question marks, which
stand for them, left out (letters of other scripts stay; where a script has no blanks, each sign is a word); characters that recognition mixes up made one. A word that still isn't known counts as the one term of the items within
one edit (two from nine characters on), if there is one. Hesitations and bare numbers are no words.

Defined results: null or empty texts hold nothing; null ids are left out; repeated rows of a document or item give one row; an item without words is
never found; texts are read whole; an empty table on either side gives an empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelite.llm.subtitles import spoken_cues

#: Characters and pairs that character recognition mixes up, each made the form on the right.
CONFUSED_PAIRS = (("rn", "m"), ("cl", "d"), ("vv", "w"))
CONFUSED = str.maketrans({"0": "o", "1": "l", "i": "l", "j": "l", "8": "b", "5": "s", "6": "b", "9": "g", "q": "g", "e": "c", "t": "f", "h": "b", "u": "ll", "2": "z"})
HESITATIONS = frozenset(("uh", "um", "eh", "er", "hm", "mm", "well", "mmm"))
#: Scripts other than Latin, and of these the ones written without blanks.
SIGNS = r"\u3040-\u30ff\u3400-\u9fff\u0e00-\u0eff\u1780-\u17ff\u1000-\u109f"
OTHER = r"\u0370-\u0dff\u0f00-\u0fff\u10a0-\u177f\u1800-\u1dff\u1f00-\u1fff\u2c80-\u2dff\uac00-\ud7a3\ufb1d-\ufdff\ufe70-\ufeff"
FOREIGN, LATIN = re.compile(f"[{SIGNS}{OTHER}]"), re.compile(f"[^\\x00-\\x7f{SIGNS}{OTHER}]")
WORD = re.compile(f"[a-z0-9]+|[{SIGNS}]|[{OTHER}]+")
#: Words with an apostrophe or hyphen inside are one word.
JOINT = re.compile(r"(?<=[a-z0-9])['-](?=[a-z0-9])")
K1, B = 1.2, 0.75
BLOCK = 16
#: Items of one index: what a task holds of them is bounded, and larger test sets are searched set by set.
SET = 20_000


def words_of(text: str) -> list[str]:
    """The words of spoken text, in lower case without Latin letters beyond ASCII, hesitations and bare numbers."""
    if text.isascii() or not FOREIGN.search(text):
        plain = text.encode("ascii", "ignore").decode()
    else:
        plain = LATIN.sub("", text)
    plain = plain.replace("?", "").lower()
    return [w for w in WORD.findall(JOINT.sub("", plain)) if w not in HESITATIONS and not w.isdigit()]


def robust(word: str) -> str:
    """The form in which damaged copies of a word agree."""
    for pair, one in CONFUSED_PAIRS:
        if pair in word:
            word = word.replace(pair, one)
    return word.translate(CONFUSED)


def _shorter(word: str) -> set[str]:
    return {word[:i] + word[i + 1 :] for i in range(len(word))}


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


class Terms(dict):
    """Term number by word, -1 for words of no item; each word of the corpus is looked up once a task."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary
        self.near: dict[str, set[str]] = defaultdict(set)
        for t in vocabulary:
            if len(t) >= 5:
                for s in {t, *_shorter(t)}:
                    self.near[s].add(t)
                    if len(t) >= 9:
                        for s2 in _shorter(s):
                            self.near[s2].add(t)

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        form = robust(word)
        found = self.vocabulary.get(form)
        if found is None:
            found, reach = -1, set()
            if len(form) >= 5:
                ways = {form, *_shorter(form)}
                if len(form) >= 9:
                    ways |= {s2 for s in list(ways) for s2 in _shorter(s)}
                for s in ways:
                    reach |= self.near.get(s, set())
                close = sorted((d, t) for t in reach if (d := _edits(form, t)) <= (2 if min(len(t), len(form)) >= 9 else 1))
                if close:
                    found = self.vocabulary[close[0][1]]
        self[word] = found
        return found


def _least_score(impacts: list[float], counts: list[int], need: int) -> float:
    """The least total impact of terms that occur at least `need` times together."""
    least = np.full(need + 1, np.inf)
    least[0] = 0
    for impact, count in zip(impacts, counts, strict=True):
        least = np.minimum(least, least[np.maximum(np.arange(need + 1) - count, 0)] + impact)
    return float(least[need])


class _Part:
    """Inverted index of the items that share a window: postings with block maxima, and the walk through them."""

    def __init__(self, half: int, members: list[tuple[int, float, dict[int, float]]], terms: int):
        """members: (item, threshold, impact by term), in order of item; `terms`: how many terms there are in all."""
        self.half, self.items = half, [k for k, _, _ in members]
        self.threshold = [t for _, t, _ in members]
        self.least = min(self.threshold)
        self.block_least = [min(self.threshold[lo : lo + BLOCK]) for lo in range(0, len(members), BLOCK)]
        self.postings: dict[int, tuple[list[int], list[float]]] = {}
        for place, (_, _, impact) in enumerate(members):
            for t, x in impact.items():
                at, score = self.postings.setdefault(t, ([], []))
                at.append(place)
                score.append(x)
        self.top = {t: max(score) for t, (_, score) in self.postings.items()}
        self.reach = np.zeros(terms)
        self.reach[list(self.top)] = list(self.top.values())
        self.block_top: dict[int, dict[int, float]] = {}
        for t, (at, score) in self.postings.items():
            of = self.block_top[t] = {}
            for p, x in zip(at, score, strict=True):
                of[p // BLOCK] = max(of.get(p // BLOCK, 0.0), x)

    def walk(self, terms: list[int]) -> list[int]:
        """The items whose score for a passage with these terms reaches their threshold."""
        postings, end, out = self.postings, len(self.items), []
        cursors = [[postings[t][0][0], 0, t] for t in terms if t in postings]  # place, position in the postings, term
        while cursors:
            cursors.sort()
            reach, pivot = 0.0, -1
            for n, c in enumerate(cursors):
                reach += self.top[c[2]]
                if reach >= self.least:
                    pivot = c[0]
                    break
            if pivot < 0:
                return out
            while n + 1 < len(cursors) and cursors[n + 1][0] == pivot:
                n += 1
            block = pivot // BLOCK
            if sum(self.block_top[c[2]].get(block, 0.0) for c in cursors[: n + 1]) < self.block_least[block]:
                to = min((block + 1) * BLOCK, cursors[n + 1][0] if n + 1 < len(cursors) else end)
            else:
                score = 0.0
                for c in cursors[: n + 1]:
                    at, impact = postings[c[2]]
                    i = bisect_left(at, pivot, c[1])
                    if i < len(at) and at[i] == pivot:
                        score += impact[i]
                if score >= self.threshold[pivot]:
                    out.append(self.items[pivot])
                to = pivot + 1
            for c in cursors[: n + 1]:
                at = postings[c[2]][0]
                c[1] = bisect_left(at, to, c[1])
                c[0] = at[c[1]] if c[1] < len(at) else end
            cursors = [c for c in cursors if c[0] < end]
        return out


class Index:
    """The inverted indexes of a set of items, one a length of window, and what verification needs."""

    def __init__(self, items: list[tuple[int, str]], share: float, slack: float = 0.2, gap: int = 4):
        held = [(i, [robust(w) for w in words_of(t or "")]) for i, t in sorted(set(items))]
        held = [(i, w) for i, w in held if w]
        self.ids = [i for i, _ in held]
        self.words = [w for _, w in held]
        self.need = [max(1, math.ceil(share * len(w) - 1e-9)) for w in self.words]
        self.gap = gap
        names = sorted({t for w in self.words for t in w})
        self.vocabulary = {t: k for k, t in enumerate(names)}
        n, average = len(held), sum(map(len, self.words)) / max(1, len(held))
        seen = Counter(t for w in self.words for t in set(w))
        parts: dict[int, list] = defaultdict(list)
        for k, w in enumerate(self.words):
            tf = Counter(w)
            each = {}
            for t, f in tf.items():
                idf = math.log(1 + (n - seen[t] + 0.5) / (seen[t] + 0.5))
                each[t] = idf * f * (K1 + 1) / (f + K1 * (1 - B + B * len(w) / average))
            least = _least_score(list(each.values()), [tf[t] for t in each], self.need[k]) * (1 - slack)
            span = (self.need[k] - 1) * gap + 1
            parts[(span - 1).bit_length()].append((span, k, least, {self.vocabulary[t]: x for t, x in each.items()}))
        self.parts = [_Part(max(8, *(m[0] for m in of)), [m[1:] for m in of], len(names)) for _, of in sorted(parts.items())]
        self.places = []
        for w in self.words:
            at: dict[int, list[int]] = defaultdict(list)
            for p, t in enumerate(w):
                at[self.vocabulary[t]].append(p)
            self.places.append(dict(at))

    def retrieve(self, terms: np.ndarray, starts: np.ndarray) -> list[tuple[int, int]]:
        """(document, item) pairs that some passage of the document retrieves; `terms` of all documents, which begin at `starts`."""
        known = np.flatnonzero(terms >= 0)
        if not len(known) or not self.ids:
            return []
        lengths = np.diff(np.append(starts, len(terms)))
        document = np.repeat(np.arange(len(starts)), lengths)[known]
        at = (np.arange(len(terms)) - np.repeat(starts, lengths))[known]
        out: set[tuple[int, int]] = set()
        for part in self.parts:
            of = part.reach[terms[known]] > 0
            d, place, t = document[of], at[of] // part.half, terms[known][of]
            # A word at place p is in the passages p // half and p // half - 1 of its document.
            more = place > 0
            d, place, t = np.concatenate([d, d[more]]), np.concatenate([place, place[more] - 1]), np.concatenate([t, t[more]])
            where = (d << 24) + place
            # Sums of largest impacts with repeated words counted each time: enough to leave out most passages before any sort.
            names, passage = np.unique(where, return_inverse=True)
            hopeful = np.bincount(passage, part.reach[t], len(names)) >= part.least
            of = hopeful[passage]
            if not of.any():
                continue
            code = np.unique(passage[of] * len(self.vocabulary) + t[of])
            term, which = code % len(self.vocabulary), code // len(self.vocabulary)
            begin = np.concatenate([[0], np.flatnonzero(np.diff(which)) + 1])
            good = np.add.reduceat(part.reach[term], begin) >= part.least
            ends = np.append(begin[1:], len(term))
            flat = term.tolist()
            for lo, hi in zip(begin[good].tolist(), ends[good].tolist(), strict=True):
                doc = int(names[which[lo]] >> 24)
                out.update((doc, k) for k in part.walk(flat[lo:hi]))
        return sorted(out)

    def holds(self, terms: list[int], item: int) -> bool:
        """Whether a passage of the document has enough of the item's words in order."""
        places, need, gap = self.places[item], self.need[item], self.gap
        recent: list[tuple[int, int, int]] = []  # (place in document, place in item, length of the chain that ends there)
        best = 0
        for j, t in enumerate(terms):
            of = places.get(t)
            if of is None:
                continue
            recent = [r for r in recent if r[0] >= j - gap]
            new = []
            for i in of:
                length = 1
                for _, i2, n2 in recent:
                    if i - gap <= i2 < i and n2 >= length:
                        length = n2 + 1
                new.append((j, i, length))
                if length > best:
                    best = length
                    if best >= need:
                        return True
            recent += new
        return False


def _items_of(items: DataFrame, id_column: str, text_column: str) -> Iterator[list[tuple[int, str]]]:
    """The test items in sets of about SET at most."""
    held = items.select(F.col(f"`{id_column}`").cast("int").alias("item_id"), F.col(f"`{text_column}`").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    sets = max(1, -(-held.count() // SET))
    for k in range(sets):
        yield [(r["item_id"], r["text"]) for r in held.where(F.pmod(F.xxhash64("item_id"), F.lit(sets)) == k).collect()]  # one bounded set


def leaked_items(documents: DataFrame, id_column: str, text_column: str, items: DataFrame, item_id: str = "item_id", item_text: str = "text", share: float = 0.55, gap: int = 4) -> DataFrame:
    """(item_id, doc_id) of all documents that contain enough of an item of `items`, the held-out test set."""
    narrow = documents.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    found = [_search_set(narrow, of, share, gap) for of in _items_of(items, item_id, item_text)]
    return reduce(DataFrame.union, found).distinct()


def _search_set(narrow: DataFrame, items: list[tuple[int, str]], share: float, gap: int) -> DataFrame:
    held = narrow.sparkSession.sparkContext.broadcast(Index(items, share, gap=gap))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        terms = Terms(index.vocabulary)
        for batch in batches:
            ids, texts, lines = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for text in texts:
                words = words_of("\n".join(spoken_cues(text))) if text else []
                lines.append([terms[w] for w in words])
            lengths = np.array([len(x) for x in lines], np.int64)
            flat = np.fromiter((t for x in lines for t in x), np.int64, int(lengths.sum()))
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.empty(0, np.int64)
            full = lengths > 0  # documents without words have no passage
            numbers = np.flatnonzero(full)
            found = [(index.ids[k], ids[numbers[d]]) for d, k in index.retrieve(flat, starts[full]) if index.holds(lines[numbers[d]], k)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int32()), pa.array([d for _, d in found], pa.int64())], ["item_id", "doc_id"])

    return narrow.mapInArrow(search, "item_id int, doc_id long")
