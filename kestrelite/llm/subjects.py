"""Subject areas of documents, by calibrated classifier chains over term, source and structure features.

Fit, on at most `sample_rows` labelled documents (taken by hash of the id; the only bounded part):
  1. Terms, which are words and pairs of words that follow each other. Every spoken cue deals with one of the subjects or with none. Which one isn't known, only the labels of its document; what each term
     says of the subject is found by a few rounds of expectation maximisation over the cues of all labelled documents, in any language at once.
     Terms that occur alike with all subjects, such as those of a language, say nothing and are left out.
  2. Features of a document: per subject, the share of its spoken cues that deal with it, by the cues' posteriors, and how far the share lies
     above each of a row of evenly spaced knots, so that a link can turn at any share (where it turns is fitted); its source, hashed; its
     structure (number of cues, words a cue, part without speech).
  3. A chain of logistic classifiers, most frequent subject first, each with the labels before it as features: co-occurrence is modelled there.
     Labelled documents all have a subject; each is therefore also used with some of its cues left out, and with only those of no subject, its
     labels then being those of its own that still have `least` of the cues, which is what the problem calls dealing with a subject.
  4. Calibration: each link's scores on documents that it wasn't fitted on are scaled to probabilities (Platt).
Then every document is labelled in one pass: the label combination of highest joint probability, by beam search along the chain.

Defined results: null or empty texts, and texts without speech, have no row; null ids are left out; repeated rows of a document give one row a
subject; null sources are a source of their own; without any labelled document the result is empty; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelite.llm.leakage import Terms, robust, words_of
from kestrelite.llm.subtitles import cues, spoken_cues

SOURCES = 16
#: Shares at which a link's dependence on a share can change.
KNOTS = np.arange(0, 0.6, 0.05)
#: A term speaks for a subject from that share of its cues on; its cues count as so many more of the subjects' usual shares.
SPEAKS, SMOOTH = (0.45, 0.55, 0.6), 1.0


class _Plain(dict):
    """The robust form by word, kept for words seen before; emptied at a size so that it stays bounded."""

    def __missing__(self, word: str) -> str:
        if len(self) > 500_000:
            self.clear()
        form = self[word] = robust(word)
        return form


_PLAIN = _Plain()


def _source_bucket(source: str | None) -> int:
    import xxhash

    return xxhash.xxh32_intdigest((source or "\0").strip().lower()) % SOURCES


def pairs_of(forms: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(forms, forms[1:], strict=False)]


def cue_terms(text: str | None) -> tuple[list[list[str]], int]:
    """The words of each spoken cue, and the number of all cues."""
    spoken = [words_of(c) for c in spoken_cues(text)]
    return spoken, max(len(cues(text)), len(spoken))


@dataclass
class Model:
    subjects: list[str]
    numbers: dict[str, int]
    chance: np.ndarray  # log of each subject's share of a term's cues
    usual: np.ndarray  # log of each subject's share of all cues
    order: list[int] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    scale: list[tuple[float, float]] = field(default_factory=list)

    def posteriors(self, terms: np.ndarray, cue: np.ndarray, n: int) -> np.ndarray:
        """Of n cues: the probability of each subject. terms and cue: flat term numbers and the cue of each."""
        known = terms >= 0
        terms, cue = terms[known], cue[known]
        some = np.bincount(cue, minlength=n)
        score = np.stack([np.bincount(cue, self.chance[terms, s] - self.usual[s], n) for s in range(len(self.subjects))], 1) + self.usual
        p = np.exp(score - score.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True) * (some > 0)[:, None]  # a cue without a speaking term deals with no subject

    def features(self, share: np.ndarray, source: np.ndarray, n_cues: np.ndarray, n_spoken: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        hashed = np.zeros((len(source), SOURCES))
        hashed[np.arange(len(source)), source] = 1
        shape = np.stack([np.log1p(n_cues) / 5, n_words / np.maximum(n_spoken, 1) / 10, 1 - n_spoken / np.maximum(n_cues, 1)], 1)
        above = np.clip((share[:, :, None] - KNOTS) / (KNOTS[1] - KNOTS[0]), 0, 1).reshape(len(share), -1)
        return np.concatenate([share, above, hashed * 0.1, shape, np.ones((len(source), 1))], 1)

    def decode(self, x: np.ndarray, beam: int = 6) -> np.ndarray:
        """The label combination of highest joint probability of each row."""
        k = len(self.order)
        labels, score = np.zeros((len(x), 1, k)), np.zeros((len(x), 1))
        for step in range(k):
            z = (x @ self.weights[step][: x.shape[1]])[:, None] + labels[:, :, :step] @ self.weights[step][x.shape[1] :]
            a, b = self.scale[step]
            z = a * z + b
            both = np.concatenate([score - np.logaddexp(0, z), score - np.logaddexp(0, -z)], 1)
            tree = np.concatenate([labels, labels], 1)
            tree[:, labels.shape[1] :, step] = 1
            best = np.argsort(-both, axis=1, kind="stable")[:, :beam]
            score, labels = np.take_along_axis(both, best, 1), np.take_along_axis(tree, best[:, :, None], 1)
        out = np.zeros((len(x), k), bool)
        out[:, self.order] = labels[:, 0] > 0.5
        return out


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 12) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(x.shape[1])
        move = np.linalg.solve(h, x.T @ (y - p) - penalty * w)
        w += move
        if np.abs(move).max() < 1e-6:
            break
    return w


def fit(documents: list[tuple[str, str | None]], labels: list[set[str]], least: float = 0.25, seed: int = 0) -> Model | None:
    """The model of labelled documents (text, source)."""
    subjects = sorted({s for y in labels for s in y})
    if not subjects:
        return None
    k, random = len(subjects), np.random.default_rng(seed)
    parsed = [cue_terms(t) for t, _ in documents]
    numbers: dict[str, int] = {}
    seen: dict[str, int] = {}
    forms: dict[str, str] = {}
    for spoken, _ in parsed:
        held = set()
        for c in spoken:
            line = [forms.setdefault(w, robust(w)) for w in c]
            held.update(line)
            held.update(pairs_of(line))
        for f in held:
            seen[f] = seen.get(f, 0) + 1
    for f in sorted(f for f, n in seen.items() if n > (4 if " " in f else 2)):
        numbers[f] = len(numbers)
    terms, cue, owner = [], [], []
    for d, (spoken, _) in enumerate(parsed):
        for c in spoken:
            line = [forms[w] for w in c]
            of = {numbers.get(f, -1) for f in (*line, *pairs_of(line))} - {-1}
            terms += of
            cue += [len(owner)] * len(of)
            owner.append(d)
    terms, cue, owner = np.array(terms, np.int64), np.array(cue, np.int64), np.array(owner, np.int64)
    y = np.array([[s in of for s in subjects] for of in labels], float)
    usual = (y / np.maximum(y.sum(1, keepdims=True), 1))[owner].sum(0) + 1.0
    usual /= usual.sum()
    belongs, v = (y / np.maximum(y.sum(1, keepdims=True), 1))[owner], len(numbers)
    for speaks in SPEAKS:
        count = np.stack([np.bincount(terms, belongs[cue, s], v) for s in range(k)], 1).reshape(v, k)
        share = (count + SMOOTH * usual) / (count.sum(1, keepdims=True) + SMOOTH)
        speaking = share.max(1) >= speaks
        model = Model(subjects, numbers, np.log(share), np.log(usual))
        found = model.posteriors(np.where(speaking[terms], terms, -1), cue, len(owner))
        # Among the document's labels the cue's own terms decide; a cue may deal with a subject that the document isn't labelled with.
        belongs = found * (0.02 + (y > 0)[owner])
        belongs /= np.maximum(belongs.sum(1, keepdims=True), 1e-9)
        bare = found.sum(1) == 0
        belongs[bare] = (y / np.maximum(y.sum(1, keepdims=True), 1))[owner[bare]]
    names = list(numbers)
    alone = {n for n, ok in zip(names, speaking.tolist(), strict=True) if ok and " " not in n}
    # A pair speaks for itself only where its words don't.
    kept = np.array([i for i in np.flatnonzero(speaking).tolist() if " " not in names[i] or not alone & set(names[i].split(" "))], np.int64)
    model = Model(subjects, {names[i]: n for n, i in enumerate(kept.tolist())}, np.log(share[kept]), np.log(usual))
    renumber = np.full(v + 1, -1, np.int64)
    renumber[kept] = np.arange(len(kept))
    terms = renumber[terms] if len(terms) else terms
    posterior = model.posteriors(terms, cue, len(owner))
    words_in = np.bincount(cue, minlength=len(owner)).astype(float)
    source = np.array([_source_bucket(s) for _, s in documents])
    n_cues = np.array([n for _, n in parsed], float)

    def example(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        spoken = np.bincount(owner[keep], minlength=len(documents)).astype(float)
        share = np.stack([np.bincount(owner[keep], posterior[keep, s], len(documents)) for s in range(k)], 1) / np.maximum(spoken, 1)[:, None]
        words = np.bincount(owner[keep], words_in[keep], len(documents))
        return model.features(share, source, np.maximum(n_cues, spoken), spoken, words), share, spoken

    x, share, spoken = example(np.ones(len(owner), bool))
    parts, targets, groups = [x], [y], [np.arange(len(y))]
    own = y[owner] * posterior
    for drop in (0.3, 0.6, 1.0):  # part of the cues that deal with the document's own subjects are left out
        gone = (own.sum(1) > 0.5) & (random.random(len(owner)) < drop)
        x2, share2, spoken2 = example(~gone)
        parts.append(x2)
        targets.append(y * (share2 >= least))
        groups.append(np.arange(len(y)))
    x, y, group = np.concatenate(parts), np.concatenate(targets), np.concatenate(groups)
    model.order = sorted(range(k), key=lambda s: -y[:, s].sum())
    fold = (group * 2654435761 % 3).astype(int)
    for step, s in enumerate(model.order):
        full = np.concatenate([x, y[:, model.order[:step]]], 1)
        out = np.zeros(len(full))
        for f in range(3):
            if (fold == f).any() and (fold != f).any():
                out[fold == f] = full[fold == f] @ _logistic(full[fold != f], y[fold != f, s])
        a, b = _logistic(np.stack([out, np.ones(len(out))], 1), y[:, s], penalty=1e-3)
        model.weights.append(_logistic(full, y[:, s]))
        model.scale.append((float(max(a, 1e-3)), float(b)))
    return model


def assign(model: Model, texts: list[str | None], sources: list[str | None], forms: Terms | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Labels (document by subject) and the share of each subject's cues."""
    forms = Terms({t: n for t, n in model.numbers.items() if " " not in t}) if forms is None else forms
    plain = _PLAIN
    begins = {t.split(" ")[0] for t in model.numbers if " " in t}
    terms, cue, owner, n_cues = [], [], [], []
    for d, text in enumerate(texts):
        spoken, n = cue_terms(text)
        n_cues.append(n)
        for c in spoken:
            of = {forms[w] for w in c}
            for a, b in zip(c, c[1:], strict=False):
                if (first := plain[a]) in begins:
                    of.add(model.numbers.get(f"{first} {plain[b]}", -1))
            of.discard(-1)
            terms += of
            cue += [len(owner)] * len(of)
            owner.append(d)
    terms, cue, owner = np.array(terms, np.int64), np.array(cue, np.int64), np.array(owner, np.int64)
    p = model.posteriors(terms, cue, len(owner))
    spoken = np.bincount(owner, minlength=len(texts)).astype(float)
    share = np.stack([np.bincount(owner, p[:, s], len(texts)) for s in range(len(model.subjects))], 1) / np.maximum(spoken, 1)[:, None]
    words = np.bincount(owner, np.bincount(cue, minlength=len(owner)), len(texts)) if len(owner) else np.zeros(len(texts))
    x = model.features(share, np.array([_source_bucket(s) for s in sources]), np.array(n_cues, float), spoken, words)
    return model.decode(x) & (spoken > 0)[:, None], share


def labelled_sample(documents: DataFrame, labels: DataFrame, id_column: str, text_column: str, source_column: str, sample_rows: int) -> tuple[list, list]:
    """At most about `sample_rows` labelled documents with their labels."""
    named = labels.select(F.col("doc_id").alias("label_id"), F.lower(F.btrim("subject")).alias("subject")).where("label_id IS NOT NULL AND subject IS NOT NULL").distinct()
    each = named.groupBy("label_id").agg(F.collect_set("subject").alias("subjects"))
    n = each.count()
    if n > sample_rows:
        each = each.where(F.pmod(F.xxhash64("label_id"), F.lit(1 << 20)) < int((1 << 20) * sample_rows / n))
    # The sample is what is broadcast: about `sample_rows` ids, each with the few subjects that there are.
    rows = documents.select(F.col(f"`{id_column}`").alias("label_id"), F.col(f"`{text_column}`").alias("text"), F.col(f"`{source_column}`").alias("source")).join(F.broadcast(each), "label_id").dropDuplicates(["label_id"]).orderBy("label_id").collect()
    return [(r["text"], r["source"]) for r in rows], [set(r["subjects"]) for r in rows]


def subject_areas(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", least: float = 0.25, sample_rows: int = 3000) -> DataFrame:
    """(doc_id, subject, share) of every document that has a subject."""
    spark = documents.sparkSession
    model = spark.sparkContext.broadcast(fit(*labelled_sample(documents, labels, id_column, text_column, source_column, sample_rows), least))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        forms = Terms({t: n for t, n in m.numbers.items() if " " not in t}) if m else None
        for batch in batches:
            if m is None or not batch.num_rows:
                continue
            chosen, share = assign(m, batch.column(1).to_pylist(), batch.column(2).to_pylist(), forms)
            d, s = np.nonzero(chosen)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d)), pa.array([m.subjects[i] for i in s], pa.string()), pa.array(share[d, s])], ["doc_id", "subject", "share"])

    narrow = documents.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").alias("text"), F.col(f"`{source_column}`").alias("source"))
    return narrow.where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(label, "doc_id long, subject string, share double").dropDuplicates(["doc_id", "subject"])
