"""Near-duplicate groups against brute force, and the defined results."""

import random

import pytest

from kestrelite.llm.neardup import group_pairs, near_duplicate_groups, words_of

SCHEMA = "doc_id long, title string, snippet string, cls long, size int, group_id string, words string"


def brute(rows, threshold):
    words = {}
    for r in rows:
        if r[0] is not None:
            words.setdefault(r[0], set()).add(frozenset(words_of([r[1], r[2]])))
    ids = sorted(words)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and any(a and b and len(a & b) >= threshold * len(a | b) - 1e-9 for a in words[i] for b in words[j]):
                parent[find(i)] = find(j)
    groups = {}
    for i in ids:
        groups.setdefault(find(i), []).append(i)
    return {(i, min(g), len(g)) for g in groups.values() if len(g) > 1 for i in g}


def corpus(seed, n=120):
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(12)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            base = (rng.choice(rows)[2] or "").split()
            for _ in range(rng.randint(0, 6)):
                if base and rng.random() < 0.5:
                    base[rng.randrange(len(base))] = f"w{rng.randrange(400)}"
                else:
                    base.insert(rng.randint(0, len(base)), rng.choice(common))
            rng.shuffle(base)
            text = " ".join(base)
        else:
            text = " ".join([f"w{rng.randrange(400)}" for _ in range(rng.randint(0, 14))] + [rng.choice(common) for _ in range(rng.randint(0, 8))])
        rows.append((i * 7 - 300, rng.choice([None, "", "A-title!"]), text, 1, 2, "x", "y"))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("threshold", [0.6, 0.8])
def test_against_brute_force(spark, seed, threshold):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    for prefix in (None, 9):
        got = {tuple(r) for r in near_duplicate_groups(df, "doc_id", ["title", "snippet"], threshold, prefix=prefix).collect()}
        assert got == brute(rows, threshold)


def test_hot_columns_are_multiplied_in_sub_blocks(spark):
    """All records share their rarest words with many others: the path for hot columns gives the same groups."""
    rows = [(i, None, " ".join(["alpha", "beta", "gamma", "delta"] + [f"u{i % 40}v{k}" for k in range(3 if i % 3 else 1)]), 1, 2, "x", "y") for i in range(60)]
    for huge in (1_000_000, 20):  # the second also spreads the largest columns over several blocks
        got = {tuple(r) for r in near_duplicate_groups(spark.createDataFrame(rows, SCHEMA), "doc_id", ["title", "snippet"], 0.6, hot=4, huge=huge).collect()}
        assert got == brute(rows, 0.6)


def test_defined_results(spark):
    rows = [
        (1, "One two three", None, 0, 0, "", ""), (1, "One two three", None, 0, 0, "", ""), (2, "one TWO, three!", "", 0, 0, "", ""),
        (3, None, None, 0, 0, "", ""), (4, " \n ", "?!", 0, 0, "", ""), (None, "one two three", None, 0, 0, "", ""), (-5, "x" * 50_000 + " one", None, 0, 0, "", ""),
    ]
    groups = near_duplicate_groups(spark.createDataFrame(rows, SCHEMA), "doc_id", ["title", "snippet"], 0.6)
    assert {tuple(r) for r in groups.collect()} == {(1, 1, 2), (2, 1, 2)}
    assert [tuple(r) for r in group_pairs(groups).collect()] == [(1, 2)]


def test_empty(spark):
    assert near_duplicate_groups(spark.createDataFrame([], SCHEMA), "doc_id", ["title", "snippet"]).count() == 0


def test_links_between_records_of_different_sizes(spark):
    """A record of 31 words contains another's 19; its 12 further words are the rarest. Of 60 and 48 words, 12 of one and none of the other."""
    rows = []
    for i, (small, large) in enumerate([(19, 31), (48, 60), (36, 60)]):
        text = [f"s{i}x{k}" for k in range(small)]
        more = [f"m{i}x{k}" for k in range(large - small)]
        rows += [(10 * i, None, " ".join(text), 1, 2, "x", "y"), (10 * i + 1, None, " ".join(text + more), 1, 2, "x", "y")]
        # Each further word occurs once elsewhere, each shared word in three further records.
        rows += [(1000 + 100 * i + k, None, f"{w} f{i}a{k} f{i}b{k}", 1, 2, "x", "y") for k, w in enumerate(more)]
        rows += [(2000 + 1000 * i + 100 * c + k, None, f"{w} g{i}a{c}k{k} g{i}b{c}k{k}", 1, 2, "x", "y") for c in range(3) for k, w in enumerate(text)]
    got = {tuple(r) for r in near_duplicate_groups(spark.createDataFrame(rows, SCHEMA), "doc_id", ["title", "snippet"], 0.6).collect()}
    assert got == brute(rows, 0.6) == {(10 * i + k, 10 * i, 2) for i in range(3) for k in range(2)}


def test_a_link_at_the_threshold_exactly(spark):
    """Two records of 40 words with 30 in common: similarity 0.6. Their ten own words are rarer than the shared ones."""
    text = [f"s{k}" for k in range(30)]
    rows = [(i, None, " ".join(text + [f"o{i}x{k}" for k in range(10)]), 1, 2, "x", "y") for i in (1, 2)]
    rows += [(100 + 20 * i + k, None, f"o{i}x{k} f{i}a{k} f{i}b{k}", 1, 2, "x", "y") for i in (1, 2) for k in range(10)]
    rows += [(1000 + 50 * c + k, None, f"{w} g{c}k{k} h{c}k{k}", 1, 2, "x", "y") for c in range(3) for k, w in enumerate(text)]
    got = {tuple(r) for r in near_duplicate_groups(spark.createDataFrame(rows, SCHEMA), "doc_id", ["title", "snippet"], 0.6).collect()}
    assert got == brute(rows, 0.6) == {(1, 1, 2), (2, 1, 2)}


def test_counts_discard_only_what_cannot_be_linked(spark):
    """Records drawn from few topics overlap in many words, mostly too few to be linked."""
    rng = random.Random(5)
    rows = []
    for i in range(150):
        topic = [f"t{rng.randrange(3)}w{k}" for k in range(40)]
        rows.append((i, None, " ".join(rng.sample(topic, rng.randint(18, 34)) + [f"z{rng.randrange(30)}" for _ in range(4)]), 1, 2, "x", "y"))
    for threshold in (0.6, 0.7):
        got = {tuple(r) for r in near_duplicate_groups(spark.createDataFrame(rows, SCHEMA), "doc_id", ["title", "snippet"], threshold).collect()}
        assert got == brute(rows, threshold)


@pytest.mark.parametrize("stem", [0, 6])
def test_words_with_and_without_stems(spark, monkeypatch, stem):
    """Words of more than STEM documents have their combinations written out, also within one record."""
    monkeypatch.setattr("kestrelite.llm.neardup.STEM", stem)
    rows = corpus(3)
    got = {tuple(r) for r in near_duplicate_groups(spark.createDataFrame(rows, SCHEMA), "doc_id", ["title", "snippet"], 0.6).collect()}
    assert got == brute(rows, 0.6)


def templates(seed, n=240):
    """Records of common words and a few rare ones; many are linked by common words alone."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.4:
            words = [w for w in rng.choice(rows)[2].split() if w[0] == "t" or rng.random() < 0.4]
            if rng.random() < 0.5:
                words[rng.randrange(len(words))] = f"t{rng.randrange(30)}"
        else:
            words = [f"t{k}" for k in rng.sample(range(30), 12)]
        words += [f"r{rng.randrange(300)}" for _ in range(rng.choice([0, 1, 3, 3, 3, 6]))]
        rows.append((i, None, " ".join(words), 1, 2, "x", "y"))
    return rows


def test_common_words_are_no_columns(spark, monkeypatch):
    """Words of many records have no columns, neither alone nor combined, of which there would be many hot ones."""

    def refuse(*_):
        raise AssertionError("a hot column")

    for name, value in (("STEM", 20), ("COMMON_LEAST", 20)):
        monkeypatch.setattr(f"kestrelite.llm.neardup.{name}", value, raising=False)
    monkeypatch.setattr("kestrelite.llm.neardup._hot_links", refuse)
    rows = templates(1)
    got = {tuple(r) for r in near_duplicate_groups(spark.createDataFrame(rows, SCHEMA), "doc_id", ["title", "snippet"], 0.6, hot=8).collect()}
    assert got == brute(rows, 0.6)


@pytest.mark.parametrize("least", [1, 6, 25])
@pytest.mark.parametrize("ngram", [2, 3])
def test_links_by_common_words(spark, monkeypatch, least, ngram):
    """What is linked by common words, with few or no other words in both, is found whatever counts as common."""
    monkeypatch.setattr("kestrelite.llm.neardup.COMMON_LEAST", least)
    for rows in (corpus(4), templates(2, 150)):
        for threshold in (0.6, 0.75):
            got = {tuple(r) for r in near_duplicate_groups(spark.createDataFrame(rows, SCHEMA), "doc_id", ["title", "snippet"], threshold, ngram=ngram).collect()}
            assert got == brute(rows, threshold)


def test_large_columns_of_stems(spark):
    """A column of two words is compared by sketches in its block while it is large, and spread in sub-blocks when it is larger."""
    rows = [(i, None, " ".join(["alpha", "beta"] + [f"u{i % 70}v{k}" for k in range(4)] + [f"w{i}"]), 1, 2, "x", "y") for i in range(150)]
    for hot in (512, 4):
        got = {tuple(r) for r in near_duplicate_groups(spark.createDataFrame(rows, SCHEMA), "doc_id", ["title", "snippet"], 0.6, hot=hot).collect()}
        assert got == brute(rows, 0.6)
