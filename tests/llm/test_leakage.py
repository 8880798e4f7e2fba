import random

from kestrelite.llm.leakage import Index, leaked_items, robust, words_of

SCHEMA = "doc_id long, text string, item_id string, words string"
ITEM = "Forty hollow quilts stood beneath the copper bridge, and Wastunoid Sialmic traded away them although the council had forbidden it. What did the apprentice conclude?"
OTHER = "Past the crooked orchard nobody could follow the map, so the beekeeper's ladder gave way near the flooded quarry before spring. Who carried the second letter?"
ITEMS = [(1, ITEM), (2, OTHER), (3, ""), (4, None)]


def cue(n, text):
    return f"{n}\n00:00:{n % 60:02d},000 --> 00:00:{n % 60:02d},900\n{text}\n\n"


def subtitles(lines):
    return "".join(cue(i + 1, t) for i, t in enumerate(lines))


def parts(text, size=5):
    w = text.split()
    return [" ".join(w[i : i + size]) for i in range(0, len(w), size)]


TALK = ["Good morning, everyone.", "You never listen to me.", "Come on, hurry up!", "Nobody told me, Kemium."]


def held_out(spark, items=ITEMS):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id int, text string, doc_id string, words int")


def found(spark, texts):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in texts], SCHEMA)
    return {(r["item_id"], r["doc_id"]) for r in leaked_items(df, "doc_id", "text", held_out(spark)).collect()}


def test_whole_noisy_damaged_and_partial(spark):
    noisy = []
    for k, p in enumerate(parts(ITEM)):
        noisy += [["(DOOR SLAMS)", "<i>", "KEMIUM: ", "uh, ", "12 "][k % 5] + " " + p]
    damaged = ITEM.replace("hollow", "h0llow").replace("beneath", "bencath").replace("modern", "modem").replace("although", "aIthough").replace("council", "councll").upper()
    w = ITEM.split()
    texts = [
        (1, subtitles(TALK + parts(ITEM) + TALK)), (2, subtitles(TALK + noisy)), (3, subtitles(parts(damaged) + TALK)),
        (4, subtitles(TALK + parts(" ".join(w[: int(len(w) * 0.65)])))), (5, subtitles(TALK + parts(" ".join(w[: int(len(w) * 0.4)])) + TALK)),
        (6, subtitles(parts(" ".join(random.Random(0).sample(w, len(w)))))), (7, subtitles(parts(OTHER)[::-1])), (8, None), (9, ""), (None, ITEM), (10, subtitles(TALK * 3000 + parts(OTHER))), (1, subtitles(TALK + parts(ITEM) + TALK)),
    ]
    assert found(spark, texts) == {(1, 1), (1, 2), (1, 3), (1, 4), (2, 10)}


def test_threshold_never_loses_a_passage():
    """Whatever the block-max index retrieves contains all that alignment alone would find."""
    rng = random.Random(1)
    vocabulary = [f"term{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 30)))) for i in range(40)]
    index = Index(items, 0.55)
    docs = []
    for _ in range(60):
        i, t = rng.choice(items)
        w = t.split()
        cut = rng.randint(0, len(w) // 2)
        docs.append([rng.choice(vocabulary) for _ in range(rng.randint(0, 300))] + w[cut:] + [rng.choice(vocabulary) for _ in range(rng.randint(0, 300))])
    import numpy as np

    terms = [[index.vocabulary.get(robust(w), -1) for w in d] for d in docs]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in terms])[:-1]])
    got = set(index.retrieve(np.array([t for d in terms for t in d]), starts))
    need = {(d, k) for d in range(len(docs)) for k in range(len(items)) if index.holds(terms[d], k)}
    assert need and need <= got


def test_the_walk_retrieves_what_scoring_everything_would():
    """Block-max pivoting leaves out no item at or above its threshold and adds none below, for items of any length."""
    rng = random.Random(2)
    vocabulary = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 20, 60])))) for i in range(120)]
    index = Index(items, 0.55)
    assert len(index.parts) > 2
    for part in index.parts:
        for _ in range(50):
            terms = sorted(rng.sample(range(len(index.vocabulary)), rng.randint(1, 40)))
            score = dict.fromkeys(range(len(part.items)), 0.0)
            for t in terms:
                for place, x in zip(*part.postings.get(t, ([], [])), strict=True):
                    score[place] += x
            want = [part.items[p] for p, x in score.items() if x >= part.threshold[p] + 1e-9]
            loose = [part.items[p] for p, x in score.items() if x >= part.threshold[p] - 1e-9]
            got = part.walk(terms)
            assert set(want) <= set(got) <= set(loose) and len(got) == len(set(got))


def test_least_scores_are_exact():
    from itertools import combinations

    from kestrelite.llm.leakage import _least_score

    rng = random.Random(3)
    for _ in range(50):
        n = rng.randint(1, 8)
        impacts, counts = [rng.random() for _ in range(n)], [rng.randint(1, 4) for _ in range(n)]
        need = rng.randint(1, sum(counts))
        want = min(sum(impacts[i] for i in c) for k in range(1, n + 1) for c in combinations(range(n), k) if sum(counts[i] for i in c) >= need)
        assert abs(_least_score(impacts, counts, need) - want) < 1e-9


def test_long_items_and_plain_texts(spark):
    rng = random.Random(4)
    long = " ".join(f"{rng.choice('bcdfgklmnprs')}{rng.choice('aou')}{rng.choice('bdgmnps')}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(600))
    items = [*ITEMS, (9, long)]
    texts = [(1, long), (2, "Read on at www.nasa.gov or write to a@b.org:\n" + ITEM), (3, subtitles(parts(long, 7))), (4, subtitles(TALK + ["Download more at www.x.example\n" + ITEM]))]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in texts], SCHEMA)
    got = {(r["item_id"], r["doc_id"]) for r in leaked_items(df, "doc_id", "text", held_out(spark, items)).collect()}
    assert got == {(9, 1), (1, 2), (9, 3), (1, 4)}


def test_other_scripts(spark):
    russian, chinese = "Сорок пустых одеял стояли под медным мостом и никто не знал зачем", "四十条空被子站在铜桥下面没有人知道为什么"
    df = spark.createDataFrame([(1, subtitles(TALK + parts(russian)), "", ""), (2, subtitles([chinese])[:-2], "", ""), (3, subtitles(TALK), "", "")], SCHEMA)
    got = {(r["item_id"], r["doc_id"]) for r in leaked_items(df, "doc_id", "text", held_out(spark, [(1, russian), (2, chinese)])).collect()}
    assert got == {(1, 1), (2, 2)}


def test_items_in_several_sets(spark, monkeypatch):
    monkeypatch.setattr("kestrelite.llm.leakage.SET", 1)
    assert found(spark, [(1, subtitles(parts(ITEM))), (2, subtitles(parts(OTHER)))]) == {(1, 1), (2, 2)}


def test_words_and_empty(spark):
    assert words_of("L'été, thirty-one 12 uh ?a") == ["lt", "thirtyone", "a"]
    assert robust("modern") == robust("modem") and robust("Iist".lower()) == robust("list")
    assert leaked_items(spark.createDataFrame([], SCHEMA), "doc_id", "text", held_out(spark)).count() == 0
    assert leaked_items(spark.createDataFrame([(1, ITEM, "", "")], SCHEMA), "doc_id", "text", held_out(spark, [])).count() == 0
