import random

from kestrelite.llm.subjects import subject_areas
from kestrelite.llm.subtitles import spoken_cues

DOCS = "doc_id long, text string, source string, subject string, share string"
LABELS = "doc_id long, subject string"
NOUNS = {"law": ["witness", "judge", "verdict", "appeal"], "sport": ["goalkeeper", "league", "referee", "trophy"], "music": ["melody", "violin", "chorus", "album"]}
TALK = ["Good morning, everyone.", "You never listen to me.", "Come on, hurry up!", "Where have you been?"]
FORMS = ["We found a {} behind the house.", "Did you check the {} again?", "You call this a {}?", "Without a {} we lose everything."]


def document(rng, subjects, n=20):
    lines = []
    for _ in range(n):
        s = rng.choice(subjects) if subjects and rng.random() < 0.75 else None
        lines.append(rng.choice(FORMS).format(rng.choice(NOUNS[s])) if s else rng.choice(TALK))
    return "".join(f"{i}\n00:00:01,000 --> 00:00:02,000\n{t}\n\n" for i, t in enumerate(lines))


def test_held_out_accuracy(spark):
    rng = random.Random(0)
    truth, docs, labels = {}, [], []
    for i in range(240):
        of = rng.sample(sorted(NOUNS), rng.choice([0, 1, 1, 2]))
        truth[i] = set(of)
        docs.append((i, document(rng, of), rng.choice(["a", "b", None]), "x", "y"))
        if i < 160 and of:
            labels += [(i, s) for s in of] * 2 if rng.random() < 0.95 else [(i, rng.choice(sorted(NOUNS)))]
    docs += [(900, None, "a", "", ""), (901, "", "a", "", ""), (902, "1\n00:00:01,000 --> 00:00:02,000\n(door slams)\n", "a", "", ""), (None, docs[0][1], "a", "", ""), docs[5]]
    labels += [(None, "law"), (3, None), (77777, "law")]
    out = subject_areas(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    got = {i: {r["subject"] for r in out if r["doc_id"] == i} for i in range(240)}
    assert len(out) == len({(r["doc_id"], r["subject"]) for r in out}) and all(r["doc_id"] is not None and r["doc_id"] < 900 for r in out)
    right = [got[i] == truth[i] for i in range(160, 240)]
    assert sum(right) / len(right) >= 0.9


def test_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, document(random.Random(1), ["law"]), "a", "", "")], DOCS)
    assert subject_areas(docs, spark.createDataFrame([], LABELS)).count() == 0
    assert subject_areas(spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "law")], LABELS)).count() == 0


def test_spoken_cues():
    text = "1\r\n00:00:01,000 --> 00:00:02,000\r\n<i>JOHN: Hello there.</i>\r\n\r\n00:00:03.000 --> 00:00:04.000\n[MUSIC]\n\n3\n00:00:05,000 --> 00:00:06,000\n♪ la la ♪\n\n4\n00:00:07,000 --> 00:00:08,000\nSynced and corrected by x\n"
    assert spoken_cues(text) == ["Hello there."]
    assert spoken_cues("{1}{20}One|two\n{21}{40}*sighs*\n{41}{60}== x team ==\n") == ["One two"]
    assert spoken_cues("1\n00:00:01,000 --> 00:00:02,000\nSee you\nwww.x.example\n") == ["See you"]
    assert spoken_cues("Read www.nasa.gov (really)\n\n12\n<b>More</b>") == ["Read www.nasa.gov (really)", "More"]
    assert spoken_cues(None) == [] and spoken_cues("plain text") == ["plain text"]
