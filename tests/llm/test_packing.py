import os
import random

import numpy as np
import pytest

from kestrelite.llm.packing import TOKENIZER, count_tokens, fill, pack_texts

SCHEMA = "doc_id long, text string, tokens int, shard int, terms string"
pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer files")


def test_every_text_is_in_containers_once(spark):
    rng = random.Random(0)
    vocabulary = [f"word{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60))), 1, 2, "x") for i in range(200)]
    rows += [(500, "long " * 1000, 1, 2, "x"), (501, None, 1, 2, "x"), (502, "", 1, 2, "x"), (None, "no id", 1, 2, "x"), (3, rows[3][1], 1, 2, "x")]
    got = pack_texts(spark.createDataFrame(rows, SCHEMA), "doc_id", "text", 256, shard_items=100).collect()
    room = {}
    for r in got:
        room[r["container_id"]] = room.get(r["container_id"], 0) + r["tokens"]
    assert max(room.values()) <= 256
    have = {}
    for r in got:
        have.setdefault(r["doc_id"], []).append((r["start_token"], r["tokens"]))
    want = {}
    for i, t, *_ in rows:
        if t:
            want[i] = want.get(i, 0) + count_tokens(t)
    assert {i: sum(n for _, n in v) for i, v in have.items()} == want
    assert all(len(v) == 1 for i, v in have.items() if i not in (3, 500))
    pieces = sorted(have[500])
    assert [s for s, _ in pieces] == [256 * k for k in range(len(pieces))]
    assert sum(room.values()) / (256 * len(room)) > 0.93


def test_containers_do_not_depend_on_the_partitioning(spark):
    rng = random.Random(1)
    rows = [(i % 150, " ".join(rng.choice(["red", "green", "blue", "grey", "pink"]) for _ in range(rng.randint(1, 40))), 1, 2, "x") for i in range(200)]
    rows += [(7, "the same row", 1, 2, "x")] * 300 + [(None, "no id", 1, 2, "x")] * 5
    df = spark.createDataFrame(rows, SCHEMA)
    got = [sorted(map(str, pack_texts(df.repartition(n), "doc_id", "text", 64, shard_items=60).collect())) for n in (2, 7)]
    assert got[0] == got[1] and len(got[0]) >= len(rows)
    spread = {r["container_id"] >> 32 for r in pack_texts(df, "doc_id", "text", 64, shard_items=60).where("doc_id = 7").collect()}
    assert len(spread) > 4  # copies of one row are in all shards


def test_fill_prefers_near_items():
    sizes = np.array([60, 40, 40, 40])
    near = {0: np.array([0.0, 1.0, 5.0, 2.0])}
    assert fill(sizes, 100, lambda seed: near.get(seed, np.zeros(4)))[0] == [(0, "seed"), (2, "index")]


def test_empty(spark):
    assert pack_texts(spark.createDataFrame([], SCHEMA), "doc_id", "text").count() == 0
    assert pack_texts(spark.createDataFrame([(1, None, 1, 1, "")], SCHEMA), "doc_id", "text").count() == 0
