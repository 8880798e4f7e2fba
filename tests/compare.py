"""Run a query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import datetime
import math
import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings docs node_events responses queries shard_map sample_targets cluster_anchors eval_items subject_labels".split()


def connect():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


def same(spark, con, query, sql):
    df = query(spark, DATA)
    names = sorted(df.columns)
    ours = sorted(tuple(plain(r[n]) for n in names) for r in df.collect())
    rel = con.sql(sql)
    at = list(rel.columns)
    assert sorted(at) == names
    theirs = sorted(tuple(plain(r[at.index(n)]) for n in names) for r in rel.fetchall())
    assert ours == theirs
