"""Corpus preparation: normalised records, stratified sample, query set, digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrelite.functions.scalars import collapsed
from kestrelite.operators.ordered import sliced, with_number

#: Buckets and their shares of a sample, in thousandths.
SHARES = {"cs": 350, "math": 200, "physics": 300, "q-bio": 50, "other": 100}


def normalise_records(raw: DataFrame, id_column: str, title: str, abstract: str, categories: str, least: int = 100) -> DataFrame:
    """(doc_id, title, abstract, category): white space collapsed, first category kept; records without id, title or category, or with an abstract
    of fewer than `least` characters, are dropped."""
    out = raw.select(F.col(f"`{id_column}`").alias("doc_id"), collapsed(F.col(f"`{title}`")).alias("title"), collapsed(F.col(f"`{abstract}`")).alias("abstract"), F.nullif(F.regexp_extract(collapsed(F.col(f"`{categories}`")), r"^([^ ]+)", 1), F.lit("")).alias("category"))
    return out.where(F.col("doc_id").isNotNull() & (F.length("title") > 0) & (F.length("abstract") >= least) & F.col("category").isNotNull())


def stratified_sample(rows: DataFrame, id_column: str, bucket: str, size: int, seed: int) -> DataFrame:
    """Rows in quotas of `size` per bucket, at least 1, never topped up; of each bucket those of smallest hash. One row per id."""
    quota = F.lit(0)
    for b, share in SHARES.items():
        quota = F.when(F.col(bucket) == b, max(1, size * share // 1000)).otherwise(quota)
    once = rows.dropDuplicates([id_column]).withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_column).cast("string"))))
    numbered = with_number(sliced(once, [bucket], ["_h", id_column]), [bucket], ["_h", id_column], "_k")
    return numbered.where(F.col("_k") <= quota).drop("_h", "_k", "_slice")


def query_set(rows: DataFrame, id_column: str, text: str, n: int, seed: int) -> DataFrame:
    """(qid, text, source_doc_id): `n` records by hash, numbered from 0 in order of id."""
    from pyspark.sql import Window

    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_column).cast("string")))
    taken = rows.dropDuplicates([id_column]).orderBy(h, id_column).limit(n)  # at most n rows, so one task numbers them
    return taken.select((F.row_number().over(Window.orderBy(id_column)) - 1).cast("long").alias("qid"), F.col(text).alias("text"), F.col(id_column).alias("source_doc_id"))


def corpus_digest(rows: DataFrame, *columns: Column) -> DataFrame:
    """(n, digest): a digest of the rows whatever their order: the sum of 60 bits of each row's MD5. Rows may repeat."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("\\N")) for c in columns])
    part = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(20,0)")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.lower(F.hex(F.pmod(F.sum(part), F.lit(1 << 60).cast("decimal(20,0)")).cast("bigint"))).alias("digest"))
