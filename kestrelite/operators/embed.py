"""Text embedding: an encoder is any function of a text column that gives a unit vector.

The deterministic encoder draws a normal vector from a generator seeded by the text's hash and scales it to length 1: the same text has the same
vector everywhere. A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Encoder(Protocol):
    """What turns texts into vectors: made once in each worker, from what was sent there."""

    name: str
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray:
        """One row of `dim` numbers a text."""


def embedding(encoder: Encoder, batch: int = 64) -> Callable[[Column], Column]:
    """A column function by an encoder: at most `batch` texts at once, vectors scaled to length 1, a null text counts as empty.

    Vectors of another length, or without length, are an error.
    """

    @F.pandas_udf("array<float>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            held, out = [t or "" for t in texts], []
            for lo in range(0, len(held), batch):
                v = np.asarray(encoder.encode(held[lo : lo + batch]), np.float64)
                if v.shape != (len(held[lo : lo + batch]), encoder.dim):
                    raise ValueError(f"{encoder.name}: vectors of shape {v.shape}, not of length {encoder.dim}")
                n = np.linalg.norm(v, axis=1)
                if not (np.isfinite(n) & (n > 0)).all():
                    raise ValueError(f"{encoder.name}: a vector without length")
                out += list((v / n[:, None]).astype(np.float32))
            yield pd.Series(out)

    return encode


def hash_embedding(dim: int) -> Callable[[Column], Column]:
    @F.pandas_udf("array<float>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import xxhash

        for texts in parts:
            out = []
            for text in texts:
                v = np.random.default_rng(xxhash.xxh3_64_intdigest(text or "")).standard_normal(dim)
                out.append((v / np.linalg.norm(v)).astype(np.float32))
            yield pd.Series(out)

    return encode


def embedding_info(dim: int) -> dict:
    return {"model": "hash", "dim": dim, "ready": True}


def cached_embeddings(rows: DataFrame, id_column: str, text: Column, dim: int, cache: str, model: str = "hash", encode: Callable[[Column], Column] | None = None) -> DataFrame:
    """(id, vector) of `rows`, from a table of vectors by (model, text hash): texts that were embedded before aren't embedded again.

    Only missing texts are embedded, each distinct text once, and added to the table. Vectors of another length, or not of length 1, are an error.
    """
    spark = rows.sparkSession
    keyed = rows.select(F.col(id_column), text.alias("_text")).withColumn("text_hash", F.sha2(F.coalesce("_text", F.lit("")), 256))
    path = f"{cache}/model={model}-{dim}"
    try:
        known = spark.read.parquet(path)
    except AnalysisException:
        known = spark.createDataFrame([], "text_hash string, vector array<float>")
    missing = keyed.dropDuplicates(["text_hash"]).join(known.select("text_hash"), "text_hash", "left_anti")
    missing.select("text_hash", (encode or hash_embedding(dim))(F.col("_text")).alias("vector")).write.mode("append").option("maxRecordsPerFile", 8192).parquet(path)
    held = keyed.select(id_column, "text_hash").join(spark.read.parquet(path), "text_hash")
    n = F.sqrt(F.aggregate("vector", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double")))
    good = (F.size("vector") == dim) & (F.abs(n - 1) <= 1e-3)
    return held.select(id_column, F.when(good, F.col("vector")).otherwise(F.raise_error(F.lit("a vector has the wrong length or norm"))).alias("vector"))
