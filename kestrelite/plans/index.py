"""The two kinds of index behind one face: built from vectors by shard, searched by a query set and a plan, with the same columns in the result."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelite.operators.graph_index import build_graphs, check_graph, search_graphs
from kestrelite.operators.search import HITS, Route, shard_hits
from kestrelite.plans.settings import Settings
from kestrelite.sources.sealed import read_sealed, write_sealed


class VectorIndex(Protocol):
    def seal(self, vectors: DataFrame, path: str, shards: int, seed: int = 0) -> None:
        """Build for (doc_id, shard_id, vector) and keep what a search needs below `path`."""

    def search(self, vectors: DataFrame, path: str, queries: DataFrame, k: int, ef: int, plan: DataFrame | Route | None = None) -> DataFrame:
        """(qid, shard_id, doc_id, score): the k best of each probed shard."""


@dataclass(frozen=True)
class Exact:
    dim: int

    def seal(self, vectors: DataFrame, path: str, shards: int, seed: int = 0) -> None:
        """Nothing is built."""

    def search(self, vectors: DataFrame, path: str, queries: DataFrame, k: int, ef: int, plan: DataFrame | Route | None = None) -> DataFrame:
        return shard_hits(vectors, queries, k, self.dim, plan)


@dataclass(frozen=True)
class Graphs:
    dim: int
    m: int = 16
    ef_construction: int = 100

    def seal(self, vectors: DataFrame, path: str, shards: int, seed: int = 0) -> None:
        tasks = vectors.select("doc_id", "shard_id", "vector").repartition(shards, "shard_id")  # a task a shard
        write_sealed(build_graphs(tasks, self.dim, self.m, self.ef_construction, seed), path, "shard_id")
        check_graph(read_sealed(vectors.sparkSession, path, "shard_id"), vectors, self.dim, self.m)

    def search(self, vectors: DataFrame, path: str, queries: DataFrame, k: int, ef: int, plan: DataFrame | Route | None = None) -> DataFrame:
        edges = vectors.sparkSession.read.parquet(f"{path}/data")
        return search_graphs(vectors, edges, queries, self.dim, k, ef, self.m, plan=plan).select(*[F.col(c.split()[0]) for c in HITS.split(", ")])


def index_of(kind: str, dim: int, m: int = 16, ef_construction: int = 100) -> VectorIndex:
    """The index that the settings name."""
    return Graphs(dim, m, ef_construction) if kind == "hnsw" else Exact(dim)


def index_for(settings: Settings) -> VectorIndex:
    return index_of(settings.index_type, settings.model_dim, settings.m, settings.ef_construction)
