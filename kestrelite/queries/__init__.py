"""Registered queries of the core, by module; each has QUERIES (name to function of session and folder) and ORACLE (name to SQL)."""

from __future__ import annotations

from importlib import import_module

MODULES = ("training_core", "search", "telemetry", "partitioning", "membership", "control", "corpus", "graph_index", "streams")


def collect() -> tuple[dict, dict]:
    queries: dict = {}
    oracle: dict = {}
    for name in MODULES:
        module = import_module(f"kestrelite.queries.{name}")
        queries |= module.QUERIES
        oracle |= module.ORACLE
    return queries, oracle
