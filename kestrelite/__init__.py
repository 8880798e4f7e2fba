"""Kestrelite: vector search and telemetry analytics as declarative Spark plans."""

__version__ = "0.1.0"
