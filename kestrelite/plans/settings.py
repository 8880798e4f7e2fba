"""Strict settings: a missing or wrong field is an error that names its dotted path."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any


class SettingsError(ValueError):
    pass


@dataclass(frozen=True)
class Settings:
    model_dim: int
    shards: int
    replicas: int
    partitioning: str
    index_type: str
    m: int = 16
    ef_construction: int = 100
    ef_search: int = 100


FIELDS: dict[str, tuple[str, type, tuple]] = {
    "model_dim": ("model.dim", int, ()),
    "shards": ("cluster.shards", int, ()),
    "replicas": ("cluster.replicas", int, (1, 2)),
    "partitioning": ("cluster.partitioning", str, ("hash", "semantic")),
    "index_type": ("index.type", str, ("hnsw", "bruteforce")),
    "m": ("index.M", int, ()),
    "ef_construction": ("index.ef_construction", int, ()),
    "ef_search": ("index.ef_search_default", int, ()),
}


#: Fields that belong to parts which this engine hasn't: addresses, folders, deadlines and the like.
IGNORED = {"": ("ports", "paths", "trace", "timeouts_ms", "health"), "model": ("name", "metric"), "index": ("M0", "seed")}


def _at(tree: Any, path: str) -> Any:
    for part in path.split("."):
        if not isinstance(tree, dict) or part not in tree:
            return None
        tree = tree[part]
    return tree


def _unknown(tree: Any, at: str = "") -> None:
    known = {path for path, _, _ in FIELDS.values()}
    for name, v in tree.items():
        path = f"{at}{name}"
        if any(k.startswith(f"{path}.") for k in known):
            if not isinstance(v, dict):
                raise SettingsError(f"{path}: {v!r} is no mapping")
            _unknown(v, f"{path}.")
        elif path not in known and name not in IGNORED.get(at.rstrip("."), ()):
            raise SettingsError(f"{path}: unknown")


def read_settings(path: str) -> Settings:
    """Settings of a JSON file, or of a YAML file where a YAML reader is installed."""
    import json

    try:
        with open(path) as f:
            text = f.read()
    except OSError as e:
        raise SettingsError(f"{path}: {e}") from e
    if path.endswith(".json"):
        return load_settings(json.loads(text))
    try:
        import yaml
    except ImportError as e:
        raise SettingsError(f"{path}: only JSON can be read here") from e
    return load_settings(yaml.safe_load(text))


def load_settings(tree: dict) -> Settings:
    """Settings of a nested mapping, as read from YAML or JSON. A field that nothing here knows is an error, as a misspelt one would be lost."""
    if not isinstance(tree, dict):
        raise SettingsError("no mapping")
    _unknown(tree)
    values = {}
    for name, (path, kind, allowed) in FIELDS.items():
        v = _at(tree, path)
        if v is None:
            if name in ("m", "ef_construction", "ef_search"):
                continue
            raise SettingsError(f"{path}: missing")
        if not isinstance(v, kind) or isinstance(v, bool) or (kind is int and v <= 0):
            raise SettingsError(f"{path}: {v!r} is no {'positive ' if kind is int else ''}{kind.__name__}")
        if allowed and v not in allowed:
            raise SettingsError(f"{path}: {v!r} is none of {', '.join(map(str, allowed))}")
        values[name] = v
    return Settings(**values)
