"""Files opened inside tasks, where there is no session: by the same addresses that Spark reads."""

from __future__ import annotations

#: Names of a store's scheme that differ between the readers.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def open_uri(uri: str):
    """(file system, path in it) of an address as Spark writes it."""
    from pyarrow import fs

    scheme, _, rest = uri.partition(":")
    if "://" not in uri:
        uri = f"file://{rest}" if scheme == "file" else uri
    elif scheme in SCHEMES:
        uri = f"{SCHEMES[scheme]}:{rest}"
    return fs.FileSystem.from_uri(uri)
