"""Messages delivered at least once: keep exactly one copy of each.

Plan: only the identifier, the delivery order and the row's place (file, row index) are shuffled; the smallest order per identifier wins.
The places of the other copies become one deletion vector per file, written to the shared folder. The wide rows are then read once, straight
from their files, and rows in their file's vector are dropped: payloads are never shuffled, and no vector is broadcast. The few messages with more than
a part in HOTTEST of all rows each, at most HOTTEST of them, are the only ones broadcast: their copies are told where they lie, so that one message
with a third of all rows is no task of its own.

Defined results
  * An identifier with a null part names no message: such rows are all kept and count as no repetition.
  * Ties in the delivery order are broken by (file, row index), so the outcome doesn't depend on the partitioning.
  * An empty table gives an empty table. Columns of any name pass through unchanged, also names used here.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrelite.scratch import materialize, scratch_path
from kestrelite.sources.filesystem import open_uri

#: How many messages can be hot, at most, and how many copies make one hot, at least.
HOTTEST, HOT_COPIES = 10_000, 100_000
BLANKS = " \t\r\n\f\v"
_VECTORS: dict[tuple[str, int], object] = {}


def normalised_node(node: Column) -> Column:
    """A node's name without surrounding blanks, in lower case."""
    return F.lower(F.btrim(node, F.lit(BLANKS)))


def _place(df: DataFrame) -> tuple[Column, Column]:
    meta = df.metadataColumn("_metadata")
    return F.xxhash64(meta["file_path"]), meta["row_index"]


def _narrow(df: DataFrame, identity: Mapping[str, Column], order: Sequence[Column]) -> DataFrame:
    file, row = _place(df)
    at = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], file.alias("file"), row.alias("row"))
    narrow = df.select(*[c.alias(f"k_{n}") for n, c in identity.items()], at.alias("at"))
    return narrow.where(" AND ".join(f"`k_{n}` IS NOT NULL" for n in identity))


def delivery_winners(df: DataFrame, identity: Mapping[str, Column], order: Sequence[Column]) -> DataFrame:
    """One row per message: its identifier (`k_<name>`), `win` = order and place of the copy that stays, `copies`.

    The aggregate has a map-side half, so one message that holds a third of all rows costs each task one row.
    """
    narrow = _narrow(df, identity, order)
    return narrow.groupBy([f"k_{n}" for n in identity]).agg(F.min("at").alias("win"), F.count(F.lit(1)).alias("copies"))


def _load_vector(root: str, file: int):
    import numpy as np
    import pyarrow.dataset as ds
    from pyarrow import fs

    if (root, file) not in _VECTORS:
        if len(_VECTORS) > 8:  # a task reads few files at a time
            _VECTORS.clear()
        system, path = open_uri(f"{root}/file={file}")
        if system.get_file_info(path).type == fs.FileType.NotFound:
            rows = np.empty(0, "int64")
        else:
            rows = np.sort(ds.dataset(path, filesystem=system, format="parquet").to_table(columns=["row"])["row"].to_numpy())
        _VECTORS[root, file] = rows
    return _VECTORS[root, file]


def deletion_vectors(df: DataFrame, identity: Mapping[str, Column], order: Sequence[Column]) -> str:
    """Write, per file of `df`, the row indexes of the copies that don't stay; the path of that table. Only identifiers, orders and places move."""
    keys, narrow = [f"k_{n}" for n in identity], _narrow(df, identity, order)
    winners = materialize(delivery_winners(df, identity, order).where("copies > 1"), "winners")
    most = max(HOT_COPIES, df.count() // HOTTEST)
    hot = winners.where(F.col("copies") > most).drop("copies")
    if hot.limit(1).count():
        # Both sides of the split read the scan; only rows of other messages are shuffled.
        losers = narrow.join(F.broadcast(hot), keys).union(narrow.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(winners.where(F.col("copies") <= most).drop("copies"), keys))
    else:
        losers = narrow.join(winners.drop("copies"), keys)
    losers = losers.where("at <> win").select("at.file", "at.row")
    root = scratch_path(df.sparkSession, "deletion-vectors")
    # A file's vector is split over several tasks by row range, so one file full of repetitions isn't one task's work.
    losers.repartition("file", F.expr("row div 1048576")).write.partitionBy("file").parquet(root)
    return root


def _stays(df: DataFrame, root: str) -> Column:
    @F.pandas_udf("boolean")
    def stays(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        import numpy as np

        for file, row in parts:
            keep, rows = np.ones(len(row), bool), row.to_numpy()
            for f in pd.unique(file):
                gone = _load_vector(root, int(f))
                if len(gone):
                    of = (file == f).to_numpy()
                    at = np.minimum(np.searchsorted(gone, rows[of]), len(gone) - 1)
                    keep[of] = gone[at] != rows[of]
            yield pd.Series(keep)

    return stays(*_place(df))


def one_per_message(df: DataFrame, identity: Mapping[str, Column], order: Sequence[Column]) -> DataFrame:
    """The rows of `df` (a scan of files) with exactly one copy of each message; all columns as they were."""
    return df.where(_stays(df, deletion_vectors(df, identity, order))).select(*[df[f"`{c}`"] for c in df.columns])


def repeated_messages(df: DataFrame, identity: Mapping[str, Column], order: Sequence[Column]) -> DataFrame:
    """One row, the identifier, per message delivered more than once: the messages of the rows that the deletion vectors take out."""
    gone = df.where(~_stays(df, deletion_vectors(df, identity, order)))
    return gone.select(*[c.alias(n) for n, c in identity.items()]).distinct()
