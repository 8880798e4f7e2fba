"""Intermediate tables in the folder that the whole cluster shares.

An executor can be lost at any time, so nothing here relies on an executor's own disk: lineage is cut by a Parquet table below
`spark.checkpoint.dir`, which every executor reads. Only a local session (one machine, as in tests) without that setting gets a folder of its own;
on a cluster its absence is an error, as a folder of one machine would be lost with it.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`; in a local session without one, a temporary folder that is then set as the checkpoint folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the whole cluster shares")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        folder = tempfile.mkdtemp(prefix="kestrelite-")
        atexit.register(shutil.rmtree, folder, True)
        _OWN[app] = "file://" + folder
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/kestrelite/{tag}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may already be gone
        pass


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a folder, if it is there."""
    _remove(spark, path)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """`df` written once and read back: cuts lineage, survives the loss of any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._kestrelite_path = path
    return back


_STORED: dict[tuple, str] = {}


def stored(spark: SparkSession, name: tuple, build) -> str:
    """The path of a table that `build(path)` writes once a session; every later call by the same name reads what is there."""
    key = (spark.sparkContext.applicationId, *name)
    if key not in _STORED:
        path = scratch_path(spark, str(name[0]))
        build(path)
        _STORED[key] = path
    return _STORED[key]


def release(df: DataFrame) -> None:
    """Remove a table made by `materialize` that no later plan reads."""
    path = getattr(df, "_kestrelite_path", None)
    if path:
        _remove(df.sparkSession, path)
