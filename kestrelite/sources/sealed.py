"""Sealed shard tables: written once with a manifest that comes last, and read only if every file is what the manifest says.

The manifest has a row per file (path below the table, bytes, SHA-256) and the row count of each shard. A table without manifest isn't sealed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelite.sources.filesystem import open_uri


class NotSealed(Exception):
    """The table has no manifest, or doesn't match it."""


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of each file: hashed as a stream, so a file of any size fits."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{path}/data").select("path", "length")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            sums = []
            for name in batch.column(0).to_pylist():
                system, inner = open_uri(name)
                h = hashlib.sha256()
                with system.open_input_stream(inner, compression=None) as stream:
                    while part := stream.read(1 << 22):
                        h.update(part)
                sums.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums, pa.string())], ["path", "bytes", "sha256"])

    hashed = found.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(digest, "path string, bytes long, sha256 string")
    return hashed.select(F.regexp_extract("path", r"/data/(.*)$", 1).alias("file"), "bytes", "sha256")


def write_sealed(rows: DataFrame, path: str, shard: str, records_per_file: int = 1_000_000) -> None:
    """Write and seal. A sealed path is never overwritten; a shard's rows go to as many tasks as it has files, by hash of the row."""
    spark = rows.sparkSession
    if is_sealed(spark, path):
        raise NotSealed(f"{path} is sealed already")
    files = rows.groupBy(F.col(shard).alias("_shard")).agg(F.ceil(F.count(F.lit(1)) / records_per_file).cast("int").alias("_files"))  # a row a shard
    salted = rows.join(F.broadcast(files), F.col(shard).eqNullSafe(F.col("_shard"))).withColumn("_salt", F.pmod(F.xxhash64(*[c for c in rows.columns if c != shard]), F.col("_files")))
    salted.repartition(shard, "_salt").drop("_shard", "_files", "_salt").sortWithinPartitions(shard).write.mode("overwrite").partitionBy(shard).option("maxRecordsPerFile", records_per_file).option("compression", "zstd").parquet(f"{path}/data")
    spark.read.parquet(f"{path}/data").groupBy(shard).agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/counts")
    _files(spark, path).write.mode("overwrite").parquet(f"{path}/manifest")


def is_sealed(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_sealed(spark: SparkSession, path: str, shard: str) -> DataFrame:
    """The rows, after every file was checked for presence, size and hash, and every shard for its number of rows."""
    if not is_sealed(spark, path):
        raise NotSealed(f"{path} has no manifest")
    said = spark.read.parquet(f"{path}/manifest").select("file", F.struct("bytes", "sha256").alias("said"))
    is_ = _files(spark, path).select("file", F.struct("bytes", "sha256").alias("is"))
    bad = said.join(is_, "file", "full_outer").where("NOT (said <=> is)").select("file").take(3)
    if bad:
        raise NotSealed(f"{path}: not as in the manifest: {', '.join(r['file'] for r in bad)}")
    rows = spark.read.parquet(f"{path}/data")
    n = rows.groupBy(F.col(shard).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    wrong = spark.read.parquet(f"{path}/counts").select(F.col(shard).alias("s"), F.col("n").alias("want")).join(n, "s", "full_outer").where("NOT (n <=> want)").take(1)
    if wrong:
        raise NotSealed(f"{path}: a shard has another number of rows than was sealed")
    return rows
