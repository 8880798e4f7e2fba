"""A reproducible sample that stays as data grows, by a golden-ratio sequence.

Each id has a persistent sequence number, 0, 1, 2, ... in order of its first insertion (ties: the id). Number s is mapped to the fraction of
s times the golden ratio plus a fixed shift, and is selected if that lies in [0, rate). Fractions of any run of consecutive numbers are spread
evenly, so each stretch of growth is sampled at the same rate, to within a few ids. Later insertions get later numbers: what was selected stays.

Fractions are exact: 40-bit integers, multiplied in two halves. Numbers above 2^40 continue the same way (only their lower 40 bits count).

The numbers are kept in a register, a folder of tables (doc_id, seq), one per run that met new ids. A run reads it, numbers only ids that it
doesn't have, and adds those as one more table. So a known id keeps its number for good, whatever comes later: ids inserted late with an earlier
time, ids without a time, ids seen out of order. Only ids new in the same run are put in order of first insertion. A table of the register is
written beside it and renamed, which fails if another run was faster; the slower run then starts again from the register as it is.

Numbering takes one sort of the new ids by range, written once; ranges get their offset from the counts of the ranges before (one number a range).

Defined results: a repeated id counts once, by its first insertion; an id without any insertion time comes after the others that are new in the
same run; a null id is left out; an id that has left the table is in no sample, but keeps its number; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelite.scratch import materialize, scratch_path

BITS = 40
#: Odd number nearest to 2^40 divided by the golden ratio.
STEP = 679_535_556_991
NUMBERED = "doc_id long, seq long"


def fraction(seq: Column, shift: int) -> Column:
    """Fraction of the golden multiple of `seq`, in units of 2^-40."""
    half, low_step = 1 << 20, STEP % (1 << 20)
    s = F.pmod(seq, F.lit(1 << BITS))
    low, high = F.pmod(s, F.lit(half)), F.shiftright(s, 20)
    return F.pmod(low * F.lit(STEP) + F.pmod(high * F.lit(low_step), F.lit(half)) * F.lit(half) + F.lit(shift % (1 << BITS)), F.lit(1 << BITS))


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _generations(spark: SparkSession, register: str) -> int:
    """How many tables the register has; they are numbered from 0."""
    at, system = _file_system(spark, register)
    if not system.exists(at):
        return 0
    return sum(f.getPath().getName().startswith("run-") for f in system.listStatus(at))


def read_register(spark: SparkSession, register: str) -> DataFrame:
    """(doc_id, seq) of all ids that were ever numbered."""
    n = _generations(spark, register)
    return spark.read.schema(NUMBERED).parquet(*[f"{register}/run-{i:06d}" for i in range(n)]) if n else spark.createDataFrame([], NUMBERED)


def _publish(spark: SparkSession, written: str, register: str, run: int) -> bool:
    """Rename a finished table into the register, unless there is one of that number already."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(written), jvm.org.apache.hadoop.fs.Path(f"{register}/run-{run:06d}")
    target.getFileSystem(conf).mkdirs(target.getParent())
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf)
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        files.rename(source, target, none)  # an error, unlike FileSystem.rename, if the target exists
    except Exception:
        if target.getFileSystem(conf).exists(target):
            return False
        raise
    return True


def _numbered(first: DataFrame, start: int) -> DataFrame:
    """Dense numbers from `start` on, in order of (t, doc_id), unknown times last."""
    spark = first.sparkSession
    at = F.monotonically_increasing_id()
    ranges = first.orderBy(F.col("t").isNull(), "t", "doc_id")
    placed = materialize(ranges.select("doc_id", F.shiftright(at, 33).cast("int").alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("i")), "sequence")
    offsets, n = [], start
    for r in sorted(placed.groupBy("part").agg(F.max("i").alias("last")).collect()):
        offsets.append((r["part"], n))
        n += r["last"] + 1
    bases = F.broadcast(spark.createDataFrame(offsets, "part int, base long"))  # one row a range
    return placed.join(bases, "part").select("doc_id", (F.col("base") + F.col("i")).alias("seq"))


def number_ids(rows: DataFrame, id_column: str, time_column: str, register: str) -> DataFrame:
    """(doc_id, seq) of all ids of `rows` and of the register, which is extended by those that it didn't have."""
    spark = rows.sparkSession
    first = rows.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{time_column}`").alias("t")).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("t").alias("t"))
    while True:
        run, known = _generations(spark, register), read_register(spark, register)
        fresh, start = first, 0
        if run:
            fresh = first.join(known.select("doc_id"), "doc_id", "left_anti")
            last = known.agg(F.max("seq")).first()[0]
            start = 0 if last is None else last + 1
        written = scratch_path(spark, "register")
        _numbered(fresh, start).write.parquet(written)
        if run and spark.read.schema(NUMBERED).parquet(written).limit(1).count() == 0:
            return known
        if _publish(spark, written, register, run):
            return read_register(spark, register)


def growing_sample(rows: DataFrame, id_column: str, time_column: str, permille: int, shift: int = 0, register: str | None = None) -> DataFrame:
    """(doc_id, seq) of the sample: `permille` thousandths of the ids. `register`: the folder that keeps the numbers; without one they last for this call only."""
    kept = register is not None
    register = register or scratch_path(rows.sparkSession, "growing-register")
    numbered = number_ids(rows, id_column, time_column, register)
    chosen = numbered.where(fraction(F.col("seq"), shift) < (1 << BITS) * permille // 1000)
    if not kept:
        return chosen
    return chosen.join(rows.select(F.col(f"`{id_column}`").alias("doc_id")), "doc_id", "left_semi")
