"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Rows of a key table that may be broadcast (a long and its hash entry: some 30 bytes each).
BROADCAST_KEYS = 400_000
#: Rows of a batch of texts that a Python worker is given, and its bytes, about: long texts make small batches.
ARROW_ROWS = 1000
ARROW_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent, a local folder is used if driver and
    executors are one process (tests, a laptop); a cluster without it is an
    error, as each executor would write to its own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not (spark.sparkContext.master or "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = os.path.join(tempfile.gettempdir(), "tamis-checkpoints")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(own)
    return own


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    Cuts the lineage in a way that outlives lost executors; columnar and
    compressed, so smaller than an RDD checkpoint.  The files go when the
    driver ends, as results are read from them until then.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tamis/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def lean(run):
    """run (batches to batches, in a Python task), after which the worker gives freed memory back: it stays for tasks to come."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def release() -> None:
    """What this process has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of ARROW_ROWS rows and some ARROW_BYTES at most, for this session, as JVM and worker both hold a batch."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    # an executor's JVM keeps its buffers outside the heap for batches to come, so the largest batch counts
    most = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(most) > ARROW_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def discard(df: DataFrame) -> None:
    """Delete what `settle` wrote of df, which isn't read again, and let the shuffles go that nothing refers to."""
    spark = df.sparkSession
    for f in df.inputFiles()[:1]:
        place = spark._jvm.org.apache.hadoop.fs.Path(f).getParent()
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    spark._jvm.System.gc()


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  Pure ASCII texts take the quick built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join in which null keys match each other; the right side's keys go."""
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") if k in keys else F.col(k) for k in right.columns])
    on = None
    for k in keys:
        one = left[k].eqNullSafe(renamed[f"__r_{k}"])
        on = one if on is None else on & one
    out = left.join(renamed, on, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"__r_{k}" for k in keys])


def restrict(df: DataFrame, keys: DataFrame, on: str, n_keys: int) -> DataFrame:
    """Rows of df whose `on` is in keys (distinct, n_keys rows).

    Up to BROADCAST_KEYS keys are broadcast, so df (wide texts) isn't
    shuffled; beyond it, a shuffled semi-join with the same result.
    """
    side = keys.select(on)
    return joined(df, F.broadcast(side) if n_keys <= BROADCAST_KEYS else side, [on], "left_semi")


def without(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of df whose `on` isn't in keys (distinct); broadcast as in `restrict`."""
    side = settle(keys.select(on), "without")
    return joined(df, F.broadcast(side) if side.count() <= BROADCAST_KEYS else side, [on], "left_anti")


def one_of_each(df: DataFrame, judged: DataFrame, key: str, id_col: str) -> DataFrame:
    """Rows of df whose key isn't judged and, of each group in judged (key, win, id, copies), one row with key win and that id.

    Ids are compared null-safely; where the winner has several copies, one stays.
    """
    side = judged.toDF("__j_key", "__j_win", "__j_id", "__j_copies")
    side = F.broadcast(side) if judged.count() <= BROADCAST_KEYS // 4 else side
    both = df.join(side, F.col(key) == F.col("__j_key"), "left")
    both = both.where(F.col("__j_key").isNull() | ((F.col(key) == F.col("__j_win")) & F.col(id_col).eqNullSafe(F.col("__j_id"))))
    if not judged.where("copies > 1").isEmpty():
        both = both.where("coalesce(__j_copies, 1) = 1").union(both.where("__j_copies > 1").dropDuplicates([key]))
    return both.select(*df.columns)


def sampled(rows: DataFrame, id_col: str, limit: int) -> DataFrame:
    """At most `limit` ids' rows, chosen by a hash of the id: a bounded sample for fitting."""
    order = F.xxhash64(F.col(id_col).cast("string"))
    ids = rows.select(F.col(id_col).alias("__sid"), order.alias("__o")).orderBy("__o").limit(limit).select("__sid")
    return rows.join(F.broadcast(ids.distinct()), F.col(id_col) == F.col("__sid"), "left_semi")
