"""Where operators keep what they write between Spark jobs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where that is unset, a temporary folder of our own on a local master, as in
    tests; on a cluster that is an error, as executors don't share such a folder."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-textloom-", dir="/tmp"))
    return named or context._jsc.sc().getCheckpointDir().get()


#: Rows that a task passes to Python at a time where texts of several documents may stand in a row.
FEW = 1000


@contextmanager
def batches_of(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Within, jobs that are started pass at most `rows` rows to Python at a time (None: as the session has it)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    if rows:
        spark.conf.set(key, str(min(rows, int(old) if int(old) > 0 else rows)))
    try:
        yield
    finally:
        spark.conf.set(key, old)


#: Documents that are worth a task where they, or what is made of them, are written.
DOCUMENTS = 5000


def tasks_for(rows: int, each: int) -> int:
    """How many tasks so many rows are worth: a table of few rows is no reason for a file from each shuffle partition."""
    return max(4, -(-rows // each))


def cut(df: DataFrame, rows: int | None = FEW, tasks: int | None = None) -> DataFrame:
    """Write df to the shared folder, from so many tasks at most, and read it back: computed once, and safe from lost
    executors."""
    shared_dir(df.sparkSession)
    with batches_of(df.sparkSession, rows):
        return (df.coalesce(tasks) if tasks else df).checkpoint()


def kept(df: DataFrame, path: str, rows: int = FEW, by: str | None = None, tasks: int | None = None) -> DataFrame:
    """df, written to a folder of the shared place (partitioned by a column, from so many tasks at most) and read back:
    computed once, only the columns asked for are read again, and Spark knows its size."""
    df = df.coalesce(tasks) if tasks else df
    with batches_of(df.sparkSession, rows):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for tables in the shared place."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that new_folder named, through the file system that holds it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def hash_sample(df: DataFrame, keys: list[str], rows: int) -> tuple[DataFrame, int]:
    """At most `rows` rows of df, the first in the order of a hash of the key columns, and the number of rows of df.

    The number sets a bound on the hash that about as many rows and some standard deviations pass, so no more than that
    leaves the tasks, however many there are. Many equal keys at the bound may leave out rows, never add any.
    """
    n = df.count()
    share = min(1.0, (rows + 6 * rows**0.5 + 10) / max(1, n))
    h = F.xxhash64(*keys)
    near = df.withColumn("sample_hash", h).filter(h <= F.lit(int(-(2**63) + share * (2**64 - 1) * (1 - 2**-50))))
    return near.orderBy("sample_hash", *keys).limit(rows).drop("sample_hash"), n


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
