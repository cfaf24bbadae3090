"""Files in and tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def safe_path(root: str, name: str) -> str:
    """root/name, refusing names that lead out of root."""
    if name.startswith("/") or "://" in name or ".." in name.replace("\\", "/").split("/"):
        raise ValueError(f"{name!r} leads out of {root!r}")
    return f"{root.rstrip('/')}/{name}"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per file of any store that Spark reads: path, text; bytes that aren't UTF-8 become U+FFFD."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "modificationTime", "length", decode_replacing("content").alias("text"))


def decode_replacing(content: str) -> Column:
    @F.pandas_udf("string")
    def decode(data):
        return data.map(lambda b: bytes(b).decode("utf-8", "replace"))

    return decode(F.col(content))


def read_bytes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def delete(spark: SparkSession, path: str) -> bool:
    """Whether there was something to delete; doing it twice is no error."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def upload(spark: SparkSession, local: str, root: str, name: str) -> str:
    """Copy a file of the driver's disk to root/name in any store that Spark writes; returns its path."""
    path = safe_path(root, name)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.copyFromLocalFile(False, True, hadoop(f"file://{local}"), hadoop(path))
    return path


def download(spark: SparkSession, root: str, name: str, local: str) -> str:
    """Copy root/name to a file of the driver's disk."""
    path = safe_path(root, name)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.copyToLocalFile(False, hadoop(path), hadoop(f"file://{local}"), True)
    return local


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks by collection, with a preview of at most 500 characters. Those whose chunk_id is there already, which means
    the same content, are not written again."""
    spark = chunks.sparkSession
    rows = chunks.dropDuplicates(["chunk_id"])
    if exists(spark, path):
        rows = rows.join(spark.read.parquet(path).select("chunk_id"), "chunk_id", "left_anti")
    rows.withColumn("text_preview", F.substring("text", 1, 500)).write.mode("append").partitionBy("collection").parquet(path)


def write_documents(rows: DataFrame, path: str) -> int:
    """Document rows (doc_id, ...), new ones in place of old ones; returns the version that stores.read_latest reads."""
    from .stores import upsert_table

    return upsert_table(rows, path, "doc_id")
