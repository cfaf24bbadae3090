"""From raw documents to packed training sequences: five stages, each over all rows that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents, with n_chars kept in step with text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import langid, neardup, packing, pii, substrings
from textloom.llm.queries import tokenizer_path
from textloom.llm.shared import new_folder


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the learned languages go: no letter (so null and empty texts too), or less than half of the
    probability for any. Repeated rows share a verdict; an empty table, or one without labels, keeps no row."""
    net = langid.fit(docs)
    named = docs.withColumnRenamed("lang", "declared")
    found = langid.identify(named, net).filter("lang_pred <> 'und' and score >= 0.5")
    return found.withColumnRenamed("declared", "lang").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of the smallest doc_id, with all its texts, each once. Rows without
    doc_id stay."""
    kept = neardup.near_duplicates(docs, size=5, percent=80).filter("kept and doc_id is not null").select("doc_id").distinct()
    one = docs.filter("doc_id is not null").join(kept, "doc_id", "left_semi").withColumn("copy", F.xxhash64("text")).dropDuplicates(["doc_id", "copy"])
    return one.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 50 that an earlier document holds go; texts that lose none keep their spacing, null and empty
    ones too. A text that loses all its words stays as an empty one."""
    cut = substrings.dedup(docs, window=50, with_text=True).filter("n_removed > 0").select("doc_id", "copy", "kept_text").dropDuplicates(["doc_id", "copy"])
    joined = docs.withColumn("copy", F.xxhash64("text")).join(cut, ["doc_id", "copy"], "left")
    return _sized(joined.withColumn("text", F.coalesce("kept_text", "text"))).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; null and empty texts and repeated rows stay as they are."""
    return _sized(pii.mask(docs)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens, placed in sequences; a null or empty text is a piece of its end token, and repeated
    rows are placed one by one."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), end_id=2, length=1024)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packed", packed),
]

#: SQL can't express the network, nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what each returns is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
