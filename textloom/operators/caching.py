"""Embedding through a cache table keyed by content, and tables of health checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cache_key(provider: Column, model: Column, text: Column, prefix: str = "emb:") -> Column:
    return F.concat(F.lit(prefix), F.sha2(F.concat_ws(":", provider, model, text), 256))


def plan(texts: DataFrame, cache: DataFrame, now: Column | None = None, ttl: int = 86_400) -> DataFrame:
    """(row_id, key, text) with hit: whether the cache (key, vector, written_at) holds a vector younger than ttl seconds."""
    fresh = cache if now is None else cache.filter(now.cast("long") - F.col("written_at").cast("timestamp").cast("long") < ttl)
    more = ["error"] if "error" in cache.columns else []
    return texts.join(fresh.select("key", "vector", *more), "key", "left").withColumn("hit", F.col("vector").isNotNull())


def invalidate(cache: DataFrame, keys: DataFrame) -> DataFrame:
    """The cache without the rows of these (key)."""
    return cache.join(keys.select("key"), "key", "left_anti")


def flush(cache: DataFrame, prefix: str = "emb:") -> DataFrame:
    """The cache without any row whose key begins with the prefix."""
    return cache.filter(~F.col("key").startswith(prefix))


def readable(cache: DataFrame, dimensions: int) -> DataFrame:
    """The cache with broken entries (no vector, or one of another length) marked by `error`, as a lookup counts them."""
    bad = F.col("vector").isNull() | (F.size("vector") != dimensions)
    return cache.withColumn("error", bad).withColumn("vector", F.when(~bad, F.col("vector")))


def stats(planned: DataFrame) -> DataFrame:
    """hits, misses, misses once per key, and the hit rate. A broken entry is a miss; planned rows with a column `error`
    also give the number of errors."""
    errors = [F.sum(F.coalesce(F.col("error"), F.lit(False)).cast("int")).alias("errors")] if "error" in planned.columns else []
    rows = planned.agg(F.sum(F.col("hit").cast("int")).alias("hits"), F.sum((~F.col("hit")).cast("int")).alias("misses"), F.count_distinct(F.when(~F.col("hit"), F.col("key"))).alias("to_embed"), *errors)
    rate = F.round(F.col("hits") / F.greatest(F.col("hits") + F.col("misses"), F.lit(1)), 4)
    return rows.withColumn("hit_rate", rate).withColumn("hit_pct", F.round(100 * rate, 2))


def embed_through(planned: DataFrame, embedder: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """All rows with their vector, and the new cache rows (key, vector). Each missing key is embedded once."""
    missing = planned.filter(~F.col("hit")).select("key", "text").dropDuplicates(["key"])
    made = embedder(missing).select("key", "vector")
    rest = planned.filter(~F.col("hit")).drop("vector").join(made, "key")
    return planned.filter("hit").unionByName(rest), made


def expire(cache: DataFrame, now: Column, ttl: int = 86_400) -> DataFrame:
    return cache.filter(now.cast("long") - F.col("written_at").cast("timestamp").cast("long") < ttl)


def health(checks: DataFrame, core: list[str]) -> DataFrame:
    """(service, status): ok if every core service is there and ok, else degraded."""
    good = checks.filter((F.col("status") == "ok") & F.col("service").isin(core)).agg(F.count_distinct("service").alias("ok"))
    return good.select("ok", F.when(F.col("ok") == len(core), "ok").otherwise("degraded").alias("status"))
