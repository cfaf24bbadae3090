"""Mixing sources to target weights: targets by weight and size, and documents that fill them to the word."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, partitions

#: Shares of a (source, size) by a hash of its documents, so that one with very many documents isn't one group.
BUCKETS = 1024


def subset(sizes: np.ndarray, counts: np.ndarray, budget: float, window: int = 1 << 16) -> np.ndarray:
    """How many documents of each size to take, so that their words come nearest to budget (the smaller of two as near).

    sizes are distinct and positive. Each size first gives its share, rounded down, of what is asked for; then larger sizes
    first, as many as fit, until less than `window` words are left. What is left is a bounded-knapsack problem: the sums up
    to twice the rest are marked size by size, each with how many of that size it took to get there, until the rest itself
    is marked. More than half of the words are asked for by naming those that stay away. So memory is a few numbers for
    each size and each word of twice the window; only where all that is left is longer than `window` and than the rest,
    there is nothing to solve, and one more document is taken if that is nearer.
    """
    total = int((sizes * counts).sum())
    if 2 * budget > total:
        return counts - subset(sizes, counts, total - budget, window) if budget < total else counts.copy()
    taken = np.array([int(c) * int(budget) // total for c in counts], np.int64) if total else np.zeros(len(sizes), np.int64)
    rest = budget - float((taken * sizes).sum())
    order = np.argsort(-sizes)
    for i in order:
        if rest < window:
            break
        more = min(int(counts[i] - taken[i]), int(rest // sizes[i]))
        taken[i] += more
        rest -= more * int(sizes[i])
    if rest < window:
        _fill(sizes, counts, taken, rest, order)
    elif (taken < counts).any():
        least = min((i for i in range(len(sizes)) if taken[i] < counts[i]), key=lambda i: sizes[i])
        taken[least] += sizes[least] - rest < rest
    return taken


def _fill(sizes: np.ndarray, counts: np.ndarray, taken: np.ndarray, rest: float, order: np.ndarray) -> None:
    """Add to taken what brings its sum nearest to rest."""
    top, aim = int(2 * rest), int(np.ceil(rest - 0.5))
    by, used = np.full(top + 1, -1, np.int64), np.zeros(top + 1, np.int64)
    reached = np.zeros(top + 1, bool)
    reached[0] = True
    for i in order:
        if reached[aim]:
            break
        size, left = int(sizes[i]), int(counts[i] - taken[i])
        if size > top or not left:
            continue
        lines = -(-(top + 1) // size)
        grid = np.zeros(lines * size, bool)
        grid[: top + 1] = reached
        line = np.arange(lines)[:, None]
        last = np.maximum.accumulate(np.where(grid.reshape(lines, size), line, -1), axis=0)
        steps = np.where(last < 0, 0, line - last).reshape(-1)[: top + 1]
        new = ~reached & (steps > 0) & (steps <= left)
        by[new], used[new] = i, steps[new]
        reached |= new
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - rest))])
    while at:
        i, k = int(by[at]), int(used[at])
        taken[i] += k
        at -= k * int(sizes[i])


def targets(sources: DataFrame, weights: tuple[int, ...], percent: int, most: int) -> DataFrame:
    """(key, source_size) with target: `percent` of all sizes, shared by weights that repeat in the order of keys; no source
    gets more than `most` times its size, what is left is shared among the others by weight until none is above.

    Sources are ranked over ranges of keys, so there may be many; each round of sharing sums three numbers.
    """
    spark, n = sources.sparkSession, partitions(sources.sparkSession)
    ranged = cut(sources.repartitionByRange(n, "key").withColumn("part", F.spark_partition_id()))
    before, at = [], 0
    for r in ranged.groupBy("part").count().orderBy("part").collect():
        before.append((r["part"], at))
        at += r["count"]
    if not before:
        return sources.withColumn("target", F.lit(0.0))
    place = F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1 + F.col("before")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    weighed = cut(ranged.join(spark.createDataFrame(before, "part int, before long"), "part").select("key", "source_size", weight.alias("weight"), (most * F.col("source_size")).alias("cap")))
    total = int(weighed.agg(F.sum("source_size")).first()[0] or 0)
    full, fair = -1, 0.0
    while True:
        # fair: words for each unit of weight; sources that would get more than their cap drop out, round by round.
        above = F.col("cap") < F.lit(fair) * F.col("weight")
        out, kept, held = weighed.agg(F.sum(above.cast("int")), F.sum(F.when(~above, F.col("weight"))), F.sum(F.when(above, F.col("cap")))).first()
        if out == full or not kept:
            break
        full, fair = out, (percent * total / 100 - int(held or 0)) / int(kept)
    return weighed.select("key", "source_size", F.least(F.col("cap").cast("double"), F.lit(fair) * F.col("weight")).alias("target") if kept else F.col("cap").cast("double").alias("target"))


def _plan(window: int) -> Callable:
    def run(rows):
        import pandas as pd

        size, count = rows["size"].to_numpy(np.int64), rows["c"].to_numpy(np.int64)
        whole, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
        base = int(target // whole) if whole else 0
        extra, some = np.zeros(len(rows), np.int64), size > 0
        if whole:
            extra[some] = subset(size[some], count[some], target - base * whole, window)
        return pd.DataFrame({"key": rows["key"], "size": size, "source_size": whole, "target": target, "base": base, "extra": extra})

    return run


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, most: int = 2, seed: int = 12, window: int = 1 << 16) -> DataFrame:
    """One row for each row of (doc_id, source, text): doc_id, source, size, source_size, target, copies, taken.

    size is the number of words; the mix takes `percent` of all words, see `targets` for what each source gives. All
    documents of a source are taken as often as its target holds it whole, and some once more: how many of each size is
    solved from the counts of its sizes (`subset`), and which ones goes by a seeded hash of doc_id and text: the documents of
    a size are dealt over BUCKETS by it, buckets are taken in order, and within the last one documents are. So reruns agree,
    and neither a large source nor a size that very many documents have comes into one task; what one task gets of a source
    is one row for each size.

    A null text has no words; a null source comes last in order and is one of its own; rows count one by one, repeated ones
    too; other columns don't matter. A source of no words has target 0. An empty table gives no rows.
    """
    # Sorts as sources do, null last, and is never null.
    key = F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), F.col("source").cast("string")))
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    slim = cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), key.alias("key"), size.alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("u")))
    slim = slim.withColumn("bucket", F.pmod("u", F.lit(BUCKETS)))
    cells = cut(slim.groupBy("key", "size", "bucket").agg(F.count("*").alias("c")))
    histogram = cells.groupBy("key", "size").agg(F.sum("c").alias("c"))
    aims = targets(cut(histogram.groupBy("key").agg(F.sum(F.col("size") * F.col("c")).alias("source_size"))), weights, percent, most)
    plan = histogram.join(aims, "key").groupBy("key").applyInPandas(_plan(window), "key string, size long, source_size long, target double, base int, extra long")
    before = F.coalesce(F.sum("c").over(Window.partitionBy("key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    picks = cells.join(plan, ["key", "size"]).withColumn("picked", F.greatest(F.lit(0), F.least(F.col("c"), F.col("extra") - before))).drop("c", "extra")
    place = F.row_number().over(Window.partitionBy("key", "size", "bucket").orderBy("u"))
    rows = slim.withColumn("place", place).join(picks, ["key", "size", "bucket"])
    copies = F.col("base") + (F.col("place") <= F.col("picked")).cast("int")
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
