"""Communities by modularity: local moving in rounds, refinement and aggregation, all as joins and sums.

A level's graph is two tables: nodes (u, k, c) with the strength k of a node and the community c it stands in, and links
(u, v, w) in both directions. Gains are kept as whole numbers, multiplied by the sum of all strengths, so that no result
hangs on the order of a sum.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import _checkpoint_dir, _cut, connected, dealt

Kept = Callable[[DataFrame], DataFrame]
#: Requests of a round that are put in order as one share of work.
MOVERS = 1 << 16


@contextmanager
def _tables(spark: SparkSession) -> Iterator[Kept]:
    """A function that writes a table to the shared folder and reads it back; within, as they are deleted in the end."""
    folder, numbers = f"{_checkpoint_dir(spark)}/communities-{uuid.uuid4().hex}", itertools.count()

    def kept(df: DataFrame) -> DataFrame:
        path = f"{folder}/{next(numbers)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield kept
    finally:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _exact(c: str) -> str:
    return f"CAST({c} AS DECIMAL(19, 0))"


def earlier(rows: DataFrame, side: str, name: str, kept: Kept, share: int, number: int) -> DataFrame:
    """rows (u, k, less, ...) with the sum of k of those that come before, by less and u, at the same `side`. More than `share`
    are dealt out by ranges of that order, so that a community's rows are no one task's; what lies before a range is added."""
    order, ahead = ["less", "u"], lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    before = lambda keys: F.coalesce(F.sum("k").over(ahead(Window.partitionBy(*keys).orderBy(*order))), F.lit(0))
    if number <= share:
        return rows.withColumn(name, before([side]))
    placed = kept(rows.repartitionByRange(-(-number // share), side, *order).withColumn("range", F.spark_partition_id()))
    sums = placed.groupBy(side, "range").agg(F.sum("k").alias("held"))
    sums = sums.select(side, "range", F.coalesce(F.sum("held").over(ahead(Window.partitionBy(side).orderBy("range"))), F.lit(0)).alias("held"))
    return placed.join(dealt(sums), [side, "range"]).withColumn(name, before([side, "range"]) + F.col("held")).drop("range", "held")


def moves(nodes: DataFrame, links: DataFrame, total: int, kept: Kept, single: bool = False, movers: int = MOVERS) -> DataFrame | None:
    """(u, target): the nodes that leave their communities in one round, which raises modularity by every one of them; None
    if no node gains by leaving.

    A node asks for the neighbouring community of the highest gain, the smallest of several. The strongest request that
    touches a community, as the one left or the one entered, makes it a giver or a taker; only requests from givers to
    takers stand. They are taken in order of gain and id, and a request must still gain if all that come before it at its
    two communities are granted: what they bring along in links could only add to it. So the strongest always passes, and
    however many enter a community, one round is enough for those that gain. With `single`, only nodes that are alone in
    their community ask. `movers`: see earlier().
    """
    scale = f"CAST({total} AS DECIMAL(19, 0))"
    strength = nodes.groupBy("c").agg(F.sum("k").alias("kc"), F.count("*").alias("members"))
    own = nodes.join(dealt(strength), "c").select("u", "k", F.col("c").alias("own"), F.col("kc").alias("k_own"), "members")
    asking = own.filter("members = 1") if single else own
    toward = links.join(dealt(nodes.select(F.col("u").alias("v"), "c")), "v").groupBy("u", "c").agg(F.sum("w").alias("w"))
    each = toward.join(dealt(asking), "u").join(dealt(strength.select("c", "kc")), "c")
    score = F.expr(f"{scale} * {_exact('w')} - {_exact('k')} * {_exact('kc')}")
    best = each.groupBy("u", "k", "own", "k_own").agg(
        F.min(F.when(F.col("c") != F.col("own"), F.struct((-score).alias("less"), F.col("c").alias("target"), F.col("w").alias("w"), F.col("kc").alias("kc")))).alias("best"),
        F.coalesce(F.max(F.when(F.col("c") == F.col("own"), F.col("w"))), F.lit(0)).alias("w_own"),
    )
    gain = f"{scale} * {_exact('best.w - w_own')} - {_exact('k')} * {_exact('best.kc - (k_own - k)')}"
    asked = best.filter("best is not null").withColumn("less", -F.expr(gain)).filter("less < 0").select("u", "k", "own", "k_own", "w_own", F.col("best.target").alias("target"), F.col("best.w").alias("w"), F.col("best.kc").alias("kc"), "less")
    # Read for the roles and the requests; the joins before it are done once.
    asked = kept(asked)
    number = asked.count()
    if not number:
        return None
    touched = asked.select(F.col("own").alias("c"), "less", "u", F.lit(True).alias("gives")).union(asked.select("target", "less", "u", F.lit(False)))
    role = touched.groupBy("c").agg(F.min(F.struct("less", "u", "gives")).alias("first")).select("c", "first.gives")
    left = asked.join(dealt(role.filter("gives").select(F.col("c").alias("own"))), "own", "left_semi").join(dealt(role.filter("not gives").select(F.col("c").alias("target"))), "target", "left_semi")
    left = earlier(earlier(left, "target", "entered", kept, movers, number), "own", "gone", kept, movers, number)
    sure = f"{scale} * {_exact('w - w_own')} - {_exact('k')} * {_exact('kc + entered - (k_own - k - gone)')} > 0"
    return left.filter(sure).select("u", "target")


def settle(nodes: DataFrame, links: DataFrame, total: int, kept: Kept, single: bool = False, rounds: int = 100, movers: int = MOVERS) -> DataFrame:
    """nodes after rounds of moves, until none gains; `rounds` bounds them, and what is reached then stands."""
    for _ in range(rounds):
        moved = moves(nodes, links, total, kept, single, movers)
        if moved is None:
            break
        nodes = kept(nodes.join(dealt(moved), "u", "left").select("u", "k", F.coalesce("target", "c").alias("c")))
    return nodes


def contributions(labels: DataFrame, links: DataFrame, total: int) -> DataFrame:
    """(community, q): what each community of (id, community) adds to modularity, times the square of `total`."""
    k = links.groupBy("u").agg(F.sum("w").alias("k")).withColumnRenamed("u", "id")
    strength = labels.join(dealt(k), "id").groupBy("community").agg(F.sum("k").alias("k"))
    ends = links.join(dealt(labels.select(F.col("id").alias("u"), "community")), "u").join(dealt(labels.select(F.col("id").alias("v"), F.col("community").alias("other"))), "v")
    inside = ends.filter("community = other").groupBy("community").agg(F.sum("w").alias("w"))
    q = f"CAST({total} AS DECIMAL(19, 0)) * {_exact('coalesce(w, 0)')} - {_exact('k')} * {_exact('k')}"
    return strength.join(dealt(inside), "community", "left").select("community", F.expr(q).alias("q"))


def undirected(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(u, v, w) in both directions, of weight 1: edges between two different entities, each pair once."""
    ids = entities.select("id").distinct()
    ends = edges.filter("src <> dst").select(F.col("src").alias("u"), F.col("dst").alias("v"))
    ends = ends.join(dealt(ids.withColumnRenamed("id", "u")), "u", "left_semi").join(dealt(ids.withColumnRenamed("id", "v")), "v", "left_semi").select("u", "v")
    return ends.union(ends.select("v", "u")).distinct().withColumn("w", F.lit(1).cast("long"))


def modularity(labels: DataFrame, links: DataFrame) -> float:
    """Modularity of (id, community) over the links (u, v, w); 0 where there is no link."""
    total = links.agg(F.sum("w")).first()[0] or 0
    return float(contributions(labels, links, total).agg(F.sum("q")).first()[0]) / total**2 if total else 0.0


def by_modularity(entities: DataFrame, edges: DataFrame, least: int = 2, rounds: int = 100, movers: int = MOVERS) -> DataFrame:
    """(id, community, size) of communities of `least` members or more, named by the smallest id: the graph is undirected
    and without weights, repeated edges count once, loops and edges with a missing or null end don't.

    On each level nodes move (see `moves`), the communities are refined by joining single nodes within them, and refined
    communities become the nodes of the next level, until nothing is joined. Ties go by id, so the result is the same each
    time. In the end a community that isn't connected is split into its parts, and a connected component whose
    communities are worth less than itself stays whole; so every community is connected, and modularity at least that of
    the components. No edges: every node is alone. A column named community or size is replaced.
    """
    spark = entities.sparkSession
    ids = entities.select("id").filter("id is not null").distinct()
    with _tables(spark) as kept:
        first = kept(undirected(ids, edges))
        total = first.agg(F.sum("w")).first()[0] or 0
        links, of = first, None
        nodes = kept(first.groupBy("u").agg(F.sum("w").alias("k")).withColumn("c", F.col("u")))
        while total:
            nodes = settle(nodes, links, total, kept, rounds=rounds, movers=movers)
            side = nodes.select("u", "c")
            within = kept(links.join(dealt(side), "u").join(dealt(side.select(F.col("u").alias("v"), F.col("c").alias("d"))), "v").filter("c = d").select("u", "v", "w"))
            fine = settle(nodes.select("u", "k", F.col("u").alias("c")), within, total, kept, single=True, rounds=rounds, movers=movers)
            joined = kept(nodes.join(dealt(fine.select("u", F.col("c").alias("r"))), "u"))
            if joined.filter("u <> r").isEmpty():
                break
            lead = joined.select("u", "r")
            of = kept(lead.withColumnRenamed("u", "id") if of is None else of.withColumnRenamed("r", "u").join(dealt(lead), "u").select("id", "r"))
            links = kept(links.join(dealt(lead), "u").join(dealt(lead.select(F.col("u").alias("v"), F.col("r").alias("s"))), "v").filter("r <> s").groupBy(F.col("r").alias("u"), F.col("s").alias("v")).agg(F.sum("w").alias("w")))
            # Refined communities lie within one community each, whose name must be a node's of the next level or any other's.
            nodes = kept(joined.groupBy(F.col("r").alias("u")).agg(F.sum("k").alias("k"), F.min("c").alias("c")))
        label = nodes.select("u", "c")
        label = label.withColumnsRenamed({"u": "id", "c": "community"}) if of is None else of.join(dealt(label.withColumnRenamed("u", "r")), "r").select("id", F.col("c").alias("community"))
        label = kept(label)
        inner = first.join(dealt(label.select(F.col("id").alias("u"), "community")), "u").join(dealt(label.select(F.col("id").alias("v"), F.col("community").alias("other"))), "v").filter("community = other")
        # connected() reads its links several times; the joins before it are done once.
        parts = connected(kept(inner.select(F.col("u").alias("a"), F.col("v").alias("b"))))
        whole = connected(first.select(F.col("u").alias("a"), F.col("v").alias("b"))).withColumnRenamed("component", "whole")
        label = kept(label.join(dealt(parts), "id", "left").select("id", F.coalesce("component", "id").alias("community")).join(dealt(whole), "id"))
        worth = contributions(label, first, total).join(dealt(label.select("community", "whole").distinct()), "community").groupBy("whole").agg(F.sum("q").alias("q"))
        alone = contributions(label.select("id", F.col("whole").alias("community")), first, total).select(F.col("community").alias("whole"), F.col("q").alias("one"))
        better = worth.join(dealt(alone), "whole").filter("one > q").select("whole", F.lit(True).alias("stays"))
        named = label.join(dealt(better), "whole", "left").select("id", F.expr("CASE WHEN stays THEN whole ELSE community END").alias("community"))
        every = ids.join(dealt(named), "id", "left").select("id", F.coalesce("community", "id").alias("community"))
        size = every.groupBy("community").agg(F.count("*").alias("size")).filter(F.col("size") >= least)
        return _cut(every.join(dealt(size), "community").select("id", "community", "size"))
