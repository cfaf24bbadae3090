"""Knowledge graphs as two tables: entities (id, name, entity_type, ...) and edges (src, dst, relation_type, ...)."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import content_key

EXTRACTION = "struct<entities:array<struct<name:string,entity_type:string,description:string>>,relationships:array<struct<source:string,target:string,relation_type:string,description:string,weight:double>>>"


def extraction_prompt(text: Column, types: str = "PERSON, ORGANIZATION, LOCATION, CONCEPT", most_entities: int = 10, most_relations: int = 10) -> Column:
    ask = f"Name at most {most_entities} entities of the types {types} and at most {most_relations} relations between them in this text, as JSON with the keys entities and relationships.\n\n"
    return F.concat(F.lit(ask), text)


def extract(chunks: DataFrame, model: Callable[[Column], Column], **prompt: object) -> DataFrame:
    """(chunk_id, text) to entities and relationships: an injected model, a function of the prompt column, is asked about
    every chunk that isn't blank; a blank one has none."""
    said = chunks.select("chunk_id", F.when(F.trim(F.coalesce("text", F.lit(""))) != "", model(extraction_prompt(F.col("text"), **prompt))).alias("reply"))
    return parse_extractions(said)


def run_log(chunks: DataFrame, extracted: DataFrame | None = None, errors: DataFrame | None = None) -> DataFrame:
    """One row for each document and collection of (doc_id, collection, chunk_id): running until its extractions
    (chunk_id, entities, relationships) or errors (doc_id, error) are given, then complete with counts, or failed with
    the first 1000 characters of the error."""
    runs = chunks.groupBy("doc_id", "collection").agg(F.count("*").alias("chunk_count"))
    none = F.lit(None).cast("long")
    done = runs.select("doc_id", none.alias("entity_count"), none.alias("relationship_count")).limit(0)
    if extracted is not None:
        found = extracted.select("chunk_id", F.size("entities").alias("e"), F.size("relationships").alias("r"))
        done = chunks.join(found, "chunk_id").groupBy("doc_id").agg(F.sum("e").alias("entity_count"), F.sum("r").alias("relationship_count"))
    bad = runs.select("doc_id", F.lit("").alias("error")).limit(0) if errors is None else errors.groupBy("doc_id").agg(F.min(F.substring("error", 1, 1000)).alias("error"))
    rows = runs.join(done, "doc_id", "left").join(bad, "doc_id", "left")
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("entity_count").isNotNull(), "complete").otherwise("running")
    count = lambda c: F.when(status == "complete", F.col(c)).alias(c)
    return rows.select("doc_id", "collection", status.alias("status"), count("chunk_count"), count("entity_count"), count("relationship_count"), "error")


def list_entities(entities: DataFrame, collection: str, entity_type: str | None = None, limit: int = 100) -> DataFrame:
    """Entities of a collection, and of a type in any case, the first `limit` by id."""
    rows = entities.filter(F.col("collection") == collection)
    rows = rows if entity_type is None else rows.filter(F.col("entity_type") == entity_type.upper())
    return rows.orderBy("id").limit(limit)


def entities_by_name(entities: DataFrame, names: DataFrame, collection: str) -> DataFrame:
    """The entities of a collection whose normalised name is one of (name), trimmed and in any case."""
    asked = names.select(F.lower(F.trim("name")).alias("name_normalised")).distinct()
    return entities.filter(F.col("collection") == collection).join(asked, "name_normalised", "left_semi")


def _name(c: Column, default: str | None = None) -> Column:
    t = F.trim(c)
    return t if default is None else F.coalesce(F.when(F.upper(t) != "", F.upper(t)), F.lit(default))


def parse_extractions(replies: DataFrame) -> DataFrame:
    """(chunk_id, reply) with entities and relationships: code fences go, names are trimmed, types are in capitals
    (CONCEPT, RELATED_TO by default), weight is 1 by default; blank names and a reply that isn't JSON give nothing."""
    bare = F.regexp_replace(F.trim("reply"), r"^```[A-Za-z]*\s*|\s*```$", "")
    rows = replies.withColumn("x", F.from_json(bare, EXTRACTION))
    none = lambda kind: F.array().cast(kind)
    entity = F.transform(F.col("x.entities"), lambda e: F.struct(_name(e["name"]).alias("name"), _name(e["entity_type"], "CONCEPT").alias("entity_type"), e["description"].alias("description")))
    relation = F.transform(
        F.col("x.relationships"),
        lambda r: F.struct(_name(r["source"]).alias("source"), _name(r["target"]).alias("target"), _name(r["relation_type"], "RELATED_TO").alias("relation_type"), r["description"].alias("description"), F.coalesce(r["weight"], F.lit(1.0)).alias("weight")),
    )
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    return rows.select(
        "chunk_id",
        F.coalesce(F.filter(entity, lambda e: some(e["name"])), none("array<struct<name:string,entity_type:string,description:string>>")).alias("entities"),
        F.coalesce(F.filter(relation, lambda r: some(r["source"]) & some(r["target"])), none("array<struct<source:string,target:string,relation_type:string,description:string,weight:double>>")).alias("relationships"),
    )


def resolve_entities(mentions: DataFrame) -> DataFrame:
    """(name, entity_type, collection, description, doc_id, chunk_id, seq) to one row for each lower-cased name, type and
    collection; the first mention gives name, description and document, all give chunk_ids."""
    key = mentions.withColumn("name_normalised", F.lower(F.trim("name"))).withColumn("entity_type", F.upper("entity_type"))
    rows = key.groupBy("name_normalised", "entity_type", "collection").agg(
        F.min_by("name", "seq").alias("name"), F.min_by("description", "seq").alias("description"), F.min_by("doc_id", "seq").alias("doc_id"), F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids")
    )
    return rows.withColumn("id", content_key(F.col("name_normalised"), F.col("entity_type"), F.col("collection")))


def resolve_relationships(mentions: DataFrame) -> DataFrame:
    """(src, dst, relation_type, collection, seq, ...): the first of each source, target, type and collection."""
    rows = mentions.withColumn("relation_type", F.upper("relation_type"))
    order = Window.partitionBy("src", "dst", "relation_type", "collection").orderBy("seq")
    return rows.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n", "seq")


def link_mentions(parsed: DataFrame) -> DataFrame:
    """Relationships whose ends are named, in the same letters, among the entities of the same chunk."""
    e = parsed.select("chunk_id", F.explode("entities").alias("e")).select("chunk_id", F.col("e.name").alias("name"), F.col("e.entity_type").alias("entity_type")).dropDuplicates(["chunk_id", "name"])
    r = parsed.select("chunk_id", F.explode("relationships").alias("r")).select("chunk_id", "r.*")
    return r.join(e.select("chunk_id", F.col("name").alias("source"), F.col("entity_type").alias("source_type")), ["chunk_id", "source"]).join(
        e.select("chunk_id", F.col("name").alias("target"), F.col("entity_type").alias("target_type")), ["chunk_id", "target"]
    )


def list_relationships(edges: DataFrame, entities: DataFrame, node: Column | None = None) -> DataFrame:
    """Edges with the names of their ends (null where an end is missing); with `node`, those that touch it."""
    rows = edges if node is None else edges.filter((F.col("src") == node) | (F.col("dst") == node))
    names = entities.select("id", "name")
    return rows.join(names.withColumnsRenamed({"id": "src", "name": "source_name"}), "src", "left").join(names.withColumnsRenamed({"id": "dst", "name": "target_name"}), "dst", "left")


def stats(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of entities and relationships by type, as (kind, type, n)."""
    a = entities.groupBy(F.lit("entity").alias("kind"), F.col("entity_type").alias("type")).agg(F.count("*").alias("n"))
    return a.unionByName(edges.groupBy(F.lit("relationship").alias("kind"), F.col("relation_type").alias("type")).agg(F.count("*").alias("n")))


def build(entities: DataFrame, edges: DataFrame, multigraph: bool = False, last: str = "seq") -> DataFrame:
    """Edges with both ends present; unless multigraph, only the last of each ordered pair."""
    ids = entities.select("id")
    kept = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    if multigraph:
        return kept
    order = Window.partitionBy("src", "dst").orderBy(F.desc(last))
    return kept.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def neighbours(edges: DataFrame) -> DataFrame:
    """Each node's outgoing and incoming edges as (node, neighbour, direction, relation_type)."""
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("neighbour"), F.lit("out").alias("direction"), "relation_type")
    return out.unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("neighbour"), F.lit("in").alias("direction"), "relation_type"))


def entry_nodes(queries: DataFrame, entities: DataFrame, longest: int = 6, least: int = 1 << 16) -> DataFrame:
    """(query_id, id) of entities whose name stands in the text as whole words, in any case.

    Names and texts are cut into words, and runs of as many words as names have, up to `longest`, are joined by equality. A
    name of more words is joined by its first `longest`, and counts where the text then holds all of it. A run that very
    many texts hold is dealt over blocks, to which the names that begin so are copied; see hubs() for `least`.
    """
    tokens = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0))
    # Small tables have few splits, so both are dealt out; they are read several times, and taken apart once.
    t = _cut(queries.select("query_id", "text").repartition("query_id").select("query_id", tokens(F.col("text")).alias("t"))).filter(F.size("t") > 0)
    names = _cut(entities.select("id", "name").repartition("id").select("id", tokens(F.col("name")).alias("n"))).filter(F.size("n") > 0).withColumn("node", F.array_join(F.slice("n", 1, longest), " "))
    sizes = [r[0] for r in names.select(F.least(F.size("n"), F.lit(longest))).distinct().collect()]
    of = lambda n: F.when(F.size("t") >= n, F.transform(F.sequence(F.lit(0), F.size("t") - n), lambda i: F.array_join(F.slice("t", i + 1, n), " "))).otherwise(F.array().cast("array<string>"))
    met = t.select("query_id", F.explode(F.array_distinct(F.concat(F.array().cast("array<string>"), *[of(n) for n in sorted(sizes)]))).alias("node"))
    large = _frequent(met.select("node"), least)
    met, names = blocked(met, "query_id", large), at_blocks(names, large)
    short = met.join(names.filter(F.size("n") <= longest).select("id", "node", "block"), ["node", "block"]).select("query_id", "id")
    if longest not in sizes:
        return short.distinct()
    spaced = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    begun = met.join(names.filter(F.size("n") > longest), ["node", "block"]).select("query_id", "id", spaced(F.col("n")).alias("whole"))
    long = begun.join(t.select("query_id", spaced(F.col("t")).alias("held")), "query_id").filter(F.col("held").contains(F.col("whole"))).select("query_id", "id")
    return short.union(long).distinct()


def hubs(edges: DataFrame, least: int = 1 << 16) -> DataFrame | None:
    """(node, blocks) of nodes with more than `least` edges and more than a shuffle partition's share of all; None if there
    are none. There can't be more of them than shuffle partitions, so they are collected and joined by broadcast."""
    return _frequent(edges.select(F.col("src").alias("node")).unionAll(edges.select(F.col("dst").alias("node"))).filter("node IS NOT NULL"), least)


def _frequent(ends: DataFrame, least: int) -> DataFrame | None:
    """(node, blocks) of what stands in more than `least` rows, and more than a shuffle partition's share."""
    spark = ends.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = max(least, -(-ends.count() // parts))
    large = ends.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") > share).select("node", F.ceil(F.col("n") / share).cast("int").alias("blocks"))
    rows = large.collect()
    return spark.createDataFrame(rows, large.schema) if rows else None


def blocked(held: DataFrame, by: str, large: DataFrame | None) -> DataFrame:
    """held (node, ...) with a `block`: a hub's rows are dealt over its blocks by a hash of the column `by`."""
    if large is None:
        return held.withColumn("block", F.lit(0))
    return held.join(F.broadcast(large), "node", "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64(by), F.col("blocks")), F.lit(0)).cast("int")).drop("blocks")


def at_blocks(nodes: DataFrame, large: DataFrame | None) -> DataFrame:
    """nodes (node, ...) with a row for each block of their node."""
    if large is None:
        return nodes.withColumn("block", F.lit(0))
    some = nodes.join(F.broadcast(large), "node", "left")
    return some.withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")


def reach(entry: DataFrame, edges: DataFrame, depth: int = 2, least: int = 1 << 16) -> DataFrame:
    """(query_id, node, hop) of nodes within `depth` steps of the entry nodes, either way along the edges. The neighbours of a
    hub lie in blocks, and only what stands at a hub is copied to its blocks; see hubs() for `least`."""
    return _reach(entry, edges, depth, hubs(edges, least) if depth > 0 else None)


def _reach(entry: DataFrame, edges: DataFrame, depth: int, large: DataFrame | None) -> DataFrame:
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("to")).union(edges.select("dst", "src")).distinct()
    both = blocked(both, "to", large)
    seen = entry.select("query_id", F.col("id").alias("node")).distinct().withColumn("hop", F.lit(0))
    front = seen
    for hop in range(1, depth + 1):
        front = _step(front, both, seen, large).withColumn("hop", F.lit(hop))
        # The next step reads the front several times; the last one is only handed on.
        front = _cut(front) if hop < depth else front
        seen = seen.unionByName(front)
    return seen


def _step(front: DataFrame, both: DataFrame, seen: DataFrame, large: DataFrame | None, parts: int = 64) -> DataFrame:
    """(query_id, node): what the queries of the front come to next and haven't seen.

    Queries that stand at the same nodes are one class, found by two sums of hashes over their nodes, and a class takes the
    step once. What some of its queries have seen already is noted at the class's node, and the pairs of queries and nodes
    are made last, so they are never dealt out themselves. The nodes of a class are dealt over `parts` for that. Sizes that
    are estimated for queries and nodes fall short of their rows, so joins of these are merged, see dealt().
    """
    stand = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(20, 0)")).alias("a"), F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(20, 0)")).alias("b"))
    of = front.groupBy("query_id").agg(stand.alias("class"))
    lead = of.groupBy("class").agg(F.min("query_id").alias("lead"))
    of = _cut(of.join(dealt(lead), "class").select("query_id", "lead"))
    lead = of.select("lead").distinct()
    at = front.join(dealt(lead.select(F.col("lead").alias("query_id"))), "query_id", "left_semi").select(F.col("query_id").alias("lead"), "node")
    step = at_blocks(at, large).join(dealt(both), ["node", "block"]).select("lead", F.col("to").alias("node")).distinct()
    step = step.join(dealt(at), ["lead", "node"], "left_anti")
    but = seen.join(dealt(of), "query_id").groupBy("lead", "node").agg(F.collect_set("query_id").alias("but"))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts))
    marked = step.join(dealt(but), ["lead", "node"], "left").withColumn("part", part("node"))
    every = of.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return marked.join(dealt(every), ["lead", "part"]).filter("but is null or not array_contains(but, query_id)").select("query_id", "node")


def traverse(entry: DataFrame, edges: DataFrame, depth: int = 2, least: int = 1 << 16, first: int | None = None) -> DataFrame:
    """(query_id, chunk_id, hop): chunks of the edges that touch nodes up to `depth` steps away, at their nearest. Hubs are in
    blocks, as in reach().

    first: at least the first so many of each query by hop and chunk_id. A node then gives its own first ones only, as each of
    the others has as many before it.
    """
    large = hubs(edges, least)
    nodes = _reach(entry, edges, depth, large)
    ends = edges.select(F.col("src").alias("node"), "chunk_id").union(edges.select(F.col("dst").alias("node"), "chunk_id")).filter("chunk_id is not null").distinct()
    if first is None:
        met = at_blocks(nodes, large).join(blocked(ends, "chunk_id", large), ["node", "block"])
    else:
        some = blocked(ends, "chunk_id", large)
        for keys in (["node", "block"], ["node"]):
            some = some.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy("chunk_id"))).filter(F.col("_place") <= first)
        met = nodes.join(some.select("node", "chunk_id"), "node")
    return met.groupBy("query_id", "chunk_id").agg(F.min("hop").alias("hop"))


def dealt(df: DataFrame) -> DataFrame:
    """df as a side of a join that is dealt out to the tasks and merged: where each of many rounds joins tables that grow with
    the graph, broadcasts would bring all of them to the driver."""
    return df.hint("merge")


def connected(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(id, component) for each end of the links (a, b); component is the smallest id reachable.

    In each round every component that has a neighbour is hooked to its smallest one; of two that are hooked to each other
    the smaller is a root, and no longer cycles can arise. Jumps lead all to their roots, and links are contracted to
    links of roots. So each round at least halves the components, and it goes on until no link is left. More than
    `rounds` of either kind can't be needed; an error, never an unsettled result, is what exceeding them gives.
    """
    spark = links.sparkSession
    folder, tables = f"{_checkpoint_dir(spark)}/components-{uuid.uuid4().hex}", itertools.count()

    def kept(df: DataFrame, rows: int | None = None) -> DataFrame:
        # A checkpoint would keep the product of its sides as a join's size, which squares from join to join. What is left
        # of the links shrinks from round to round, and the number of tasks with it.
        path = f"{folder}/{next(tables)}"
        (df if rows is None else df.coalesce(max(1, -(-rows // 100_000)))).write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        ends = links.filter("a <> b").select("a", "b")
        both = kept(ends.union(ends.select("b", "a")).distinct(), 2 * ends.count())
        levels: list[DataFrame] = []
        while n := both.count():
            if len(levels) == rounds:
                raise RuntimeError(f"components have not settled in {rounds} rounds")
            near = both.groupBy("a").agg(F.min("b").alias("p")).withColumnRenamed("a", "id")
            back = near.select(F.col("id").alias("p"), F.col("p").alias("pp"))
            first = (F.col("pp") == F.col("id")) & (F.col("id") < F.col("p"))
            root = kept(near.join(dealt(back), "p").select("id", F.when(first, F.col("id")).otherwise(F.col("p")).alias("p")), n)
            for _ in range(rounds):
                up = root.select(F.col("id").alias("p"), F.col("p").alias("pp"))
                new = kept(root.join(dealt(up), "p").select("id", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved")), n)
                root = new.select("id", "p")
                if new.filter("moved").isEmpty():
                    break
            else:
                raise RuntimeError(f"roots have not settled in {rounds} jumps")
            levels.append(root)
            a, b = root.select(F.col("id").alias("a"), F.col("p").alias("ra")), root.select(F.col("id").alias("b"), F.col("p").alias("rb"))
            both = kept(both.join(dealt(a), "a").join(dealt(b), "b").filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), n)
        if not levels:
            return _cut(both.select(F.col("a").alias("id"), F.col("b").alias("component")))
        label = levels.pop()
        while levels:
            upper = label.select(F.col("id").alias("p"), F.col("p").alias("pp"))
            label = kept(levels.pop().join(dealt(upper), "p", "left").select("id", F.coalesce("pp", "p").alias("p")))
        least = label.groupBy("p").agg(F.min("id").alias("component"))
        return _cut(label.join(dealt(least), "p").select("id", "component"))
    finally:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def extended(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component) after a batch of links (a, b), from those before it: no earlier link is read.

    The batch's ends are looked up, and the components that it joins are contracted to single nodes, so the rounds run over
    no more than the batch. Labels are the smallest ids, of old and new ones together; an end that is new starts as its own.
    A link with a null end doesn't count, nor does a loop, except that its id is there from then on. Empty labels give
    `connected`, an empty batch the labels as they were.
    """
    some = links.filter("a is not null and b is not null").select("a", "b")
    ends = some.select(F.col("a").alias("id")).union(some.select("b")).distinct()
    found = _cut(ends.join(labels.select("id", "component"), "id", "left"))
    touched = found.select("id", F.coalesce("component", "id").alias("component"))
    sides = some.join(touched.withColumnsRenamed({"id": "a", "component": "of_a"}), "a").join(touched.withColumnsRenamed({"id": "b", "component": "of_b"}), "b")
    lead = connected(sides.filter("of_a <> of_b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).distinct()).select(F.col("id").alias("component"), F.col("component").alias("lead"))
    every = labels.select("id", "component").unionByName(found.filter("component is null").select("id", F.col("id").alias("component")))
    return _cut(every.join(lead, "component", "left").select("id", F.coalesce("lead", "component").alias("component")))


def components(entities: DataFrame, edges: DataFrame, least: int = 2, rounds: int = 100) -> DataFrame:
    """(id, community) by weakly connected components of `least` members or more, named by the smallest id.

    Rounds grow with the logarithm of the number of nodes, see `connected`; each is cut by a reliable checkpoint where a
    folder is set. Edges with an end that isn't among the entities don't count.
    """
    ids = entities.select("id")
    links = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    links = links.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    # connected() reads its links several times; they are looked up once.
    label = ids.join(connected(_cut(links), rounds=rounds), "id", "left").select("id", F.coalesce("component", "id").alias("community"))
    size = label.groupBy("community").agg(F.count("*").alias("size")).filter(F.col("size") >= least)
    return label.join(size, "community").select("id", "community", "size")


def communities(members: DataFrame, entities: DataFrame, names: int = 20, parts: int = 64) -> DataFrame:
    """One row per community with its size and up to `names` member names in order. Each of `parts` shares of a community
    keeps its first names, so none is gathered whole."""
    each = members.join(entities.select("id", "name"), "id").select("community", "size", "name").distinct().withColumn("part", F.pmod(F.xxhash64("name"), F.lit(parts)))
    few = each
    for keys in (["community", "part"], ["community"]):
        few = few.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("name"))).filter(F.col("place") <= names)
    return few.groupBy("community").agg(F.first("size").alias("size"), F.array_sort(F.collect_list("name")).alias("names"))


def _checkpoint_dir(spark: SparkSession) -> str:
    import tempfile

    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-textloom-", dir="/tmp"))
    return context._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for tables in the shared place."""
    return f"{_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _cut(df: DataFrame) -> DataFrame:
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def share(k: int, weight: float, multiplier: int = 3) -> int:
    """How many results of a side of that weight are merged."""
    return max(1, round(k * weight * multiplier))


def retrieve(dense: DataFrame, found: DataFrame, k: int = 5, weight: float = 0.5, multiplier: int = 3, mode: str = "hybrid", interleave: bool = False) -> DataFrame:
    """Dense results (query_id, chunk_id, rank) and traversed chunks (query_id, chunk_id, hop) as one ranking: dense ones
    first and then what the graph adds, or by turns with interleave; each side is cut to its share first."""
    if mode not in ("classical", "graph", "hybrid") or not 0 <= weight <= 1:
        raise ValueError("mode must be classical, graph or hybrid, and weight from 0 to 1")
    order = Window.partitionBy("query_id").orderBy("hop", "chunk_id")
    graph = found.withColumn("place", F.row_number().over(order)).select("query_id", "chunk_id", "place", F.lit(1).alias("side"))
    classical = dense.select("query_id", "chunk_id", F.col("rank").alias("place"), F.lit(0).alias("side"))
    n_dense, n_graph = share(k, 1 - weight, multiplier), share(k, weight, multiplier)
    parts = {"classical": classical, "graph": graph, "hybrid": classical.filter(F.col("place") <= n_dense).unionByName(graph.filter(F.col("place") <= n_graph))}[mode]
    sort = ["place", "side"] if interleave else ["side", "place"]
    one = parts.groupBy("query_id", "chunk_id").agg(F.min(F.struct(*sort)).alias("s")).select("query_id", "chunk_id", "s.*")
    w = Window.partitionBy("query_id").orderBy(*sort, "chunk_id")
    return one.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "chunk_id", "side", "rank")


def graph_retrieve(queries: DataFrame, classical: DataFrame, texts: DataFrame, entities: DataFrame, edges: DataFrame, k: int = 5, depth: int = 2, weight: float = 0.5, multiplier: int = 3, mode: str = "hybrid") -> DataFrame:
    """Graph retrieval as one call: (query_id, query), classical results (query_id, chunk_id, rank), and (chunk_id, text).

    Traversal starts at entities that the query names, in hybrid mode also at those that the texts of its classical results
    name. The results of both sides are merged as in retrieve(), the first k of each query stay.
    """
    asked = queries.select("query_id", F.col("query").alias("text"))
    if mode == "hybrid":
        most = share(k, 1 - weight, multiplier)
        asked = asked.unionByName(classical.filter(F.col("rank") <= most).join(texts.select("chunk_id", "text"), "chunk_id").select("query_id", "text"))
    found = traverse(entry_nodes(asked, entities), edges, depth, first=max(k, share(k, weight, multiplier)))
    return retrieve(classical, found, k, weight, multiplier, mode)
