"""Queries of the catalogue over what is kept between runs: collections, tables, caches, statuses, runs of extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources
from .. import streaming as ingest
from ..operators import answers, caching, graph, quality, retrieval
from ..operators.graph import new_folder
from ..sources import stores
from .queries import BM25, COSINE, FIXED, NODES, ON_CHUNKS, ORACLES, QUALITY, SIGNIFICANT, TERMS, _contexts, _edges, _entities, _passages, _questions, _vectors, healed, plain_chunks, read, register

# ---- vector collections and stored tables ----


@register("""SELECT 'label-' || label AS name, 64::INT AS dimensions, 'cosine' AS distance, count(*) AS vectors, false AS made_again FROM embeddings WHERE label < 2 GROUP BY label""")
def collection_lifecycle(spark, sf_dir):
    root, found = new_folder(spark, "collections"), None
    for label in ("0", "1", "2"):
        rows = _vectors(spark, sf_dir).filter(F.col("label") == label)
        stores.ensure_collection(spark, root, f"label-{label}", 64)
        again = stores.ensure_collection(spark, root, f"label-{label}", 64)
        stores.put_vectors(rows, root, f"label-{label}")
        stores.put_vectors(rows.filter("chunk_id % 2 = 0"), root, f"label-{label}")
        if label == "2":
            stores.delete_collection(spark, root, "label-2")
        else:
            one = stores.collection_info(spark, root, f"label-{label}").withColumn("made_again", F.lit(again))
            found = one if found is None else found.unionByName(one)
    return found


@register("SELECT vec_id AS chunk_id, CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE label::VARCHAR END AS label FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 3 = 0")
def vector_upsert(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return retrieval.upsert(v.filter("chunk_id % 2 = 0"), v.filter("chunk_id % 3 = 0").withColumn("label", F.lit("new")), dimensions=64).select("chunk_id", "label")


@register(f"WITH src AS (SELECT doc_id, text FROM documents), {FIXED} SELECT lang AS collection, count(*) AS chunks, count(DISTINCT doc_id) AS docs, max(length(substr(chunks.text, 1, 500)))::INT AS preview FROM chunks JOIN documents USING (doc_id) GROUP BY 1")
def stored_chunks(spark, sf_dir):
    """Written twice; the second run adds nothing."""
    path = new_folder(spark, "chunks")
    chunks = plain_chunks(spark, sf_dir).join(read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("collection")), "doc_id")
    sources.write_chunks(chunks, path)
    sources.write_chunks(chunks, path)
    return spark.read.parquet(path).groupBy("collection").agg(F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("docs"), F.max(F.length("text_preview")).alias("preview"))


@register("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'indexed' ELSE 'pending' END AS status FROM documents")
def stored_documents(spark, sf_dir):
    path = new_folder(spark, "documents")
    rows = read(spark, sf_dir, "documents").select("doc_id", F.lit("pending").alias("status"))
    sources.write_documents(rows, path)
    for _ in range(2):
        sources.write_documents(rows.filter("doc_id % 2 = 0").withColumn("status", F.lit("indexed")), path)
    return stores.read_latest(spark, path)


def index_documents(docs: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chunks of (doc_id, text) that pass the quality gate, and a row for each document: complete with its number of
    chunks, or failed, since it has no chunks or all were excluded."""
    good = quality.gate(quality.score(chunks))
    made = chunks.groupBy("doc_id").agg(F.count("*").alias("made"))
    left = good.groupBy("doc_id").agg(F.count("*").alias("indexed"))
    rows = docs.select("doc_id").join(made, "doc_id", "left").join(left, "doc_id", "left").fillna(0, ["made", "indexed"])
    error = F.when(F.col("made") == 0, "no chunks").when(F.col("indexed") == 0, "all chunks excluded")
    return good, rows.select("doc_id", F.when(error.isNull(), "complete").otherwise("failed").alias("status"), "indexed", error.alias("error"))


@register(f"""{ON_CHUNKS}, k AS (SELECT doc_id, count(*) AS made, count(*) FILTER (quality_score >= 0.4) AS good FROM scored GROUP BY 1)
  SELECT d.doc_id, CASE WHEN coalesce(good, 0) > 0 THEN 'complete' ELSE 'failed' END AS status, coalesce(good, 0) AS indexed, CASE WHEN made IS NULL THEN 'no chunks' WHEN good = 0 THEN 'all chunks excluded' END AS error FROM documents d LEFT JOIN k USING (doc_id)""")
def document_status(spark, sf_dir):
    return index_documents(read(spark, sf_dir, "documents"), plain_chunks(spark, sf_dir))[1]


# ---- ingestion ----


def _events(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("idempotency_key"), F.col("event_type").alias("status"), F.col("event_id").alias("batch"))


@register("SELECT u::VARCHAR AS idempotency_key, status, batch FROM range(0, 40) t(u) LEFT JOIN (SELECT user_id, arg_max(event_type, event_id) AS status, max(event_id) AS batch FROM events GROUP BY 1) e ON e.user_id = u")
def ingest_status(spark, sf_dir):
    return ingest.latest_status(_events(spark, sf_dir), spark.range(40).select(F.col("id").cast("string").alias("idempotency_key")))


@register("""SELECT event_id::VARCHAR AS idempotency_key, CASE WHEN event_id % 5 = 0 THEN 'skipped' WHEN event_type = 'error' THEN 'dead_letter' ELSE 'complete' END AS status, CAST(CASE WHEN event_id % 5 = 0 THEN 0 WHEN event_type = 'error' THEN 4 ELSE 1 END AS INT) AS attempts FROM events""")
def consume_completed(spark, sf_dir):
    sent = read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("idempotency_key"), "event_id", "event_type", F.lit("pending").alias("status"))
    return ingest.consume(sent, sent.filter("event_id % 5 = 0"), F.col("event_type") == "error")


@register("""SELECT event_id::VARCHAR AS idempotency_key, CASE WHEN event_type = 'error' AND event_id % 7 = 0 THEN 'dead_letter' ELSE 'complete' END AS status,
  CAST(CASE WHEN event_type <> 'error' THEN 1 WHEN event_id % 7 = 0 THEN 4 ELSE 1 + event_id % 4 END AS INT) AS attempts, CASE WHEN event_type = 'error' AND event_id % 7 = 0 THEN 'no answer in attempt 3' END AS error FROM events""")
def retry_process(spark, sf_dir):
    """The work itself is run again on what failed."""
    sent = read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("idempotency_key"), "event_id", "event_type")

    def work(given: DataFrame) -> DataFrame:
        bad = (F.col("event_type") == "error") & ((F.col("event_id") % 7 == 0) | (F.col("attempt") < F.col("event_id") % 4))
        return given.withColumn("error", F.when(bad, F.concat(F.lit("no answer in attempt "), F.col("attempt"))))

    return ingest.retried(sent, work)[1]


@register("""SELECT event_id::VARCHAR AS idempotency_key, CASE WHEN event_id IN (3, 500) THEN 'dead_letter' ELSE 'complete' END AS status, CASE WHEN event_id IN (3, 500) THEN 4 ELSE 2 END::INT AS attempts FROM events""")
def retry_poison(spark, sf_dir):
    """Two messages on which the work as a whole breaks off; the others come through in the second attempt, which sets them apart."""
    sent = read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("idempotency_key"), "event_id", "value")

    def work(given: DataFrame) -> DataFrame:
        return given.withColumn("value", F.when(F.col("event_id").isin(3, 500), F.raise_error(F.lit("can't be read")).cast("double")).otherwise(F.col("value")))

    return ingest.retried(sent, work)[1].drop("error")


# ---- caches ----

NOW = "TIMESTAMP '2024-01-31 00:00:00'"


def _cache(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select(F.concat(F.when(F.col("user_id") % 2 == 0, "emb:").otherwise("old:"), F.col("event_id")).alias("key"), F.when(F.col("event_id") % 11 != 0, F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>")).alias("vector"), F.col("ts").alias("written_at"), "event_id", "user_id")


@register(f"SELECT event_id FROM events WHERE epoch({NOW}) - floor(epoch(ts)) < 86400")
def cache_expiry(spark, sf_dir):
    return caching.expire(_cache(spark, sf_dir), F.lit("2024-01-31 00:00:00").cast("timestamp")).select("event_id")


@register("SELECT event_id FROM events WHERE user_id % 2 <> 0 AND event_id % 3 <> 0")
def cache_invalidate(spark, sf_dir):
    cache = _cache(spark, sf_dir)
    return caching.flush(caching.invalidate(cache, cache.filter("event_id % 3 = 0"))).select("event_id")


@register("""SELECT count(*) FILTER (event_id % 11 <> 0) AS hits, count(*) FILTER (event_id % 11 = 0) AS misses, count(*) FILTER (event_id % 11 = 0) AS to_embed, count(*) FILTER (event_id % 11 = 0) AS errors, round(count(*) FILTER (event_id % 11 <> 0) / count(*)::DOUBLE, 4) AS hit_rate, round(100 * round(count(*) FILTER (event_id % 11 <> 0) / count(*)::DOUBLE, 4), 2) AS hit_pct FROM events""")
def cache_errors(spark, sf_dir):
    cache = caching.readable(_cache(spark, sf_dir), 2)
    return caching.stats(caching.plan(cache.select("key", "event_id"), cache.select("key", "vector", "error")))


HASHED = rf"list_transform({TERMS.format('text')}, lambda t: ('0x' || substr(md5(t), 1, 2))::INT % 64)"
EMBEDDED = f"h AS (SELECT id, {HASHED} AS h FROM src), v AS (SELECT id, list_transform(range(0, 64), lambda i: len(list_filter(h, lambda x: x = i))::DOUBLE) AS v FROM h)"


@register(f"WITH src AS (SELECT doc_id AS id, text FROM documents), {EMBEDDED} SELECT id AS doc_id, CASE WHEN lang = 'en' THEN 1.0 ELSE list_dot_product(v, v) END::DOUBLE AS square FROM v JOIN documents ON id = doc_id")
def embed_batch(spark, sf_dir):
    """English texts have a cached vector of one 1, the others go through the embedder, each distinct text once."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text", F.concat_ws(":", "lang", F.md5("text")).alias("key"))
    cached = docs.filter("lang = 'en'").dropDuplicates(["key"]).select("key", F.array(F.lit(1.0)).cast("array<float>").alias("vector"))
    rows, _ = caching.embed_through(caching.plan(docs.drop("lang"), cached), retrieval.embed)
    return rows.select("doc_id", F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")).alias("square"))


# ---- fusion of two legs ----

BOTH = f"""src AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT -1 - item_id, text FROM benchmark), {EMBEDDED},
  s AS (SELECT -1 - q.id AS query_id, d.id AS chunk_id, CASE WHEN list_dot_product(q.v, q.v) = 0 OR list_dot_product(d.v, d.v) = 0 THEN 0 ELSE round(list_dot_product(q.v, d.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(d.v, d.v))), 9) END AS score FROM v q, v d WHERE q.id < 0 AND d.id >= 0),
  dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s)"""


def _legs(spark, sf_dir):
    chunks = _passages(spark, sf_dir)
    index = retrieval.embed(chunks.select("chunk_id", "text"))
    questions = _questions(spark, sf_dir)
    asked = retrieval.embed(questions, text="query").select("query_id", "query", F.col("vector").alias("q_vector"))
    return asked, chunks, index


def _bm25_sql():
    from .queries import BM25

    return BM25


@register(f"""WITH {_bm25_sql()}, {BOTH.replace('s AS (', 'ds AS (').replace('FROM s)', 'FROM ds)')},
  f AS (SELECT query_id, chunk_id, round(sum(p), 9) AS score FROM (SELECT query_id, chunk_id, 0.5 / (60 + rank) AS p FROM ranked WHERE rank <= 20 UNION ALL SELECT query_id, chunk_id, 0.5 / (60 + rank) FROM dense WHERE rank <= 20) GROUP BY ALL),
  fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM f) SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM fr WHERE rank <= 5""")
def hybrid_dense_bm25(spark, sf_dir):
    """A dense leg over a stand-in embedding of all texts, and a lexical leg; either can bring a chunk alone."""
    asked, chunks, index = _legs(spark, sf_dir)
    return retrieval.hybrid(asked, chunks, index, 5)


@register(f"""WITH {_bm25_sql()}, {BOTH.replace('s AS (', 'ds AS (').replace('FROM s)', 'FROM ds)')},
  r AS (SELECT query_id, 'bm25' AS strategy, count(*) AS results FROM ranked WHERE rank <= 10 GROUP BY 1 UNION ALL SELECT query_id, 'dense', count(*) FROM dense WHERE rank <= 5 GROUP BY 1)
  SELECT *, results = max(results) OVER (PARTITION BY query_id) AS most, strategy = 'dense' AS fastest FROM r""")
def strategy_summary(spark, sf_dir):
    asked, chunks, index = _legs(spark, sf_dir)
    return retrieval.summary({"bm25": retrieval.bm25(asked, chunks, 10), "dense": retrieval.dense(asked, index, 5)}, {"bm25": 2.0, "dense": 1.0})


# ---- knowledge graph ----


@register("SELECT conv_id * 1000 + turn AS chunk_id, md5('Name at most 3 entities of the types 100% SURE, B and at most 2 relations between them in this text, as JSON with the keys entities and relationships.' || chr(10) || chr(10) || text) AS digest FROM conversations")
def extraction_prompts(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), F.md5(graph.extraction_prompt(F.col("text"), "100% SURE, B", 3, 2)).alias("digest"))


def _asked_customers(spark, sf_dir):
    blank = F.col("c_custkey") % 5 == 0
    return read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("chunk_id"), F.col("c_nationkey").alias("doc_id"), F.lit("main").alias("collection"), F.when(blank, "  ").otherwise(F.col("c_name")).alias("text"))


def _model(prompt):
    """A stand-in for a language model: the text's last line is an entity that is part of another."""
    name = F.element_at(F.split(prompt, "\n"), -1)
    return F.concat(F.lit('{"entities": [{"name": "'), name, F.lit('"}, {"name": "Trade"}], "relationships": [{"source": "'), name, F.lit('", "target": "Trade", "relation_type": "part_of"}, {"source": "Trade", "target": "nothing"}]}'))


@register("SELECT 'c' || c_custkey AS chunk_id, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 2 END::INT AS entities, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 2 END::INT AS relationships, CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS entity FROM customer")
def extract_chunks(spark, sf_dir):
    rows = graph.extract(_asked_customers(spark, sf_dir), _model)
    return rows.select("chunk_id", F.size("entities").alias("entities"), F.size("relationships").alias("relationships"), F.try_element_at("entities", F.lit(1))["name"].alias("entity"))


@register("SELECT 'c' || c_custkey AS chunk_id, c_name AS source, 'Trade' AS target, 'PART_OF' AS relation_type, 'CONCEPT' AS source_type FROM customer WHERE c_custkey % 5 <> 0")
def graph_mention_links(spark, sf_dir):
    return graph.link_mentions(graph.extract(_asked_customers(spark, sf_dir), _model)).select("chunk_id", "source", "target", "relation_type", "source_type")


@register("""WITH d AS (SELECT c_nationkey AS doc_id, count(*) AS n, count(*) FILTER (c_custkey % 5 <> 0) AS k FROM customer GROUP BY 1)
  SELECT doc_id, 'main' AS collection, CASE WHEN doc_id % 4 = 0 THEN 'failed' WHEN doc_id % 4 = 1 THEN 'running' ELSE 'complete' END AS status, CASE WHEN doc_id % 4 > 1 THEN n END AS chunk_count,
  CASE WHEN doc_id % 4 > 1 THEN 2 * k END AS entity_count, CASE WHEN doc_id % 4 > 1 THEN 2 * k END AS relationship_count, CASE WHEN doc_id % 4 = 0 THEN repeat('x', 1000) END AS error FROM d""")
def extraction_runs(spark, sf_dir):
    chunks = _asked_customers(spark, sf_dir)
    done = graph.extract(chunks.filter("doc_id % 4 <> 1"), _model)
    errors = chunks.filter("doc_id % 4 = 0").select("doc_id", F.repeat(F.lit("x"), 3000).alias("error"))
    return graph.run_log(chunks, done, errors)


def _resolved(spark, sf_dir):
    rows = _entities(spark, sf_dir).select("name", "entity_type", F.lit("main").alias("collection"), F.lit(None).cast("string").alias("description"), F.lit("d").alias("doc_id"), F.lit("c").alias("chunk_id"), F.lit(1).alias("seq"))
    return graph.resolve_entities(rows)


@register(f"WITH {NODES}, k AS (SELECT sha256(lower(trim(name)) || '|' || entity_type || '|main') AS id, name FROM ent WHERE entity_type = 'CUSTOMER') SELECT id, name FROM k ORDER BY id LIMIT 100")
def graph_entity_listing(spark, sf_dir):
    return graph.list_entities(_resolved(spark, sf_dir), "main", "customer").select("id", "name")


@register("SELECT n_name AS name, 'NATION' AS entity_type FROM nation")
def graph_entity_lookup(spark, sf_dir):
    asked = read(spark, sf_dir, "nation").select(F.concat(F.lit("  "), F.lower("n_name"), F.lit(" ")).alias("name"))
    return graph.entities_by_name(_resolved(spark, sf_dir), asked, "main").select("name", "entity_type")


@register("SELECT 'c' || o_custkey AS src, o_orderstatus AS dst, 'PLACED' AS relation_type, arg_min(o_orderpriority, o_orderkey) AS description FROM orders GROUP BY 1, 2")
def graph_relationship_upsert(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey")).alias("src"), F.col("o_orderstatus").alias("dst"), F.when(F.col("o_orderkey") % 2 == 0, "placed").otherwise("Placed").alias("relation_type"), F.lit("main").alias("collection"), F.col("o_orderpriority").alias("description"), F.col("o_orderkey").alias("seq"))
    return graph.resolve_relationships(rows).select("src", "dst", "relation_type", "description")


@register(f"""WITH {NODES}, q AS (SELECT n_nationkey AS query_id, n_regionkey FROM nation),
  cl AS (SELECT s_nationkey AS query_id, 'supplier-' || s_suppkey AS chunk_id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rank FROM supplier),
  dense AS (SELECT * FROM cl WHERE rank <= 2),
  entry AS (SELECT query_id, 'n' || query_id AS node FROM q UNION SELECT query_id, 's' || substr(chunk_id, 10) FROM dense),
  both_ways AS (SELECT src, dst FROM edge UNION SELECT dst, src FROM edge),
  one AS (SELECT query_id, node, 0 AS hop FROM entry UNION ALL SELECT query_id, dst, 1 FROM entry JOIN both_ways ON src = node),
  nodes AS (SELECT query_id, node, min(hop) AS hop FROM one GROUP BY 1, 2),
  named AS (SELECT src, dst, CASE relation_type WHEN 'PART_OF' THEN 'nation-' ELSE CASE WHEN src LIKE 's%' THEN 'supplier-' ELSE 'customer-' END END || seq AS chunk_id FROM edge),
  found AS (SELECT query_id, chunk_id, min(hop) AS hop FROM nodes JOIN (SELECT src AS n, chunk_id FROM named UNION ALL SELECT dst, chunk_id FROM named) e ON e.n = node GROUP BY 1, 2),
  g AS (SELECT query_id, chunk_id, 1 AS side, row_number() OVER (PARTITION BY query_id ORDER BY hop, chunk_id) AS place FROM found),
  u AS (SELECT query_id, chunk_id, 0 AS side, rank AS place FROM dense UNION ALL SELECT query_id, chunk_id, side, place FROM g WHERE place <= 8),
  m AS (SELECT query_id, chunk_id, min(side) AS side, arg_min(place, side * 1000 + place) AS place FROM u GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY side, place, chunk_id) AS rank FROM m)
  SELECT query_id, chunk_id, CAST(side AS INT) AS side, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""")
def graph_hybrid_retrieve(spark, sf_dir):
    """Questions that name a nation, with the texts of two of its suppliers as classical results."""
    from pyspark.sql import Window

    nation, supplier = read(spark, sf_dir, "nation"), read(spark, sf_dir, "supplier")
    questions = nation.select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit("Trade of "), F.initcap("n_name"), F.lit("?")).alias("query"))
    order = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    classical = supplier.select(F.col("s_nationkey").alias("query_id"), F.concat(F.lit("supplier-"), F.col("s_suppkey")).alias("chunk_id"), F.row_number().over(order).alias("rank")).filter("rank <= 2")
    texts = supplier.select(F.concat(F.lit("supplier-"), F.col("s_suppkey")).alias("chunk_id"), F.concat(F.lit("We are "), F.col("s_name"), F.lit(", a firm.")).alias("text"))
    return graph.graph_retrieve(questions, classical, texts, _entities(spark, sf_dir), _edges(spark, sf_dir), 5, 1)


# ---- gates ----


# What the gates say of each question: the worst passage of its first three, its healed search, and how far those passages bear
# out an answer, for which the question's own text stands in.
GATES = f"""WITH top AS (SELECT * FROM (WITH {BM25} SELECT query_id, chunk_id FROM ranked WHERE rank <= 3) x),
  good AS (SELECT * FROM (WITH chunks AS (SELECT doc_id, text FROM documents), {QUALITY} SELECT doc_id, quality_score FROM scored) x),
  worst AS (SELECT query_id, min(quality_score)::DOUBLE AS score FROM top JOIN good ON doc_id = chunk_id GROUP BY 1),
  healed AS (SELECT * FROM ({ORACLES["retrieval_heal"]}) x),
  ctx AS (SELECT query_id, list_distinct(flatten(list({SIGNIFICANT.format('d.text')}))) AS ctx FROM top JOIN documents d ON d.doc_id = chunk_id GROUP BY 1),
  s AS (SELECT item_id, unnest(list_filter(list_transform(regexp_split_to_array(regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 10)) AS sentence FROM benchmark),
  g AS (SELECT item_id, len({SIGNIFICANT.format('sentence')}) AS words, len(list_intersect({SIGNIFICANT.format('sentence')}, coalesce(ctx, []))) AS found FROM s LEFT JOIN ctx ON query_id = item_id),
  k AS (SELECT item_id, count(*) AS n, count(*) FILTER (words = 0 OR found >= 0.5 * words) AS k FROM g GROUP BY 1),
  borne AS (SELECT b.item_id AS query_id, CASE WHEN trim(b.text) = '' THEN 0.0 WHEN n IS NULL THEN 1.0 ELSE round(k / n::DOUBLE, 4) END::DOUBLE AS score FROM benchmark b LEFT JOIN k USING (item_id))"""


@register(f"""{GATES} SELECT query_id, 1::INT AS step, 'chunk_quality' AS gate, score, score >= 0.4 AS passed, CASE WHEN score >= 0.4 THEN 'accepted' ELSE 'excluded' END AS action FROM worst
  UNION ALL SELECT query_id, 2, 'retrieval', strength, passed, action FROM healed UNION ALL SELECT query_id, 3, 'groundedness', score, score >= 0.6, CASE WHEN score >= 0.6 THEN 'none' ELSE 'flag' END FROM borne""")
def gate_trace(spark, sf_dir):
    asked, texts = _questions(spark, sf_dir), read(spark, sf_dir, "documents").select("doc_id", "text")
    # All three searches share the lists of one pass over the texts, the first two are the same.
    with retrieval.taken_apart(_passages(spark, sf_dir)) as search:
        first = search(asked, 3)
        again = healed(spark, sf_dir, lambda q, k: first.join(q.select("query_id"), "query_id", "left_semi") if k == 3 else search(q, k)).withColumnRenamed("strength", "score")
    top = first.select("query_id", F.col("chunk_id").alias("doc_id"))
    # The texts that were found are read for two gates.
    found = graph._cut(texts.join(retrieval.narrow(top.select("doc_id").distinct(), asked.count()), "doc_id", "left_semi"))
    scored = quality.score(found).select("doc_id", "quality_score")
    worst = top.join(scored, "doc_id").groupBy("query_id").agg(F.min("quality_score").cast("double").alias("score"))
    worst = worst.withColumn("passed", F.col("score") >= 0.4).withColumn("action", F.when(F.col("passed"), "accepted").otherwise("excluded"))
    said = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("answer_id"), F.col("text").alias("answer"))
    borne = answers.groundedness(said, top.join(found, "doc_id").select(F.col("query_id").alias("answer_id"), "text")).withColumnRenamed("answer_id", "query_id")
    return answers.gate_trace(worst, again, borne)
