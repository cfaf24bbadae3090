"""The catalogue of queries over the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources  # noqa: F401
from .. import streaming as ingest
from ..functions import text as T
from ..operators import answers, caching, chunkers, communities, graph, html, quality, retrieval, tables
from ..operators.windows import COUNTERS, WindowConfig, subword_counter, windows
from ..sources import office
from ..sources.lexical import LexicalIndex
from ..sources.nearest import VectorIndex, recall

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Parts of SQL that several oracles share.
WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')"
TERMS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
FIXED = f"""
  w AS (SELECT doc_id, {WORDS.format('text')} AS w FROM src),
  n AS (SELECT doc_id, w, len(w) AS n FROM w WHERE len(w) > 0),
  win AS (SELECT doc_id, w, unnest(range(0, CASE WHEN n <= 100 THEN 1 ELSE CAST(1 + ceil((n - 100) / 90.0) AS BIGINT) END)) AS i FROM n),
  chunks AS (SELECT doc_id, CAST(i AS INT) AS chunk_index, array_to_string(list_slice(w, i * 90 + 1, i * 90 + 100), ' ') AS text, len(list_slice(w, i * 90 + 1, i * 90 + 100)) AS token_count FROM win)"""
PLAIN = WindowConfig(size=100, overlap=10, boundary=False)


def plain_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunkers.chunk_text(read(spark, sf_dir, "documents"), PLAIN)


# ---- words and windows ----


@register(f"SELECT doc_id, len({WORDS.format('text')}) AS n_words FROM documents")
def word_token_count(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.word_count(F.col("text")).alias("n_words"))


@register(f"WITH t AS (SELECT unnest({TERMS.format('text')}) AS term FROM documents) SELECT term, count(*) AS n FROM t GROUP BY term")
def word_tokens(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.explode(T.terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@register(f"WITH src AS (SELECT doc_id, text FROM documents), {FIXED} SELECT doc_id, chunk_index, token_count, md5(text) AS digest FROM chunks")
def chunk_fixed(spark, sf_dir):
    return plain_chunks(spark, sf_dir).select("doc_id", "chunk_index", "token_count", F.md5("text").alias("digest"))


@register(f"WITH src AS (SELECT doc_id, text FROM documents), {FIXED} SELECT doc_id, count(*) AS chunks, sum(token_count)::BIGINT AS tokens, max(token_count) AS longest FROM chunks GROUP BY doc_id")
def chunk_fixed_stats(spark, sf_dir):
    return plain_chunks(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"), F.max("token_count").alias("longest"))


@register(rf"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents),
  b AS (SELECT doc_id, w, len(w) AS n, list_filter(range(1, len(w) + 1), lambda i: right(w[i], 1) IN ('.', '!', '?')) AS ends FROM w WHERE len(w) > 0),
  e AS (SELECT doc_id, s, raw, CASE WHEN raw >= n THEN raw ELSE coalesce(list_max(list_filter(ends, lambda i: i <= raw AND i > 16)), raw) END AS e, 0 AS k
        FROM (SELECT doc_id, n, ends, 0 AS s, least(100, n) AS raw FROM b)
        UNION ALL
        SELECT x.doc_id, x.s, x.raw, CASE WHEN x.raw >= b.n THEN x.raw ELSE coalesce(list_max(list_filter(b.ends, lambda i: i <= x.raw AND i > 16)), x.raw) END, x.k
        FROM (SELECT e.doc_id, greatest(e.s + 1, e.e - 10) AS s, least(greatest(e.s + 1, e.e - 10) + 100, b.n) AS raw, e.k + 1 AS k FROM e JOIN b USING (doc_id) WHERE e.e < b.n) x JOIN b USING (doc_id)),
  f AS (SELECT doc_id, s, e, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS i FROM e WHERE e > s)
  SELECT f.doc_id, CAST(f.i AS INT) AS chunk_index, CAST(f.e - f.s AS INT) AS token_count, md5(array_to_string(list_slice(b.w, f.s + 1, f.e), ' ')) AS digest FROM f JOIN b USING (doc_id)""")
def chunk_sentence(spark, sf_dir):
    c = WindowConfig(size=100, overlap=10)
    return chunkers.chunk_text(read(spark, sf_dir, "documents"), c).select("doc_id", "chunk_index", "token_count", F.md5("text").alias("digest"))


@register()
def chunk_subword(spark, sf_dir):
    """Windows of at most 200 sub-word tokens, by their number of words and a digest of their text."""
    import public_tokenizers

    COUNTERS["byte_bpe_50k"] = subword_counter(public_tokenizers.path("byte_bpe_50k.json"))
    c = WindowConfig(size=200, overlap=20, counter="byte_bpe_50k")
    rows = windows(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", c, "chunk_index", "chunk", "n_words", source=False)
    return rows.select("doc_id", "chunk_index", "n_words", F.md5("chunk").alias("digest"))


@register(f"""WITH src AS (SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations WHERE trim(text) <> ''), {FIXED}
  SELECT doc_id // 1000 AS doc_id, CAST(doc_id % 1000 + 1 AS INT) AS page_number, CAST(row_number() OVER (PARTITION BY doc_id // 1000 ORDER BY doc_id, chunk_index) - 1 AS INT) AS chunk_index, token_count, md5(text) AS digest FROM chunks""")
def chunk_by_page(spark, sf_dir):
    pages = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page"), "text")
    return chunkers.chunk_pages(pages, PLAIN).select("doc_id", "page_number", "chunk_index", "token_count", F.md5("text").alias("digest"))


def _sections(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").withColumn("part", F.concat(F.lit("## "), F.col("role"), F.lit("\n"), F.regexp_replace("text", r"\s+", " ")))
    parts = turns.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "part"))).alias("p"))
    return parts.select("doc_id", F.array_join(F.col("p.part"), "\n").alias("text"))


SECTIONS = rf"""src AS (SELECT conv_id * 1000 + turn AS doc_id, '## ' || role || ' ' || trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM conversations), {FIXED}"""


@register(rf"""WITH {SECTIONS} SELECT doc_id // 1000 AS doc_id, c.role AS heading, CAST(row_number() OVER (PARTITION BY doc_id // 1000 ORDER BY doc_id, chunk_index) - 1 AS INT) AS chunk_index, token_count, md5(chunks.text) AS digest
  FROM chunks JOIN conversations c ON c.conv_id = doc_id // 1000 AND c.turn = doc_id % 1000""")
def chunk_by_heading(spark, sf_dir):
    rows = chunkers.chunk_headings(_sections(spark, sf_dir), PLAIN)
    return rows.select("doc_id", F.substring("heading", 4, 100).alias("heading"), "chunk_index", "token_count", F.md5("text").alias("digest"))


@register(rf"""WITH u AS (SELECT conv_id, turn, {WORDS.format("'## ' || role || ' ' || text")} AS w FROM conversations),
  r AS (SELECT conv_id, turn, w, len(w) AS n, unnest(range(0, CASE WHEN len(w) <= 60 THEN 1 ELSE CAST(1 + ceil((len(w) - 60) / 55.0) AS BIGINT) END)) AS i FROM u)
  SELECT conv_id AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS INT) AS chunk_index, CASE WHEN n <= 60 THEN 'structural' ELSE 'token_window' END AS pass, md5(array_to_string(list_slice(w, i * 55 + 1, i * 55 + 60), ' ')) AS digest FROM r""")
def chunk_hybrid(spark, sf_dir):
    units = chunkers.chunk_headings(_sections(spark, sf_dir), WindowConfig(size=100_000, overlap=0, boundary=False))
    rows = chunkers.chunk_hybrid(units, WindowConfig(size=60, overlap=5, boundary=False), max_unit=60)
    return rows.select("doc_id", "chunk_index", "pass", F.md5("text").alias("digest"))


# ---- sheets and tables ----

CUSTOMER = ["c_name", "c_mktsegment", "c_nationkey"]


def _customers(spark, sf_dir):
    return read(spark, sf_dir, "customer").withColumn("row", F.col("c_custkey"))


@register("""WITH l AS (SELECT c_custkey AS r, 'c_name: ' || c_name || ' | c_mktsegment: ' || c_mktsegment || ' | c_nationkey: ' || c_nationkey AS line FROM customer)
  SELECT 'customer' AS doc_id, CAST(r // 10 AS INT) AS chunk_index, md5(string_agg(line, chr(10) ORDER BY r)) AS digest FROM l GROUP BY r // 10""")
def rows_to_chunks(spark, sf_dir):
    return chunkers.chunk_rows(_customers(spark, sf_dir), CUSTOMER, "row", F.lit("customer")).select("doc_id", "chunk_index", F.md5("text").alias("digest"))


@register(rf"""WITH c AS (SELECT n_regionkey AS doc_id, 0 AS col, 'n_name' AS h, 'Column: n_name' || chr(10) || string_agg(n_name, chr(10) ORDER BY n_nationkey) AS text FROM nation GROUP BY 1
  UNION ALL SELECT n_regionkey, 1, 'n_nationkey', 'Column: n_nationkey' || chr(10) || string_agg(n_nationkey::VARCHAR, chr(10) ORDER BY n_nationkey) FROM nation GROUP BY 1)
  SELECT doc_id, h AS header, CAST(col AS INT) AS chunk_index, md5(array_to_string({WORDS.format('text')}, ' ')) AS digest FROM c""")
def columns_to_chunks(spark, sf_dir):
    nation = read(spark, sf_dir, "nation").withColumn("row", F.col("n_nationkey"))
    return chunkers.chunk_columns(nation, ["n_name", "n_nationkey"], "row", F.col("n_regionkey")).select("doc_id", "header", "chunk_index", F.md5("text").alias("digest"))


def _workbooks(spark, sf_dir):
    """Customers in workbooks of a thousand each, written and read back as rows of cells; sheets' doc_id is the file's number."""
    folder = graph.new_folder(spark, "workbooks")
    c = read(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 1000).cast("string").alias("file"), (F.col("c_custkey") % 1000 + 1).alias("row"), F.array(*[F.col(x).cast("string") for x in CUSTOMER]).alias("cells"))
    head = c.select("file").distinct().select("file", F.lit(0).alias("row"), F.array(*map(F.lit, CUSTOMER)).alias("cells"))
    office.write_xlsx(c.unionByName(head), folder)
    office.register(spark)
    sheets = office.sheet_cells(spark.read.format("xlsx").load(folder))
    return sheets.withColumn("doc_id", F.regexp_extract("path", r"([0-9]+)\.xlsx$", 1).cast("int"))


# Rows of a workbook stand one below the other, so they are numbered within it.
BOOKS = """b AS (SELECT CAST(c_custkey // 1000 AS INT) AS doc_id, row_number() OVER (PARTITION BY c_custkey // 1000 ORDER BY c_custkey) - 1 AS r, c_name, c_mktsegment, c_nationkey FROM customer)"""


@register(f"""WITH {BOOKS}, l AS (SELECT doc_id, r, 'c_name: ' || c_name || ' | c_mktsegment: ' || c_mktsegment || ' | c_nationkey: ' || c_nationkey AS line FROM b)
  SELECT doc_id, CAST(r // 10 AS INT) AS chunk_index, md5(string_agg(line, chr(10) ORDER BY r)) AS digest FROM l GROUP BY doc_id, r // 10""")
def workbook_rows(spark, sf_dir):
    return chunkers.chunk_rows(_workbooks(spark, sf_dir), None, "row", F.col("doc_id")).select("doc_id", "chunk_index", F.md5("text").alias("digest"))


@register(f"""WITH {BOOKS}, c AS (SELECT doc_id, r, 0 AS col, 'c_name: ' || c_name AS text FROM b UNION ALL SELECT doc_id, r, 1, 'c_mktsegment: ' || c_mktsegment FROM b UNION ALL SELECT doc_id, r, 2, 'c_nationkey: ' || c_nationkey FROM b)
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY r, col) - 1 AS INT) AS chunk_index, text FROM c""")
def workbook_cells(spark, sf_dir):
    return chunkers.chunk_cells(_workbooks(spark, sf_dir), None, "row", F.col("doc_id")).select("doc_id", "chunk_index", "text")


@register(r"""WITH p AS (SELECT conv_id, turn, role, trim(regexp_replace(text, '\s+', ' ', 'g')) AS body FROM conversations)
  SELECT conv_id AS doc_id, role AS heading, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS chunk_index, md5(role || ' ' || body) AS digest FROM p WHERE body <> ''""")
def word_sections(spark, sf_dir):
    """Conversations as Word files, a heading for each turn, written, read back and cut at the headings."""
    folder = graph.new_folder(spark, "word-files")
    turns = read(spark, sf_dir, "conversations").withColumn("file", F.col("conv_id").cast("string"))
    heads = turns.select("file", (F.col("turn") * 2).alias("pos"), F.lit("Heading 2").alias("style"), F.col("role").alias("text"))
    bodies = turns.select("file", (F.col("turn") * 2 + 1).alias("pos"), F.lit("Normal").alias("style"), F.regexp_replace("text", r"\s+", " ").alias("text"))
    office.write_docx(heads.unionByName(bodies), folder)
    office.register(spark)
    read_back = spark.read.format("docx").load(folder).withColumn("doc_id", F.regexp_extract("path", r"([0-9]+)\.docx$", 1).cast("long"))
    rows = chunkers.chunk_paragraphs(read_back, WindowConfig(size=100_000, overlap=0, boundary=False))
    return rows.select("doc_id", "heading", "chunk_index", F.md5("text").alias("digest"))


@register("""WITH c AS (SELECT p_brand AS doc_id, p_partkey AS r, 0 AS col, 'p_name: ' || p_name AS text FROM part UNION ALL SELECT p_brand, p_partkey, 1, 'p_size: ' || p_size FROM part)
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY r, col) - 1 AS INT) AS chunk_index, text FROM c""")
def cells_to_chunks(spark, sf_dir):
    return chunkers.chunk_cells(read(spark, sf_dir, "part"), ["p_name", "p_size"], "p_partkey", F.col("p_brand")).select("doc_id", "chunk_index", "text")


def _stitched(spark, sf_dir):
    nation = read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("doc_id"), F.floor(F.col("n_nationkey") / 10).cast("int").alias("page"), "n_nationkey", F.array(F.col("n_nationkey").cast("string"), "n_name").alias("cells"))
    pages = nation.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "cells"))).alias("c"))
    raw = pages.select("doc_id", "page", F.lit(0).alias("table_index"), F.concat(F.array(F.array(F.lit("key"), F.lit("name"))), F.col("c.cells")).alias("cells"))
    return tables.stitch(tables.split_headers(raw))


@register("""WITH p AS (SELECT n_regionkey AS doc_id, n_nationkey // 10 AS page, count(*) AS n FROM nation GROUP BY 1, 2),
  g AS (SELECT *, CASE WHEN lag(page) OVER (PARTITION BY doc_id ORDER BY page) = page - 1 THEN 0 ELSE 1 END AS new FROM p),
  t AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY page) - 1 AS k FROM g)
  SELECT doc_id, CAST(k AS INT) AS table_no, CAST(min(page) AS INT) AS page_start, CAST(max(page) AS INT) AS page_end, CAST(sum(n) AS INT) AS row_count FROM t GROUP BY doc_id, k""")
def stitch_tables(spark, sf_dir):
    return _stitched(spark, sf_dir).select("doc_id", "table_no", "page_start", "page_end", F.size("rows").alias("row_count"))


@register("""WITH w AS (SELECT r_regionkey AS doc_id, greatest(3, max(length(n_name)), 4) AS m FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1)
  SELECT w.doc_id, '| key | ' || rpad('name', m::INT, ' ') || ' |' || chr(10) || '| --- | ' || repeat('-', m) || ' |' || chr(10) ||
    string_agg('| ' || rpad(n_nationkey::VARCHAR, 3, ' ') || ' | ' || rpad(n_name, m::INT, ' ') || ' |', chr(10) ORDER BY n_nationkey) AS text
  FROM w JOIN nation ON n_regionkey = w.doc_id GROUP BY w.doc_id, m""")
def table_markdown(spark, sf_dir):
    rows = read(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", F.array(F.col("n_nationkey").cast("string"), "n_name").alias("r")))).alias("c"))
    return rows.select("doc_id", tables.markdown(F.array(F.lit("key"), F.lit("name")), F.col("c.r")).alias("text"))


@register()
def html_chunks(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "html")
    return html.chunk_html(pages, WindowConfig(size=100, overlap=10)).select("doc_id", "chunk_index", "tags", "text")


# ---- quality ----

QUALITY = rf"""q AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t, {WORDS.format('text')} AS w, {WORDS.format('lower(text)')} AS lw FROM chunks),
  s AS (SELECT *,
    CASE WHEN len(w) < 10 THEN round(len(w) / 10.0 * 0.5, 3) WHEN len(w) > 2000 THEN round(2000.0 / len(w), 3) ELSE 1.0 END AS size_score,
    CASE WHEN t = '' THEN 0.0 ELSE round(1.0 - CASE WHEN regexp_matches(t, '^\p{{Ll}}') THEN 0.3 ELSE 0 END - CASE WHEN right(t, 1) IN ('.', '!', '?', '"', '''') THEN 0 ELSE 0.2 END, 3) END AS boundary_score,
    CASE WHEN regexp_matches(t, '(?i)^(page|slide|figure|table|exhibit)\s*\d+\s*$') OR regexp_matches(t, '(?i)^(confidential|proprietary|all rights reserved|copyright).*$') OR regexp_matches(t, '^[^\p{{L}}\p{{N}}_]+$')
        OR (length(t) >= 6 AND regexp_matches(t, '^[\p{{L}}\p{{N}}_]') AND replace(t, left(t, 1), '') = '') THEN 0.1
      WHEN len(lw) < 4 THEN 0.7
      WHEN 1.0 - len(list_distinct(list_transform(range(1, len(lw)), lambda i: lw[i] || ' ' || lw[i + 1]))) / (len(lw) - 1.0) > 0.5 THEN round(len(list_distinct(list_transform(range(1, len(lw)), lambda i: lw[i] || ' ' || lw[i + 1]))) / (len(lw) - 1.0), 3) ELSE 1.0 END AS information_score,
    CASE WHEN t = '' THEN 0.0 WHEN contains(text, chr(65533)) THEN 0.2 WHEN length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) / length(text)::DOUBLE < 0.3 THEN round(length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) / length(text)::DOUBLE / 0.3 * 0.6, 3) ELSE 1.0 END AS encoding_score FROM q),
  scored AS (SELECT *, floor((round(1000 * (size_score + boundary_score + information_score + encoding_score)::DOUBLE) * 10 + 2) / 4) / 10000 AS quality_score FROM s)"""
ON_CHUNKS = f"WITH src AS (SELECT doc_id, text FROM documents), {FIXED}, {QUALITY}"


def scored_chunks(spark, sf_dir):
    return quality.score(plain_chunks(spark, sf_dir))


def _score(name: str):
    def one(spark, sf_dir):
        return scored_chunks(spark, sf_dir).select("doc_id", "chunk_index", F.col(f"{name}_score").cast("double").alias(f"{name}_score"))

    one.__name__ = f"quality_{name}"
    register(f"{ON_CHUNKS} SELECT doc_id, chunk_index, {name}_score::DOUBLE AS {name}_score FROM scored")(one)


for _name in ("size", "boundary", "information", "encoding", "quality"):
    _score(_name)


@register(f"{ON_CHUNKS} SELECT count(*) AS total, count(*) FILTER (quality_score >= 0.4) AS accepted, 0::BIGINT AS flagged, count(*) FILTER (quality_score < 0.4) AS excluded FROM scored")
def quality_gate_summary(spark, sf_dir):
    return quality.gate_summary(scored_chunks(spark, sf_dir)).select(*[F.col(c).cast("long").alias(c) for c in ("total", "accepted", "flagged", "excluded")])


@register(f"WITH chunks AS (SELECT doc_id, text FROM documents), {QUALITY} SELECT l.quality, count(*) AS docs, round(avg(quality_score), 6) AS mean_score, count(*) FILTER (quality_score >= 0.4) AS passed FROM scored JOIN labels l USING (doc_id) GROUP BY 1")
def quality_vs_labels(spark, sf_dir):
    docs = quality.score(read(spark, sf_dir, "documents").select("doc_id", "text"))
    both = docs.join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return both.groupBy("quality").agg(F.count("*").alias("docs"), F.round(F.avg("quality_score"), 6).alias("mean_score"), F.sum(F.col("quality_passed").cast("long")).alias("passed"))


# ---- dense retrieval ----


def _vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("label"))


def _probes(spark, sf_dir):
    """The stated query set of searches: every row whose id is divisible by 50, against all rows."""
    return _vectors(spark, sf_dir).filter(F.col("chunk_id") % 50 == 0).select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("q_vector"))


def _dense_sql(score: str, where: str = "TRUE", k: int = 5) -> str:
    return f"""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, {score} AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND {where}),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s)
      SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= {k}"""


COSINE = "list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])))"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


@register(_dense_sql(COSINE))
def dense_topk(spark, sf_dir):
    return _rounded(retrieval.dense(_probes(spark, sf_dir), _vectors(spark, sf_dir), 5))


@register(_dense_sql(COSINE, "v.label = 3"))
def dense_filtered(spark, sf_dir):
    return _rounded(retrieval.dense(_probes(spark, sf_dir), _vectors(spark, sf_dir), 5, wanted={"label": "3"}))


@register(_dense_sql("list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"))
def dense_dot(spark, sf_dir):
    return _rounded(retrieval.dense(_probes(spark, sf_dir), _vectors(spark, sf_dir), 5, "dot"))


@register(_dense_sql("-list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"))
def dense_euclid(spark, sf_dir):
    return _rounded(retrieval.dense(_probes(spark, sf_dir), _vectors(spark, sf_dir), 5, "euclid"))


@register(f"""WITH RECURSIVE s AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, {COSINE} AS score, v.embedding::DOUBLE[] AS e FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0),
  c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM s) WHERE r <= 20),
  l AS (SELECT a.query_id, a.chunk_id AS x, b.chunk_id AS y, list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) AS sim FROM c a JOIN c b USING (query_id)),
  p AS (SELECT query_id, [chunk_id] AS picked, 1 AS k FROM c WHERE r = 1 UNION ALL
    SELECT query_id, list_append(picked, chunk_id), k + 1 FROM (SELECT p.query_id, p.picked, p.k, c.chunk_id, row_number() OVER (PARTITION BY p.query_id ORDER BY round(0.5 * c.score - 0.5 * (SELECT max(sim) FROM l WHERE l.query_id = p.query_id AND l.x = c.chunk_id AND list_contains(p.picked, l.y)), 12) DESC, c.r) AS best
      FROM p JOIN c ON c.query_id = p.query_id AND NOT list_contains(p.picked, c.chunk_id) WHERE p.k < 5) WHERE best = 1),
  f AS (SELECT query_id, unnest(picked) AS chunk_id, unnest(range(1, 6)) AS rank FROM p WHERE k = 5)
  SELECT f.query_id, f.chunk_id, round(c.score, 6) AS score, CAST(f.rank AS INT) AS rank FROM f JOIN c ON c.query_id = f.query_id AND c.chunk_id = f.chunk_id""")
def mmr_topk(spark, sf_dir):
    found = retrieval.dense(_probes(spark, sf_dir), _vectors(spark, sf_dir), 20)
    return _rounded(retrieval.mmr(found.join(_vectors(spark, sf_dir).select("chunk_id", "vector"), "chunk_id"), 5))


def _nearest(spark, sf_dir, k, search):
    """What search(index, questions) gives, in an index of the vectors that is made for it."""
    folder, rows = graph.new_folder(spark, "nearest"), _vectors(spark, sf_dir).select("chunk_id", "vector")
    try:
        index = VectorIndex(spark, folder)
        index.create(rows, k=k)
        for i in range(2):
            index.add(rows.filter(F.pmod("chunk_id", F.lit(2)) == i))
        return graph._cut(search(index, _probes(spark, sf_dir)))
    finally:
        sources.delete(spark, folder)


@register(_dense_sql(COSINE))
def dense_index_all_lists(spark, sf_dir):
    """Every list is probed and every candidate scored: the exact result."""
    return _rounded(_nearest(spark, sf_dir, 5, lambda index, asked: index.search(asked, 5, probes=10**6, depth=10**6)))


@register("SELECT count(*) AS queries, true AS good FROM embeddings WHERE vec_id % 50 = 0")
def dense_index_recall(spark, sf_dir):
    """Whether at least 0.9 of the true 10 neighbours are found by the probes that the sample asks for."""
    found = _nearest(spark, sf_dir, 10, lambda index, asked: index.search(asked, 10))
    each = recall(found, retrieval.dense(_probes(spark, sf_dir), _vectors(spark, sf_dir), 10))
    return each.agg(F.count("*").alias("queries"), (F.avg("recall") >= 0.9).alias("good"))


# ---- lexical retrieval ----


def _questions(spark, sf_dir):
    return retrieval.query_table(read(spark, sf_dir, "benchmark"), "item_id", "text")


def _passages(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "lang")


BM25 = rf"""t AS (SELECT doc_id, {TERMS.format('text')} AS t FROM documents), n AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM t),
  p AS (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM t), tf AS (SELECT doc_id, len, term, count(*) AS tf FROM p GROUP BY ALL),
  d AS (SELECT term, ln((n - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM tf, n GROUP BY term, n), m AS (SELECT avg(raw) AS m FROM d),
  i AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * m ELSE raw END AS idf FROM d, m),
  a AS (SELECT item_id AS query_id, unnest({TERMS.format('text')}) AS term FROM benchmark), q AS (SELECT query_id, term, count(*) AS times FROM a GROUP BY ALL),
  sc AS (SELECT query_id, doc_id AS chunk_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))), 6) AS score FROM q JOIN i USING (term) JOIN tf USING (term), n GROUP BY ALL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc)"""


def lexical(spark, sf_dir, k=10, batches=1, **options):
    """A search in an index of the passages that is made for it, of one segment or in several batches."""
    folder, passages = graph.new_folder(spark, "bm25"), _passages(spark, sf_dir)
    try:
        index = LexicalIndex(spark, folder)
        for i in range(batches):
            index.add(passages if batches == 1 else passages.filter(F.pmod(F.xxhash64("chunk_id"), F.lit(batches)) == i))
        return graph._cut(index.search(_questions(spark, sf_dir), k, **options))
    finally:
        sources.delete(spark, folder)


@register(f"WITH {BM25} SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    return lexical(spark, sf_dir)


@register(f"WITH {BM25} SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM ranked JOIN documents d ON d.doc_id = chunk_id WHERE rank <= 10 AND d.lang = 'en'")
def bm25_filtered(spark, sf_dir):
    return lexical(spark, sf_dir, wanted={"lang": "en"})


@register(f"WITH {BM25} SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 10")
def bm25_segments(spark, sf_dir):
    """The index from six batches, four of which are merged."""
    return lexical(spark, sf_dir, batches=6)


@register(f"WITH {BM25} SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 10")
def bm25_scan(spark, sf_dir):
    """The same without an index."""
    return retrieval.bm25(_questions(spark, sf_dir), _passages(spark, sf_dir), 10)


OVERLAP = rf"""ov AS (SELECT item_id AS query_id, doc_id AS chunk_id, len(list_intersect(list_distinct({TERMS.format('b.text')}), list_distinct({TERMS.format('d.text')}))) AS score FROM benchmark b JOIN ranked ON query_id = item_id AND rank <= 20 JOIN documents d ON doc_id = chunk_id)"""


def _common(spark, sf_dir, candidates):
    asked = _questions(spark, sf_dir)
    rows = retrieval.narrow(candidates.join(asked, "query_id"), asked.count())
    return rows.join(_passages(spark, sf_dir).select("chunk_id", "text"), "chunk_id")


def _overlap_count():
    return F.size(F.array_intersect(F.array_distinct(T.terms(F.col("query"))), F.array_distinct(T.terms(F.col("text")))))


@register(f"WITH {BM25}, {OVERLAP} SELECT query_id, chunk_id, score::INT AS score, CAST(r AS INT) AS rank FROM (SELECT ov.*, row_number() OVER (PARTITION BY ov.query_id ORDER BY ov.score DESC, ranked.rank) AS r FROM ov JOIN ranked USING (query_id, chunk_id)) WHERE r <= 5")
def rerank_topk(spark, sf_dir):
    """With a lexical stand-in for a cross-encoder: the number of common terms."""
    return retrieval.rerank(_common(spark, sf_dir, lexical(spark, sf_dir, 20)), _overlap_count(), 5)


@register(f"WITH {BM25}, {OVERLAP} SELECT query_id, chunk_id, score, overlap::INT AS overlap, CAST(r AS INT) AS rank FROM (SELECT ranked.query_id, chunk_id, ranked.score, ov.score AS overlap, row_number() OVER (PARTITION BY ranked.query_id ORDER BY ranked.rank) AS r FROM ranked JOIN ov USING (query_id, chunk_id) WHERE ov.score >= 5) WHERE r <= 5")
def compress_keyword(spark, sf_dir):
    return retrieval.compress(_common(spark, sf_dir, lexical(spark, sf_dir, 20)), 5, 5)


HYBRID = f"""{BM25}, {OVERLAP}, ob AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ov),
  f AS (SELECT query_id, chunk_id, round(sum(p), 9) AS score FROM (SELECT query_id, chunk_id, 0.5 / (60 + rank) AS p FROM ranked WHERE rank <= 20 UNION ALL SELECT query_id, chunk_id, 0.5 / (60 + rank) FROM ob) GROUP BY ALL),
  fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM f)"""


def _second(spark, sf_dir, first):
    return retrieval.top(_common(spark, sf_dir, first).select("query_id", "chunk_id", _overlap_count().alias("score")), 20)


@register(f"WITH {HYBRID} SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM fr WHERE rank <= 5")
def hybrid_rrf(spark, sf_dir):
    first = lexical(spark, sf_dir, 20)
    return retrieval.fuse(first, _second(spark, sf_dir, first), 5)


@register(f"WITH {HYBRID} SELECT query_id, chunk_id, count(*) AS strategies FROM (SELECT query_id, chunk_id FROM ranked WHERE rank <= 10 UNION ALL SELECT query_id, chunk_id FROM ob WHERE rank <= 10) GROUP BY ALL HAVING count(*) >= 2")
def strategy_overlap(spark, sf_dir):
    first = lexical(spark, sf_dir, 20)
    cut = lambda r: r.filter("rank <= 10")
    return retrieval.overlaps({"bm25": cut(first), "terms": cut(_second(spark, sf_dir, first))})


@register(f"WITH {BM25} SELECT query_id, count(*) AS result_count, max(score) AS top_score, max(score) < 30 AS weak, CASE WHEN max(score) < 30 THEN round(max(score) / 30, 4) ELSE 1.0 END AS strength FROM ranked WHERE rank <= 10 GROUP BY 1")
def retrieval_weakness(spark, sf_dir):
    return retrieval.weakness(lexical(spark, sf_dir), _questions(spark, sf_dir), floor=30.0)


def healed(spark, sf_dir, search):
    """The verdicts where French passages are searched for first, and all of them where that is weak; search(queries, k)."""
    passages = _passages(spark, sf_dir)
    ways = {"bm25": lambda q: retrieval.among_wanted(search(q, 3), passages, {"lang": "fr"}), "wide": lambda q: search(q, 10)}
    return retrieval.heal(_questions(spark, sf_dir), ways, ["bm25", "wide"], "bm25", floor=30.0)[0]


@register(f"""WITH {BM25}, fr AS (SELECT query_id, count(*) AS n, max(score) AS top FROM ranked JOIN documents d ON d.doc_id = chunk_id WHERE rank <= 3 AND d.lang = 'fr' GROUP BY 1),
  wide AS (SELECT query_id, count(*) AS n, max(score) AS top FROM ranked WHERE rank <= 10 GROUP BY 1),
  v AS (SELECT item_id AS query_id, coalesce(fr.n, 0) AS n1, fr.top AS t1, CASE WHEN fr.n IS NULL THEN 0.0 WHEN fr.top < 30 THEN round(fr.top / 30, 4) ELSE 1.0 END AS s1, fr.n IS NULL OR fr.top < 30 AS w1, wide.n AS n2, wide.top AS t2, CASE WHEN wide.top < 30 THEN round(wide.top / 30, 4) ELSE 1.0 END AS s2, wide.top < 30 AS w2 FROM benchmark LEFT JOIN fr ON fr.query_id = item_id LEFT JOIN wide ON wide.query_id = item_id),
  r AS (SELECT *, w1 AND s2 > s1 AS second FROM v)
  SELECT query_id, 'bm25' AS original_strategy, CASE WHEN second THEN 'wide' ELSE 'bm25' END AS final_strategy, w1::INT AS retries, CASE WHEN second THEN n2 ELSE n1 END AS result_count, CASE WHEN second THEN t2 ELSE t1 END AS top_score,
    CASE WHEN second THEN s2 ELSE s1 END::DOUBLE AS strength, NOT CASE WHEN second THEN w2 ELSE w1 END AS passed, CASE WHEN NOT w1 THEN 'none' WHEN second THEN 'healed' ELSE 'escalated_no_improvement' END AS action FROM r""")
def retrieval_heal(spark, sf_dir):
    return healed(spark, sf_dir, lambda q, k: retrieval.bm25(q, _passages(spark, sf_dir), k))


# ---- embeddings and generation ----


@register("""WITH t AS (SELECT doc_id, lang, 'emb:' || sha256('stand-in:hash64:' || text) AS key FROM documents) SELECT doc_id, t.key, c.key IS NOT NULL AS hit FROM t LEFT JOIN (SELECT DISTINCT key FROM t WHERE lang = 'en') c USING (key)""")
def embed_cache_plan(spark, sf_dir):
    return _planned(spark, sf_dir).select("doc_id", "key", "hit")


def _planned(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text", caching.cache_key(F.lit("stand-in"), F.lit("hash64"), F.col("text")).alias("key"))
    cached = docs.filter("lang = 'en'").dropDuplicates(["key"]).select("key", F.array(F.lit(0.0)).cast("array<float>").alias("vector"))
    return caching.plan(docs.drop("lang"), cached)


@register("""WITH t AS (SELECT doc_id, lang, text AS key FROM documents), p AS (SELECT t.key, c.key IS NOT NULL AS hit FROM t LEFT JOIN (SELECT DISTINCT key FROM t WHERE lang = 'en') c USING (key)),
  s AS (SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, count(DISTINCT key) FILTER (NOT hit) AS to_embed FROM p) SELECT *, round(hits / (hits + misses)::DOUBLE, 4) AS hit_rate, round(100 * round(hits / (hits + misses)::DOUBLE, 4), 2) AS hit_pct FROM s""")
def embed_cache_stats(spark, sf_dir):
    return caching.stats(_planned(spark, sf_dir))


CONTEXT = f"""WITH {BM25}, e AS (SELECT query_id, rank, '[' || rank || '] ' || text AS entry FROM ranked JOIN documents ON doc_id = chunk_id WHERE rank <= 10),
  c AS (SELECT *, sum(length(entry)) OVER (PARTITION BY query_id ORDER BY rank) AS total FROM e), ctx AS (SELECT query_id, string_agg(entry, chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS entries FROM c WHERE total <= 12000 GROUP BY 1)"""


def _contexts(spark, sf_dir):
    return answers.context(lexical(spark, sf_dir).join(_passages(spark, sf_dir).select("chunk_id", "text"), "chunk_id"))


@register(f"{CONTEXT} SELECT query_id, entries, md5(context) AS digest FROM ctx")
def context_window(spark, sf_dir):
    return _contexts(spark, sf_dir).select("query_id", "entries", F.md5("context").alias("digest"))


@register(f"{CONTEXT} SELECT b.item_id AS query_id, md5('Context:' || chr(10) || coalesce(context, '') || chr(10) || chr(10) || 'Question: ' || b.text || chr(10) || chr(10) || 'Answer:') AS digest FROM benchmark b LEFT JOIN ctx ON query_id = item_id")
def prompt(spark, sf_dir):
    return answers.prompt(_contexts(spark, sf_dir), _questions(spark, sf_dir)).select("query_id", F.md5("prompt").alias("digest"))


STOP = ", ".join(f"'{w}'" for w in answers.STOP_WORDS)
SIGNIFICANT = r"list_filter(list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')), lambda w: length(w) > 4 AND w NOT IN (" + STOP + "))"
GROUNDED = rf"""WITH a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'),
  c AS (SELECT a.conv_id, a.turn, list_distinct(flatten(list({SIGNIFICANT.format('p.text')}))) AS ctx FROM a JOIN conversations p ON p.conv_id = a.conv_id AND p.turn < a.turn GROUP BY 1, 2),
  s AS (SELECT conv_id, turn, unnest(list_filter(list_transform(regexp_split_to_array(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 10)) AS sentence FROM a),
  g AS (SELECT s.conv_id, s.turn, sentence, len({SIGNIFICANT.format('sentence')}) AS words, len(list_intersect({SIGNIFICANT.format('sentence')}, coalesce(ctx, []))) AS found FROM s LEFT JOIN c USING (conv_id, turn)),
  gs AS (SELECT conv_id * 1000 + turn AS answer_id, words, found, words = 0 OR found >= 0.5 * words AS grounded FROM g)"""


def _answers(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    key = (F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id")
    said = turns.filter("role = 'assistant'").select(key, F.col("text").alias("answer"), "conv_id", "turn")
    before = said.select("answer_id", "conv_id", F.col("turn").alias("at")).join(turns, "conv_id").filter("turn < at").select("answer_id", "text")
    return said.select("answer_id", "answer"), before


@register(f"{GROUNDED} SELECT answer_id, count(*) AS sentences, sum(words)::BIGINT AS words, sum(found)::BIGINT AS found, count(*) FILTER (grounded) AS grounded FROM gs GROUP BY 1")
def grounded_sentences(spark, sf_dir):
    rows = answers.grounded_sentences(*_answers(spark, sf_dir))
    return rows.groupBy("answer_id").agg(F.count("*").alias("sentences"), F.sum("words").alias("words"), F.sum("found").alias("found"), F.sum(F.col("grounded").cast("long")).alias("grounded"))


@register(f"""{GROUNDED}, t AS (SELECT answer_id, count(*) AS n, count(*) FILTER (grounded) AS k FROM gs GROUP BY 1), r AS (SELECT a.conv_id * 1000 + a.turn AS answer_id, coalesce(n, 0) AS n, coalesce(k, 0) AS k, CASE WHEN trim(a.text) = '' THEN 0.0 WHEN n IS NULL THEN 1.0 ELSE round(k / n::DOUBLE, 4) END AS score FROM a LEFT JOIN t ON t.answer_id = a.conv_id * 1000 + a.turn)
  SELECT answer_id, k AS grounded_claims, n - k AS ungrounded_claims, score::DOUBLE AS score, score >= 0.6 AS passed, CASE WHEN score >= 0.6 THEN 'none' ELSE 'flag' END AS action FROM r""")
def groundedness(spark, sf_dir):
    return answers.groundedness(*_answers(spark, sf_dir))


# ---- knowledge graph: regions, nations, suppliers and customers with their keys as relations ----

NODES = """ent AS (SELECT 'r' || r_regionkey AS id, r_name AS name, 'REGION' AS entity_type FROM region UNION ALL SELECT 'n' || n_nationkey, n_name, 'NATION' FROM nation
  UNION ALL SELECT 's' || s_suppkey, s_name, 'SUPPLIER' FROM supplier UNION ALL SELECT 'c' || c_custkey, c_name, 'CUSTOMER' FROM customer),
  edge AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'PART_OF' AS relation_type, n_nationkey AS seq FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'LOCATED_IN', s_suppkey FROM supplier UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'LOCATED_IN', c_custkey FROM customer)"""


def _entities(spark, sf_dir):
    parts = [("region", "r", "r_regionkey", "r_name", "REGION"), ("nation", "n", "n_nationkey", "n_name", "NATION"), ("supplier", "s", "s_suppkey", "s_name", "SUPPLIER"), ("customer", "c", "c_custkey", "c_name", "CUSTOMER")]
    rows = [read(spark, sf_dir, t).select(F.concat(F.lit(p), F.col(k)).alias("id"), F.col(n).alias("name"), F.lit(e).alias("entity_type")) for t, p, k, n, e in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def _edges(spark, sf_dir):
    parts = [("nation", "n", "n_nationkey", "r", "n_regionkey", "PART_OF"), ("supplier", "s", "s_suppkey", "n", "s_nationkey", "LOCATED_IN"), ("customer", "c", "c_custkey", "n", "c_nationkey", "LOCATED_IN")]
    rows = [read(spark, sf_dir, t).select(F.concat(F.lit(a), F.col(k)).alias("src"), F.concat(F.lit(b), F.col(v)).alias("dst"), F.lit(e).alias("relation_type"), F.col(k).cast("long").alias("seq"), F.concat(F.lit(f"{t}-"), F.col(k)).alias("chunk_id")) for t, a, k, b, v, e in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@register("""WITH m AS (SELECT o_orderpriority AS name, 'PRIORITY' AS t, o_orderkey AS seq, 'o' || (o_orderkey % 7) AS chunk FROM orders UNION ALL SELECT lower(o_orderpriority), 'priority', o_orderkey + 1000000000, 'x' FROM orders)
  SELECT lower(trim(name)) AS name_normalised, upper(t) AS entity_type, arg_min(name, seq) AS name, array_to_string(list_sort(list_distinct(list(chunk))), ',') AS chunk_ids FROM m GROUP BY 1, 2""")
def graph_entities(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    common = [F.lit("main").alias("collection"), F.lit(None).cast("string").alias("description"), F.lit("d").alias("doc_id")]
    first = o.select(F.col("o_orderpriority").alias("name"), F.lit("PRIORITY").alias("entity_type"), F.col("o_orderkey").alias("seq"), F.concat(F.lit("o"), F.col("o_orderkey") % 7).alias("chunk_id"), *common)
    again = o.select(F.lower("o_orderpriority").alias("name"), F.lit("priority").alias("entity_type"), (F.col("o_orderkey") + 1_000_000_000).alias("seq"), F.lit("x").alias("chunk_id"), *common)
    return graph.resolve_entities(first.unionByName(again)).select("name_normalised", "entity_type", "name", F.array_join("chunk_ids", ",").alias("chunk_ids"))


@register(f"WITH {NODES} SELECT src, dst, relation_type, a.name AS source_name, b.name AS target_name FROM edge LEFT JOIN ent a ON a.id = src LEFT JOIN ent b ON b.id = dst")
def graph_relationships(spark, sf_dir):
    return graph.list_relationships(_edges(spark, sf_dir), _entities(spark, sf_dir)).select("src", "dst", "relation_type", "source_name", "target_name")


@register(f"WITH {NODES} SELECT 'entity' AS kind, entity_type AS type, count(*) AS n FROM ent GROUP BY 2 UNION ALL SELECT 'relationship', relation_type, count(*) FROM edge GROUP BY 2")
def graph_stats(spark, sf_dir):
    return graph.stats(_entities(spark, sf_dir), _edges(spark, sf_dir))


@register(f"WITH {NODES} SELECT src AS node, dst AS neighbour, 'out' AS direction, relation_type FROM edge UNION ALL SELECT dst, src, 'in', relation_type FROM edge")
def graph_neighbours(spark, sf_dir):
    return graph.neighbours(_edges(spark, sf_dir))


@register("""WITH e AS (SELECT 'c' || o_custkey AS src, o_orderstatus AS dst, o_orderkey AS seq FROM orders) SELECT src, dst, max(seq) AS seq FROM e GROUP BY 1, 2""")
def graph_edges_dedup(spark, sf_dir):
    edges = read(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey")).alias("src"), F.col("o_orderstatus").alias("dst"), F.col("o_orderkey").alias("seq"))
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return graph.build(nodes, edges).select("src", "dst", "seq")


def _mentions(spark, sf_dir):
    """A text that names each customer's nation and region in some case."""
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("From "), F.lower("n_name"), F.lit(", in "), F.col("r_name"), F.lit("-wide trade.")).alias("text"))


@register(f"WITH {NODES} SELECT c_custkey AS query_id, 'n' || n_nationkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT c_custkey, 'r' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
def graph_entry_nodes(spark, sf_dir):
    return graph.entry_nodes(_mentions(spark, sf_dir), _entities(spark, sf_dir))


def _starts(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query_id"), F.concat(F.lit("s"), F.col("s_suppkey")).alias("id"))


@register("""WITH s AS (SELECT s_suppkey AS q, s_nationkey AS n, n_regionkey AS r FROM supplier JOIN nation ON n_nationkey = s_nationkey),
  hops AS (SELECT q AS query_id, 's' || q AS node, 0 AS hop FROM s UNION ALL SELECT q, 'n' || n, 1 FROM s UNION ALL SELECT q, 'r' || r, 2 FROM s
    UNION ALL SELECT s.q, 'c' || c_custkey, 2 FROM s JOIN customer ON c_nationkey = s.n UNION ALL SELECT s.q, 's' || b.s_suppkey, 2 FROM s JOIN supplier b ON b.s_nationkey = s.n AND b.s_suppkey <> s.q)
  SELECT query_id, node, CAST(hop AS INT) AS hop FROM hops""")
def graph_bfs(spark, sf_dir):
    return graph.reach(_starts(spark, sf_dir), _edges(spark, sf_dir), 2)


@register(f"""WITH {NODES}, label AS (SELECT id, 'r' || (CASE entity_type WHEN 'REGION' THEN substr(id, 2)::INT WHEN 'NATION' THEN (SELECT n_regionkey FROM nation WHERE 'n' || n_nationkey = id) END) AS r FROM ent WHERE entity_type IN ('REGION', 'NATION')
    UNION ALL SELECT 's' || s_suppkey, 'r' || n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION ALL SELECT 'c' || c_custkey, 'r' || n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey)
  SELECT id, min(id) OVER (PARTITION BY r) AS community, count(*) OVER (PARTITION BY r) AS size FROM label""")
def graph_components(spark, sf_dir):
    return graph.components(_entities(spark, sf_dir), _edges(spark, sf_dir))


@register(ORACLES["graph_components"])
def graph_components_batches(spark, sf_dir):
    """The components of graph_components, from those without suppliers and two batches of the suppliers' edges."""
    links = _edges(spark, sf_dir).select(F.col("src").alias("a"), F.col("dst").alias("b"), "relation_type", "seq")
    late = F.col("a").startswith("s")
    label = graph.connected(links.filter(~late))
    for odd in (0, 1):
        label = graph.extended(label, links.filter(late & (F.col("seq") % 2 == odd)))
    size = label.groupBy("component").agg(F.count("*").alias("size"))
    return label.join(size, "component").select("id", F.col("component").alias("community"), "size")


@register("""WITH n AS (SELECT n_regionkey AS r, r_name AS name FROM nation JOIN region ON r_regionkey = n_regionkey UNION SELECT n_regionkey, n_name FROM nation UNION SELECT n_regionkey, s_name FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION SELECT n_regionkey, c_name FROM customer JOIN nation ON n_nationkey = c_nationkey),
  i AS (SELECT n_regionkey AS r, 'r' || n_regionkey AS id FROM nation UNION SELECT n_regionkey, 'n' || n_nationkey FROM nation UNION SELECT n_regionkey, 's' || s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION SELECT n_regionkey, 'c' || c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey),
  a AS (SELECT r, min(id) AS community, count(*) AS size FROM i GROUP BY 1), b AS (SELECT r, array_to_string(list_slice(list_sort(list(DISTINCT name)), 1, 20), ',') AS names FROM n GROUP BY 1) SELECT community, size, names FROM a JOIN b USING (r)""")
def graph_communities(spark, sf_dir):
    nodes = _entities(spark, sf_dir)
    return graph.communities(graph.components(nodes, _edges(spark, sf_dir)), nodes).select("community", "size", F.array_join("names", ",").alias("names"))


@register()
def graph_modularity(spark, sf_dir):
    return communities.by_modularity(_entities(spark, sf_dir), _edges(spark, sf_dir))


@register(f"""WITH {NODES}, linked AS (SELECT src AS id FROM edge WHERE src <> dst UNION SELECT dst FROM edge WHERE src <> dst)
  SELECT count(*) AS nodes, 0::BIGINT AS split_communities, true AS at_least_components FROM linked JOIN ent USING (id)""")
def graph_modularity_checks(spark, sf_dir):
    """What holds for communities by modularity: every linked node is in one, none falls apart, and they are worth at least
    as much as the components."""
    nodes, edges = _entities(spark, sf_dir), _edges(spark, sf_dir)
    found = communities.by_modularity(nodes, edges)
    # Each check reads the links several times, and the components; they are made once.
    links = graph._cut(communities.undirected(nodes, edges))
    side = found.select(F.col("id").alias("u"), "community")
    inner = links.join(side, "u").join(found.select(F.col("id").alias("v"), F.col("community").alias("other")), "v").filter("community = other")
    parts = graph.connected(graph._cut(inner.select(F.col("u").alias("a"), F.col("v").alias("b"))))
    whole = found.join(parts, "id", "left").groupBy("community").agg(F.countDistinct(F.coalesce("component", "id")).alias("parts"))
    apart = whole.agg(F.count(F.when(F.col("parts") > 1, 1)).alias("split_communities"))
    ok = communities.modularity(found, links) >= communities.modularity(graph._cut(graph.components(nodes, edges)), links)
    return found.agg(F.count("*").alias("nodes")).join(apart).withColumn("at_least_components", F.lit(ok))


@register("""WITH f AS (SELECT s_suppkey AS q, 'supplier-' || s_suppkey AS chunk_id, 0 AS hop FROM supplier UNION ALL SELECT s_suppkey, 'nation-' || s_nationkey, 1 FROM supplier
    UNION ALL SELECT a.s_suppkey, 'supplier-' || b.s_suppkey, 1 FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey UNION ALL SELECT s_suppkey, 'customer-' || c_custkey, 1 FROM supplier JOIN customer ON c_nationkey = s_nationkey),
  g AS (SELECT q, chunk_id, 1 AS side, row_number() OVER (PARTITION BY q ORDER BY hop, chunk_id) AS place FROM f), u AS (SELECT s_suppkey AS q, 'supplier-' || s_suppkey AS chunk_id, 0 AS side, 1 AS place FROM supplier UNION ALL SELECT * FROM g WHERE place <= 8),
  m AS (SELECT q, chunk_id, min(side * 1000 + place) AS o FROM u GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY o, chunk_id) AS rank FROM m)
  SELECT q AS query_id, chunk_id, CAST(o // 1000 AS INT) AS side, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""")
def graph_retrieve(spark, sf_dir):
    starts = _starts(spark, sf_dir)
    dense = starts.select("query_id", F.concat(F.lit("supplier-"), F.col("query_id")).alias("chunk_id"), F.lit(1).alias("rank"))
    return graph.retrieve(dense, graph.traverse(starts, _edges(spark, sf_dir), 1, first=max(5, graph.share(5, 0.5))), 5)


@register("""SELECT c_custkey AS chunk_id, c_name AS entity, upper(c_mktsegment) AS entity_type, 2::INT AS entities, 1::INT AS relationships FROM customer WHERE c_custkey % 5 <> 0
  UNION ALL SELECT c_custkey, NULL, NULL, 0, 0 FROM customer WHERE c_custkey % 5 = 0""")
def parse_extraction(spark, sf_dir):
    fence = F.when(F.col("c_custkey") % 5 == 0, F.lit("no json here")).otherwise(
        F.concat(F.lit('```json\n{"entities": [{"name": " '), F.col("c_name"), F.lit('", "entity_type": "'), F.lower("c_mktsegment"), F.lit('"}, {"name": " "}, {"name": "x"}], "relationships": [{"source": "'), F.col("c_name"), F.lit('", "target": "x"}, {"source": "", "target": "x"}]}\n```'))
    )
    rows = graph.parse_extractions(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chunk_id"), fence.alias("reply")))
    first = F.try_element_at("entities", F.lit(1))
    return rows.select("chunk_id", first["name"].alias("entity"), first["entity_type"].alias("entity_type"), F.size("entities").alias("entities"), F.size("relationships").alias("relationships"))


# ---- ingestion ----


@register("SELECT doc_id, substr(sha256(source || '.txt::' || lang), 1, 32) AS key FROM documents")
def idempotency_keys(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", ingest.idempotency_key(F.concat("source", F.lit(".txt")), F.col("lang")).alias("key"))


def _messages(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("idempotency_key"), F.col("doc_id").alias("published_at"))


@register("SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 THEN 'duplicate' ELSE 'pending' END AS status FROM documents")
def dedupe_ingest(spark, sf_dir):
    return ingest.submit(_messages(spark, sf_dir)).select("doc_id", "status")


@register("""SELECT event_id::VARCHAR AS idempotency_key, CASE WHEN event_type = 'error' AND event_id % 7 = 0 THEN 'dead_letter' ELSE 'complete' END AS status,
  CAST(CASE WHEN event_type <> 'error' THEN 1 WHEN event_id % 7 = 0 THEN 4 ELSE 1 + event_id % 4 END AS INT) AS attempts FROM events""")
def retry_dlq(spark, sf_dir):
    sent = read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("idempotency_key"), "event_id", "event_type", F.lit("pending").alias("status"))
    fails = (F.col("event_type") == "error") & ((F.col("event_id") % 7 == 0) | (F.col("attempt") < F.col("event_id") % 4))
    none = sent.select("idempotency_key").limit(0)
    return ingest.consume(sent, none, fails)


@register("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def ingest_statistics(spark, sf_dir):
    return ingest.statistics(read(spark, sf_dir, "events"), "ts", by=("event_type",))


@register("SELECT count(DISTINCT event_type) AS ok, 'ok' AS status FROM events WHERE event_type <> 'error'")
def health_rollup(spark, sf_dir):
    checks = read(spark, sf_dir, "events").select(F.col("event_type").alias("service"), F.when(F.col("event_type") == "error", "down").otherwise("ok").alias("status"))
    return caching.health(checks, ["click", "view", "purchase", "signup"])


GOOD = BM25.replace(f"SELECT doc_id, {TERMS.format('text')} AS t FROM documents", f"SELECT chunk_id AS doc_id, {TERMS.format('text')} AS t FROM c")


@register(f"""WITH c AS (WITH src AS (SELECT doc_id, text FROM documents), {FIXED}, {QUALITY} SELECT doc_id * 1000000 + chunk_index AS chunk_id, text FROM scored WHERE quality_score >= 0.4),
  {GOOD} SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 5""")
def search_good_chunks(spark, sf_dir):
    """Which chunks match some questions best, bad chunks left out: windows, gate and ranking in one plan."""
    good = quality.gate(scored_chunks(spark, sf_dir)).select((F.col("doc_id") * 1_000_000 + F.col("chunk_index")).alias("chunk_id"), "text")
    return retrieval.bm25(_questions(spark, sf_dir), good, 5)


from . import documents, lifecycle  # noqa: E402, F401  (they add their queries)
