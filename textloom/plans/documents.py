"""Queries of the catalogue over structured documents: paragraphs, delimited text, images, tables and their text forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunkers, tables
from .queries import FIXED, PLAIN, _stitched, read, register

# ---- paragraphs and delimited text ----


@register(rf"""WITH p AS (SELECT conv_id, turn, turn % 3 = 0 AS h, trim(CASE WHEN turn % 3 = 0 THEN role ELSE regexp_replace(text, '\s+', ' ', 'g') END) AS line FROM conversations),
  q AS (SELECT *, sum(h::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS section FROM p WHERE line <> ''),
  s AS (SELECT conv_id, section, max(CASE WHEN h THEN line END) AS heading, string_agg(line, ' ' ORDER BY turn) FILTER (NOT h) AS body FROM q GROUP BY 1, 2),
  src AS (SELECT conv_id * 1000 + section AS doc_id, concat_ws(chr(10), heading, body) AS text FROM s WHERE body <> ''), {FIXED}
  SELECT c.doc_id // 1000 AS doc_id, s.heading, CAST(row_number() OVER (PARTITION BY c.doc_id // 1000 ORDER BY c.doc_id, c.chunk_index) - 1 AS INT) AS chunk_index, c.token_count, md5(c.text) AS digest
  FROM chunks c JOIN s ON s.conv_id = c.doc_id // 1000 AND s.section = c.doc_id % 1000""")
def chunk_paragraphs(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    head = F.col("turn") % 3 == 0
    rows = turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.when(head, "Heading 1").otherwise("Normal").alias("style"), F.when(head, F.col("role")).otherwise(F.regexp_replace("text", r"\s+", " ")).alias("text"))
    return chunkers.chunk_paragraphs(rows, PLAIN).select("doc_id", "heading", "chunk_index", "token_count", F.md5("text").alias("digest"))


def _listed(df, order, line):
    """The lines of a group as one text, in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"]), "\n")


@register("""WITH r AS (SELECT n_regionkey AS doc_id, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS r FROM nation)
  SELECT doc_id, CAST(r AS INT) AS row, 0::INT AS col, 'key' AS header, n_nationkey::VARCHAR AS value FROM r UNION ALL SELECT doc_id, CAST(r AS INT), 1, 'name', n_name FROM r""")
def delimited_text(spark, sf_dir):
    nation = read(spark, sf_dir, "nation")
    docs = nation.groupBy(F.col("n_regionkey").alias("doc_id")).agg(F.concat(F.lit("key,name\r\n"), _listed(nation, "n_nationkey", F.concat_ws(",", "n_nationkey", "n_name"))).alias("text"))
    return chunkers.parse_delimited(docs)


# ---- images ----


def _regions(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_id"), F.col("p_size").alias("page"), F.col("p_partkey").alias("image_index"), (F.col("p_size") * 10).alias("width"), (F.col("p_size") * 20).alias("height"), F.lit("png").alias("ext"))


IMAGES = """i AS (SELECT p_brand AS doc_id, p_partkey, p_size, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) - 1 AS INT) AS chunk_index,
  '[Image ' || p_partkey || ' on page ' || p_size || ': ' || p_size * 10 || 'x' || p_size * 20 || ' png]' AS text FROM part WHERE p_size * 10 * p_size * 20 >= 5000)"""


@register(f"WITH {IMAGES} SELECT doc_id, chunk_index, text FROM i")
def image_placeholders(spark, sf_dir):
    return chunkers.chunk_images(_regions(spark, sf_dir)).select("doc_id", "chunk_index", "text")


@register(f"WITH {IMAGES} SELECT doc_id, chunk_index, CASE WHEN p_partkey % 2 = 0 THEN 'A picture of ' || doc_id ELSE text END AS text, CASE WHEN p_partkey % 2 = 0 THEN 3 + len(string_split(doc_id, ' ')) ELSE 7 END::INT AS token_count FROM i")
def image_captions(spark, sf_dir):
    """With a stand-in for a captioner that knows even numbers only."""
    said = F.when(F.col("image_index") % 2 == 0, F.concat(F.lit("A picture of "), F.col("doc_id")))
    return chunkers.caption(chunkers.chunk_images(_regions(spark, sf_dir)), said).select("doc_id", "chunk_index", "text", "token_count")


@register(f"""WITH src AS (SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations WHERE trim(text) <> ''), {FIXED},
  u AS (SELECT doc_id // 1000 AS d, doc_id % 1000 + 1 AS page, 0 AS part, chunk_index AS place, text FROM chunks
    UNION ALL SELECT conv_id, turn + 1, 1, 0, '[Image 0 on page ' || turn + 1 || ': 100x' || turn * 20 || ' jpeg]' FROM conversations WHERE 2000 * turn >= 5000)
  SELECT d AS doc_id, CAST(page AS INT) AS page, CAST(row_number() OVER (PARTITION BY d ORDER BY page, part, place) - 1 AS INT) AS chunk_index, part = 1 AS is_image, md5(text) AS digest FROM u""")
def image_pages(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    pages = turns.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page"), "text")
    regions = turns.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page"), F.lit(0).alias("image_index"), F.lit(100).alias("width"), (F.col("turn") * 20).alias("height"), F.lit("jpeg").alias("ext"))
    return chunkers.chunk_image_pages(pages, regions, PLAIN, "both").select("doc_id", "page", "chunk_index", "is_image", F.md5("text").alias("digest"))


# ---- tables ----


def _nations(spark, sf_dir):
    rows = read(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", F.array(F.col("n_nationkey").cast("string"), F.concat(F.lit('a "'), F.col("n_name"), F.lit('", b'))).alias("r")))).alias("c"))
    return rows.select("doc_id", F.array(F.lit("key"), F.lit("name, quoted")).alias("headers"), F.col("c.r").alias("rows"))


@register("""SELECT n_regionkey AS doc_id, '[' || chr(10) || string_agg('  {' || chr(10) || '    "key": "' || n_nationkey || '",' || chr(10) || '    "name, quoted": "a \\"' || n_name || '\\", b"' || chr(10) || '  }', ',' || chr(10) ORDER BY n_nationkey) || chr(10) || ']' AS text FROM nation GROUP BY 1""")
def table_json(spark, sf_dir):
    return _nations(spark, sf_dir).select("doc_id", tables.as_json(F.col("headers"), F.col("rows")).alias("text"))


@register("""SELECT n_regionkey AS doc_id, 'key,"name, quoted"' || chr(13) || chr(10) || string_agg(n_nationkey || ',"a ""' || n_name || '"", b"', chr(13) || chr(10) ORDER BY n_nationkey) AS text FROM nation GROUP BY 1""")
def table_csv(spark, sf_dir):
    return _nations(spark, sf_dir).select("doc_id", tables.as_csv(F.col("headers"), F.col("rows")).alias("text"))


@register(f"""WITH p AS (SELECT n_regionkey AS doc_id, n_nationkey // 10 AS page, count(*) AS n FROM nation GROUP BY 1, 2),
  g AS (SELECT *, CASE WHEN lag(page) OVER (PARTITION BY doc_id ORDER BY page) = page - 1 THEN 0 ELSE 1 END AS new FROM p),
  t AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY page) - 1 AS k FROM g),
  tab AS (SELECT doc_id, k FROM t GROUP BY 1, 2 HAVING sum(n) >= 2), src AS (SELECT doc_id, text FROM documents), {FIXED}
  SELECT doc_id, 'table' AS kind, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS chunk_index, NULL AS digest FROM tab
  UNION ALL SELECT chunks.doc_id, 'text', CAST(chunk_index + coalesce(n, 0) AS INT), md5(text) FROM chunks LEFT JOIN (SELECT doc_id, count(*) AS n FROM tab GROUP BY 1) m ON m.doc_id = chunks.doc_id""")
def tables_then_text(spark, sf_dir):
    rows = tables.tables_and_text(_stitched(spark, sf_dir), read(spark, sf_dir, "documents").select("doc_id", "text"), PLAIN)
    return rows.select("doc_id", "kind", "chunk_index", F.when(F.col("kind") == "text", F.md5("text")).alias("digest"))


@register("""SELECT n_regionkey AS doc_id, CAST(count(*) + 1 AS INT) AS n_rows, 'key;name;' || string_agg(n_nationkey || ';' || n_name, ';' ORDER BY n_nationkey) AS cells FROM nation GROUP BY 1""")
def pipe_tables(spark, sf_dir):
    nation = read(spark, sf_dir, "nation")
    line = F.concat(F.lit("| "), F.col("n_nationkey"), F.lit(" | "), F.col("n_name"), F.lit(" |"))
    docs = nation.groupBy(F.col("n_regionkey").alias("doc_id")).agg(F.concat(F.lit("| key | name |\n| --- | --- |\n"), _listed(nation, "n_nationkey", line), F.lit("\nno table")).alias("text"))
    return tables.parse_pipes(docs).select("doc_id", F.size("cells").alias("n_rows"), F.array_join(F.flatten("cells"), ";").alias("cells"))
