"""The queries op1 to op13 over the documents and embeddings tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, katz, langid, media, mixing, neardup, packing, phrases, pii, quality, substrings, toxicity, whitening
from .shared import hash_sample


#: The labelled rows that toxicity learns from, at most.
TOXIC_ROWS = 2000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(documents(spark, sf_dir), langid.held_out("doc_id", 7, 2))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), size=2, percent=80)


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(documents(spark, sf_dir), window=50)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("held_out", langid.held_out("doc_id", 4, 2))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    # A bounded sample of the labels of each class is picked before their texts are, so no text is dealt out for training.
    known, sample, seen = labels.filter(~langid.held_out("doc_id", 4, 2)), None, {}
    for kind in (1, 0):
        own, seen[kind] = hash_sample(known.filter(F.col("toxic") == kind), ["doc_id"], TOXIC_ROWS // 2)
        sample = own if sample is None else sample.union(own)
    machine = toxicity.fit(docs.join(F.broadcast(sample), "doc_id").select("text", "toxic"), rows=TOXIC_ROWS, ratio=seen[1] / max(1, seen[1] + seen[0]))
    return toxicity.score(docs, machine, threshold=0.3).select("doc_id", "held_out", "score", "predicted")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir).select("doc_id", "text")
    return bpe.encode_decode(docs, tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.payload_digests(media.sniff(media.store_texts(documents(spark, sf_dir))))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", langid.held_out("doc_id", 5, 0))
    net = langid.fit(docs.filter(~F.col("held_out")))
    return langid.identify(docs.select("doc_id", "text", "held_out"), net).select("doc_id", "held_out", "lang_pred", "score")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), end_id=2, length=1024)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_katz, op2_minhash, op3_substrings, op4_pii, op5_toxicity, op6_byte_bpe, op7_media, op8_language, op9_packing, op10_quality, op11_collocations, op12_mixing, op13_whitening)}


TOKENS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, {TOKENS.format(LOWER.format("coalesce(text, '')"))} AS w FROM documents),
  g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM w),
  p AS (SELECT doc_id, len(g) AS n, unnest(g) AS s FROM g),
  k AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common FROM p a JOIN p b ON a.s = b.s AND a.doc_id < b.doc_id AND a.n * 100 >= 80 * b.n AND b.n * 100 >= 80 * a.n GROUP BY 1, 2),
  l AS (SELECT a, b FROM k WHERE 100 * common >= 80 * (na + nb - common)), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
  r AS (SELECT doc_id AS id, doc_id AS reached FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reached)
  SELECT g.doc_id, len(g)::BIGINT AS n_shingles, c.component_id, g.doc_id = c.component_id AS kept FROM g JOIN (SELECT id, min(reached) AS component_id FROM r GROUP BY 1) c ON c.id = g.doc_id"""

OP3_SQL = f"""WITH w AS (SELECT doc_id, {TOKENS.format("coalesce(text, '')")} AS w FROM documents),
  win AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 48, 1))) AS i FROM w)),
  f AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h),
  c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM win JOIN f USING (h) WHERE first < doc_id),
  x AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM w),
  kept AS (SELECT x.doc_id, string_agg(w[x.k], ' ' ORDER BY x.k) AS t, count(*) AS n FROM x LEFT JOIN c USING (doc_id, k) WHERE c.k IS NULL GROUP BY 1)
  SELECT w.doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

OP10_SQL = f"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {TOKENS.format("coalesce(text, '')")} AS w FROM documents),
  l AS (SELECT doc_id, source, {TOKENS.format("line")} AS e, {TOKENS.format(LOWER.format("line"))} AS k FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d)),
  full_lines AS (SELECT doc_id, source, e, k, len(k) AS n FROM l WHERE len(k) > 0),
  dup AS (SELECT doc_id, count(*) - count(DISTINCT e) AS n_dup_lines FROM full_lines GROUP BY 1),
  lines AS (SELECT doc_id, source, k, sum(n) AS n FROM full_lines GROUP BY 1, 2, 3),
  docs AS (SELECT source, count(DISTINCT doc_id) AS docs FROM documents GROUP BY 1),
  common AS (SELECT source, k FROM (SELECT source, k, count(*) AS c FROM lines GROUP BY 1, 2) JOIN docs USING (source) WHERE c >= 10 AND c > 0.001 * docs),
  gone AS (SELECT doc_id, sum(n)::BIGINT AS n_removed, count(*) AS lines_removed FROM lines JOIN common USING (source, k) GROUP BY 1),
  tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM d)),
  twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS c FROM tri) WHERE c > 1),
  rep AS (SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM twice) GROUP BY 1),
  b AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_removed, 0) AS n_removed, coalesce(lines_removed, 0) AS lines_removed
    FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - n_removed) >= 50 * n_words AS kept FROM b"""

OP11_SQL = rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
  w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
  t AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY 1),
  g AS (SELECT lang, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, greatest(len(w) - m + 2, 1))) AS i FROM w, range(1, 6) AS r(m))),
  f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 100),
  h AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, f, array_to_string(list_slice(string_split(phrase, ' '), x + 1, x + m - 1), ' ') AS phrase FROM f, range(0, 2) AS r(x) WHERE m > 2) GROUP BY 1, 2),
  c AS (SELECT f.lang, f.m, f.phrase, f.f AS a, string_split(f.phrase, ' ') AS w FROM f LEFT JOIN h USING (lang, phrase) WHERE f.m > 1 AND (h.f IS NULL OR 100 * h.f < 100 * f.f)),
  k AS (SELECT lang, m, phrase, a, k, array_to_string(list_slice(w, 1, k), ' ') AS x, array_to_string(list_slice(w, k + 1, m), ' ') AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
  s AS (SELECT k.lang, k.phrase, k.a, x.f AS l, y.f AS r, t.n, k.k, 1000 * k.a::HUGEINT * t.n // (x.f::HUGEINT * y.f) AS score
    FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.x JOIN f y ON y.lang = k.lang AND y.phrase = k.y JOIN t ON t.lang = k.lang),
  b AS (SELECT lang, phrase, a, l, r, n, score FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM b QUALIFY rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express; tests hold the others against brute force."""
    return {"op2_minhash": OP2_SQL, "op3_substrings": OP3_SQL, "op10_quality": OP10_SQL, "op11_collocations": OP11_SQL}
