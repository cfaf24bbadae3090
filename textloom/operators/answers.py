"""Answers: context and prompts for generation, and how well an answer is grounded in its context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sentences, terms

# Words that carry no claim.
STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did",
    "will", "would", "could", "should", "may", "might", "this", "that", "these", "those", "with", "from", "into",
    "for", "and", "or", "but", "not", "by", "at", "on", "in", "of", "to", "it", "its",
)


def significant(text: Column) -> Column:
    """Distinct terms of more than four characters that aren't stop words."""
    return F.array_distinct(F.filter(terms(text), lambda w: (F.length(w) > 4) & ~w.isin(*STOP_WORDS)))


def grounded_sentences(answers: DataFrame, contexts: DataFrame) -> DataFrame:
    """(answer_id, answer) and (answer_id, text): each sentence with its significant words, those found in the context,
    and whether at least half are (a sentence without any counts as grounded)."""
    words = contexts.select("answer_id", F.explode(significant(F.col("text"))).alias("w")).groupBy("answer_id").agg(F.collect_set("w").alias("context"))
    rows = answers.select("answer_id", F.posexplode(sentences(F.col("answer"))).alias("pos", "sentence")).join(words, "answer_id", "left")
    mine = significant(F.col("sentence"))
    hits = F.size(F.array_intersect(mine, F.coalesce("context", F.array().cast("array<string>"))))
    rows = rows.withColumn("words", F.size(mine)).withColumn("found", hits)
    return rows.withColumn("grounded", (F.col("words") == 0) | (F.col("found") >= 0.5 * F.col("words"))).drop("context")


def groundedness(answers: DataFrame, contexts: DataFrame, threshold: float = 0.6, on_fail: str = "flag", judge: Column | None = None, mode: str = "heuristic_only", band: tuple[float, float] = (0.35, 0.75)) -> DataFrame:
    """One row per answer: counts, score, passed, action. A blank answer scores 0, one without sentences 1. The judge (a
    column over answer) is averaged in always, or within `band` only."""
    if on_fail not in ("re_prompt", "re_retrieve", "flag") or mode not in ("heuristic_only", "llm_always", "heuristic_first"):
        raise ValueError("unknown on_fail or mode")
    each = grounded_sentences(answers, contexts).groupBy("answer_id").agg(F.count("*").alias("claims"), F.sum(F.col("grounded").cast("int")).alias("grounded_claims"))
    rows = answers.join(each, "answer_id", "left").fillna(0, ["claims", "grounded_claims"])
    blank = F.trim(F.coalesce("answer", F.lit(""))) == ""
    score = F.when(blank, 0.0).when(F.col("claims") == 0, 1.0).otherwise(F.round(F.col("grounded_claims") / F.col("claims"), 4))
    rows = rows.withColumn("score", score)
    if judge is not None and mode != "heuristic_only":
        inside = ~blank & (F.lit(True) if mode == "llm_always" else F.col("score").between(*band))
        said = F.greatest(F.lit(0.0), F.least(F.lit(1.0), judge))
        judged = rows.filter(inside).withColumn("score", F.coalesce(F.round((F.col("score") + said) / 2, 4), F.col("score")))
        rows = judged.unionByName(rows.filter(~inside))
    passed = F.col("score") >= threshold
    return rows.select("answer_id", F.col("grounded_claims"), (F.col("claims") - F.col("grounded_claims")).alias("ungrounded_claims"), "score", passed.alias("passed"), F.when(passed, "none").otherwise(on_fail).alias("action"))


def context(ranked: DataFrame, most: int = 12_000) -> DataFrame:
    """(query_id, rank, text): numbered entries in rank order, up to the first that would pass `most` characters."""
    w = Window.partitionBy("query_id").orderBy("rank")
    entry = F.concat(F.lit("["), F.col("rank"), F.lit("] "), F.col("text"))
    rows = ranked.withColumn("entry", entry).withColumn("total", F.sum(F.length("entry")).over(w)).filter(F.col("total") <= most)
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "entry"))), lambda x: x["entry"]), "\n\n").alias("context"), F.count("*").alias("entries"))


def prompt(contexts: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, prompt) from context() and (query_id, query); a query without a context gets an empty one."""
    rows = queries.select("query_id", "query").join(contexts.select("query_id", "context"), "query_id", "left")
    return rows.select("query_id", F.concat(F.lit("Context:\n"), F.coalesce("context", F.lit("")), F.lit("\n\nQuestion: "), F.col("query"), F.lit("\n\nAnswer:")).alias("prompt"))


def generate(prompts: DataFrame, model: Column) -> DataFrame:
    """prompts with the answer that an injected model column gives."""
    return prompts.withColumn("answer", model)


def gate_trace(quality: DataFrame, healing: DataFrame, grounding: DataFrame) -> DataFrame:
    """Three rows per query from real results: (query_id, score, passed, action) of each gate."""
    rows = None
    for step, (gate, part) in enumerate((("chunk_quality", quality), ("retrieval", healing), ("groundedness", grounding)), 1):
        one = part.select("query_id", F.lit(step).alias("step"), F.lit(gate).alias("gate"), F.col("score").cast("double").alias("score"), "passed", "action")
        rows = one if rows is None else rows.unionByName(one)
    return rows
