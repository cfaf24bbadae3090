"""Chunk quality: four scores, a verdict, and the gate before indexing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_count, words

# Texts that say nothing.
BOILERPLATE = [r"(?i)^(page|slide|figure|table|exhibit)\s*\d+\s*$", r"(?i)^(confidential|proprietary|all rights reserved|copyright).*$", r"^[\s\P{L}&&[^\p{N}_]]+$"]


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def _size(n: Column, least: int, most: int) -> Column:
    return F.when(n < least, F.round(n / max(least, 1) * 0.5, 3)).when(n > most, F.round(most / n, 3)).otherwise(1.0)


def _boundary(t: Column) -> Column:
    low = F.when(t.rlike(r"^\p{Ll}"), 0.3).otherwise(0.0)
    open_ = F.when(F.right(t, F.lit(1)).isin(".", "!", "?", '"', "'"), 0.0).otherwise(0.2)
    return F.when(t == "", 0.0).otherwise(F.round(1.0 - low - open_, 3))


def _plain(t: Column) -> Column:
    """Whether a trimmed text says nothing."""
    same = (F.length(t) >= 6) & t.rlike(r"^[\p{L}\p{N}_]") & (F.length(F.replace(t, F.substring(t, 1, 1), F.lit(""))) == 0)
    for pattern in BOILERPLATE:
        same = same | t.rlike(pattern)
    return same


def _pairs(w: Column) -> Column:
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.concat_ws(" ", a, b))


def _information(plain: Column, n: Column, distinct: Column, most_repeated: float) -> Column:
    repeated = 1.0 - distinct / (n - 1)
    return F.when(plain, 0.1).when(n < 4, 0.7).when(repeated > most_repeated, F.round(1.0 - repeated, 3)).otherwise(1.0)


def _encoding(text: Column, t: Column, least_letters: float) -> Column:
    ratio = F.length(F.regexp_replace(text, r"[^\p{L}]+", "")) / F.length(text)
    return F.when(t == "", 0.0).when(text.contains("�"), 0.2).when(ratio < least_letters, F.round(ratio / least_letters * 0.6, 3)).otherwise(1.0)


def size_score(text: Column, least: int = 10, most: int = 2000) -> Column:
    return _size(word_count(text), least, most)


def boundary_score(text: Column) -> Column:
    return _boundary(_trimmed(text))


def information_score(text: Column, most_repeated: float = 0.5) -> Column:
    t = _trimmed(text)
    w = words(F.lower(t))
    return _information(_plain(t), F.size(w), F.size(F.array_distinct(_pairs(w))), most_repeated)


def encoding_score(text: Column, least_letters: float = 0.3) -> Column:
    return _encoding(F.coalesce(text, F.lit("")), _trimmed(text), least_letters)


def scores(chunks: DataFrame, text: str) -> DataFrame:
    """chunks with the four scores. Words and the trimmed text are columns of their own, so that each is made once."""
    t, w, x = F.col("_trimmed"), F.col("_words"), F.coalesce(F.col(text), F.lit(""))
    parts = chunks.withColumn("_trimmed", _trimmed(F.col(text))).withColumn("_words", words(F.lower(t)))
    parts = parts.withColumns({"_n": F.size(w), "_distinct": F.size(F.array_distinct(_pairs(w)))})
    made = {"size_score": _size(F.col("_n"), 10, 2000), "boundary_score": _boundary(t), "information_score": _information(_plain(t), F.col("_n"), F.col("_distinct"), 0.5), "encoding_score": _encoding(x, t, 0.3)}
    return parts.withColumns(made).drop("_trimmed", "_words", "_n", "_distinct")


def score(chunks: DataFrame, text: str = "text", threshold: float = 0.4, judge: Column | None = None, mode: str = "heuristic_only", band: tuple[float, float] = (0.35, 0.65), strategy: str = "exclude") -> DataFrame:
    """The four scores, their mean as quality_score, and the verdict. mode: heuristic_only; llm_always averages the
    injected judge's score in; heuristic_first does so within `band`, and only rows there go through the judge."""
    actions = {"exclude": "excluded", "flag": "flagged", "re_chunk": "re_chunk_requested"}
    if mode not in ("heuristic_only", "llm_always", "heuristic_first") or strategy not in actions:
        raise ValueError("unknown mode or strategy")
    out = scores(chunks, text)
    # In whole thousandths, so that halves round up whatever their binary form.
    total = F.round(1000 * (F.col("size_score") + F.col("boundary_score") + F.col("information_score") + F.col("encoding_score")))
    out = out.withColumn("quality_score", F.floor((total * 10 + 2) / 4) / 10000)
    if judge is not None and mode != "heuristic_only":
        inside = F.lit(True) if mode == "llm_always" else F.col("quality_score").between(*band)
        said = F.greatest(F.lit(0.0), F.least(F.lit(1.0), judge))
        judged = out.filter(inside).withColumn("quality_score", F.coalesce(F.round((F.col("quality_score") + said) / 2, 4), F.col("quality_score")))
        out = judged if mode == "llm_always" else judged.unionByName(out.filter(~inside))
    passed = F.col("quality_score") >= threshold
    return out.withColumn("quality_passed", passed).withColumn("quality_action", F.when(passed, "accepted").otherwise(actions[strategy]))


def gate(scored: DataFrame, enabled: bool = True) -> DataFrame:
    """What goes on to embedding: all but excluded chunks, or everything where the gate is off."""
    return scored.filter("quality_action <> 'excluded'") if enabled else scored


def gate_summary(scored: DataFrame) -> DataFrame:
    """Counts by verdict; accepted includes flagged, which go on too."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    action = F.col("quality_action")
    return scored.agg(F.count("*").alias("total"), count(action.isin("accepted", "flagged")).alias("accepted"), count(action == "flagged").alias("flagged"), count(action == "excluded").alias("excluded"))
