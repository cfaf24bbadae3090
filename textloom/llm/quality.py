"""Quality rules: counts within each text, and lines that too many documents of a host share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import DOCUMENTS, cut, tasks_for
from .words import Words, blocks, mix, runs

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _per_text(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The sum of flags between consecutive edges."""
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return np.diff(sums[edges])


def repeated_words(words: Words) -> np.ndarray:
    """For each text, the words in three-word windows that occur twice or more in it."""
    h, n = words.hashes, len(words.hashes)
    covered = np.zeros(n, bool)
    if n >= 3:
        start = np.flatnonzero(words.of[: n - 2] == words.of[2:])
        key = mix(runs(h, start, start + 3) + words.of[start].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(start), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for k in range(3):
            covered[start[twice] + k] = True
    return _per_text(covered, words.bounds)


def text_counts(docs: DataFrame, doc_id: str, host: str, text: str) -> DataFrame:
    """For each row: counts, and `lines`, an array of (hash, words) of its distinct lines.

    A line counts by its words, lower-cased in A-Z, so spacing doesn't matter; its words are summed over repeats.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part, texts in blocks([batch]):
                words = Words(texts, lines=True)
                lowered = Words(texts, lower=True).hashes
                data = np.frombuffer(b"".join(texts), np.uint8)
                edges = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
                chars = _per_text(~_SPACE[data] & ((data & 0xC0) != 0x80), edges)
                symbols = _per_text(_SYMBOLS[data], edges)
                line_id = words.of * np.int64(1 << 40) + words.lines
                first = np.flatnonzero(np.diff(line_id, prepend=-1))
                ends = np.append(first[1:], len(line_id)) if len(first) else first
                exact, loose, of = runs(words.hashes, first, ends), runs(lowered, first, ends), words.of[first] if len(first) else np.zeros(0, np.int64)
                dup = np.zeros(len(texts), np.int64)
                lines = []
                bounds = np.searchsorted(of, np.arange(len(texts) + 1))
                sizes = ends - first
                for i in range(len(texts)):
                    a, b = bounds[i], bounds[i + 1]
                    dup[i] = b - a - len(np.unique(exact[a:b]))
                    found, where = np.unique(loose[a:b], return_inverse=True)
                    total = np.bincount(where, sizes[a:b], len(found))
                    lines.append([{"line": x, "words": y} for x, y in zip(found.view(np.int64).tolist(), total.astype(np.int64).tolist(), strict=True)])
                span = pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int64())]))
                ints = [pa.array(x, pa.int64()) for x in (words.counts(), chars, symbols, dup, repeated_words(words))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *ints, pa.array(lines, span)], names=["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"])

    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(text).alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"doc_id {kind}, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<line:long,words:long>>")


def quality_rules(
    docs: DataFrame,
    doc_id: str = "doc_id",
    host: str = "source",
    text: str = "text",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    line_docs: int = 10,
    line_share: float = 0.001,
    min_left_percent: int = 50,
) -> DataFrame:
    """Counts, verdict and lines removed for each document.

    A line is removed where at least `line_docs` documents of its host, and more than `line_share` of them, have it.
    A document is kept if it has `min_words` words, at most `max_repeat_percent` of them in repeated three-word
    windows, and `min_left_percent` of its words after removal. Counting is by host and line with partial counts
    before the shuffle, so neither a large host nor a common line meets in one task.

    Null text: no words, so not kept. A null host is a host of its own. Rows that share a doc_id are judged row by row and
    count as one document of their host; rows without doc_id count one by one. An empty table gives no rows. Other
    columns are dropped.
    """
    base = cut(text_counts(docs, doc_id, host, text).withColumn("row", F.monotonically_increasing_id()), tasks=tasks_for(docs.count(), DOCUMENTS))
    named = base.withColumn("host", F.coalesce("host", F.lit("\0"))).withColumn("alone", F.when(F.col("doc_id").isNull(), F.col("row")))
    lines = named.select("row", "doc_id", "alone", "host", F.explode("lines").alias("x")).select("row", "doc_id", "alone", "host", "x.line", "x.words")
    # Documents count once, however many rows they have.
    hosts = named.select("host", "doc_id", "alone").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    counts = lines.select("host", "line", "doc_id", "alone").distinct().groupBy("host", "line").agg(F.count("*").alias("docs")).filter(F.col("docs") >= line_docs)
    common = counts.join(hosts, "host").filter(F.col("docs") > line_share * F.col("host_docs")).select("host", "line")
    removed = lines.select("row", "host", "line", "words").join(common, ["host", "line"]).groupBy("row").agg(F.sum("words").alias("n_removed"), F.count("*").alias("lines_removed"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed")
    return (
        base.drop("lines", "host")
        .join(removed, "row", "left")
        .fillna(0, ["n_removed", "lines_removed"])
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (100 * left >= min_left_percent * F.col("n_words")))
        .drop("row")
    )
