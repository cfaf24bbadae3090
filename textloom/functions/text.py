"""Column expressions on words and sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """The runs between white space, in order; null counts as empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def terms(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores, in any script."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def sentences(text: Column, least: int = 10) -> Column:
    """Pieces after . ! or ? and white space, trimmed, of more than `least` characters."""
    cut = F.split(F.trim(F.coalesce(text, F.lit(""))), r"(?<=[.!?])\s+")
    return F.filter(F.transform(cut, lambda s: F.trim(s)), lambda s: F.length(s) > least)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 where either is zero; the dot product stops at the shorter one."""
    n = F.least(F.size(a), F.size(b))

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(length == 0, 0.0).otherwise(dot(F.slice(a, 1, n), F.slice(b, 1, n)) / length)


def content_key(*parts: Column) -> Column:
    """A key that equal contents share, so writing again changes nothing."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)
