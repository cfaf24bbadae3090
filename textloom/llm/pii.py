"""Personal data: fixed patterns, and identifiers that their contexts give away, in DataFrame operations alone.

Matches of the fixed patterns are seeds. Every token with a digit is an occurrence of an instance, the token in lower
case without outer punctuation. Its lexical patterns are the word before it and its shape. Over the graph of instances and
patterns, weighted by occurrences, a pattern's score is the mean of its instances', and an instance that isn't a seed
gets that of its best occurrence, the mean of the two patterns there. So an identifier that one context gives away lends
its score to its other contexts, and these to other identifiers, round by round. Instances with a high score are
identifiers that no fixed pattern covers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import DOCUMENTS, cut, tasks_for

#: Kinds in the order of results, with their patterns. They match as email [A-Za-z0-9._%+-]+@..., and so
#: on, do, but start only where a run of their characters or the last match ends, so that long runs cost linear time.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text that doesn't match these has no match of that kind that counts.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
TOKEN = r"(?:\G|(?<!\S))[^\s0-9]*+[0-9]\S*+"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    digits = F.transform(F.split(F.reverse(_digits(m)), ""), lambda d: d.cast("int"))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).when(d < 5, 2 * d).otherwise(2 * d - 9))
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + F.coalesce(d, F.lit(0))) % 10 == 0


def _valid(kind: Column, m: Column) -> Column:
    n = F.length(_digits(m))
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", m.rlike(f"^{_PART}(?:[.]{_PART}){{3}}$"))
        .when(kind == "card", n.between(16, 19) & _luhn(m))
        .when(kind == "phone", n.between(8, 15))
        .otherwise(True)
    )


def _matches(text: Column, kind: str, pattern: str, hint: str) -> Column:
    """Matches of a kind with the length and, for tokens, the last word of what stands between the match before and each."""
    last = lambda g: F.substring_index(F.rtrim(F.translate(g, "\t\n\x0b\x0c\r", "     ")), " ", -1) if kind == "token" else F.lit("")
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.struct(F.length(g).alias("gap"), last(g).alias("before")))
    both = F.arrays_zip(gaps.alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    rows = F.transform(both, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("k"), x["g"]["gap"].alias("gap"), x["g"]["before"].alias("before"), x["m"].alias("m")))
    none = F.array().cast("array<struct<kind:string,k:int,gap:int,before:string,m:string>>")
    return F.when(text.rlike(hint), F.filter(rows, lambda x: x["m"].isNotNull())).otherwise(none)


def shape(token: Column) -> Column:
    """The token with runs of letters as a, runs with a digit as 9, and the power of two that its length lies under."""
    runs = F.regexp_replace(F.regexp_replace(token, r"\p{L}+", "a"), "[0-9]+", "9")
    return F.concat(F.regexp_replace(runs, "a?9[a9]*", "9"), F.lit(":"), F.ceil(F.log2(F.length(token) + 1)).cast("string"))


def scored(edges: DataFrame, rounds: int, confidence: float, support: int, tasks: int | None = None) -> DataFrame:
    """(inst, left, shape, n, seed), a row for each instance and word before it, to (inst, s): the instances' scores.

    Each round, a pattern's score is the sum of n times the score of its instances over the sum of n plus 2; a word before
    needs at least `support` instances that are seeds or have a score of `confidence`. The score of an instance that is no
    seed is the largest mean of its patterns' scores over the words before it that have support, 0 without any.
    """
    s = edges.groupBy("inst").agg(F.max("seed").cast("double").alias("s"))
    for _ in range(rounds):
        now = edges.join(s, "inst")
        weight = F.sum(F.col("n") * F.col("s")) / (F.sum("n") + 2)
        lefts = now.groupBy("left").agg(weight.alias("p_left"), F.sum((F.col("s") >= confidence).cast("int")).alias("backed"))
        shapes = now.groupBy("shape").agg(weight.alias("p_shape"))
        x = F.round((F.col("p_left") + F.col("p_shape")) / 2, 9)
        found = edges.join(lefts, "left").join(shapes, "shape").select("inst", F.when(F.col("seed"), 1.0).when(F.col("backed") >= support, x).otherwise(0.0).alias("s"))
        s = cut(found.groupBy("inst").agg(F.max("s").alias("s")), tasks=tasks)
    return s


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = 5, confidence: float = 0.5, support: int = 5) -> DataFrame:
    """The spans of each text that has any: key, copy (hashes of doc_id and text), kind, start, end; start and end in
    code points, end exclusive. Kinds are those of KINDS, and `id` for all occurrences of instances that were discovered.

    `rounds`: of scoring. `confidence`: the least score of a discovered instance. `support`: the least number of instances,
    seeds or as sure, that a word before one must have. Equal rows give their spans once.
    """
    named = docs.select(F.xxhash64(F.col(doc_id)).alias("key"), F.xxhash64(F.col(text)).alias("copy"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    matched = [_matches(F.col("text"), k, p, HINTS[k]) for k, p in KINDS.items()]
    tokens = _matches(F.col("text"), "token", TOKEN, "[0-9]")
    some = named.filter(F.col("text").rlike("[0-9@]")).select("key", "copy", F.concat(*matched, tokens).alias("rows"))
    tasks = tasks_for(docs.count(), DOCUMENTS)
    order = Window.partitionBy("key", "copy", "kind").orderBy("k")
    placed = (
        some.filter(F.size("rows") > 0)
        .dropDuplicates(["key", "copy"])
        .select("key", "copy", F.explode("rows").alias("r"))
        .select("key", "copy", "r.*")
        .withColumn("end", F.sum(F.col("gap") + F.length("m")).over(order))
        .withColumn("start", F.col("end") - F.length("m"))
    )
    outer = F.regexp_extract("m", r"^[^\p{L}0-9]*", 0)
    inner = F.regexp_replace(F.regexp_replace(F.col("m"), r"^[^\p{L}0-9]+", ""), r"(?<=[\p{L}0-9])[^\p{L}0-9]+$", "")
    token = F.col("kind") == "token"
    found = cut(
        placed.withColumn("valid", _valid(F.col("kind"), F.col("m")))
        .filter("valid")
        .withColumn("start", F.when(token, F.col("start") + F.length(outer)).otherwise(F.col("start")))
        .withColumn("end", F.when(token, F.col("start") + F.length(inner)).otherwise(F.col("end")))
        .select("key", "copy", "kind", "start", "end", F.when(token, F.lower("before")).alias("left"), F.when(token, shape(inner)).alias("shape"), F.when(token, F.xxhash64(F.lower(inner))).alias("inst")),
        tasks=tasks,
    )
    base = found.filter("kind <> 'token'")
    # A token that a base span touches is a seed: among the spans of its text in order, the furthest end so far and, in
    # the opposite order, the nearest start tell.
    is_base = F.col("kind") != "token"
    before = Window.partitionBy("key", "copy").orderBy("start", F.expr("kind = 'token'")).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("key", "copy").orderBy(F.desc("start"), F.expr("kind <> 'token'")).rowsBetween(Window.unboundedPreceding, -1)
    marked = (
        found.withColumn("past_end", F.max(F.when(is_base, F.col("end"))).over(before))
        .withColumn("next_start", F.min(F.when(is_base, F.col("start"))).over(after))
        .filter("kind = 'token'")
        .withColumn("seed", (F.coalesce("past_end", F.lit(-1)) > F.col("start")) | (F.coalesce("next_start", F.lit(1 << 40)) < F.col("end")))
    )
    marked = cut(marked.select("key", "copy", "start", "end", "left", "shape", "inst", "seed"), tasks=tasks)
    seeds = marked.groupBy("inst").agg(F.max("seed").alias("seed"))
    edges = cut(marked.groupBy("inst", "left", "shape").agg(F.count("*").alias("n")).join(seeds, "inst"), tasks=tasks)
    known = scored(edges, rounds, confidence, support, tasks).filter(F.col("s") >= confidence).select("inst")
    extra = marked.filter(~F.col("seed")).join(known, "inst").select("key", "copy", F.lit("id").alias("kind"), "start", "end")
    return base.select("key", "copy", "kind", "start", "end").unionByName(extra)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def per_text(found: DataFrame) -> DataFrame:
    """The spans of each text in one row, by kind as listed and then start."""
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    rank = F.when(F.col("kind") == "id", F.lit(99).cast("long")).otherwise(rank)
    return found.groupBy("key", "copy").agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "start", "end", "kind"))).alias("spans"))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, the number of spans of each fixed kind, base_sha256 over them, and all spans, for each row.

    A null text counts as empty and has no spans; a null doc_id is kept, and repeated rows get equal results. An empty
    table gives no rows. Other columns are dropped.
    """
    one = per_text(spans(docs, doc_id, text, **options))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(doc_id)).alias("key"), F.xxhash64(F.col(text)).alias("copy"))
    base = F.filter("spans", lambda s: s["kind"] != "id")
    none = F.array().cast("array<struct<rank:bigint,start:bigint,end:bigint,kind:string>>")
    out = rows.join(one, ["key", "copy"], "left").withColumn("spans", F.coalesce("spans", none))

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(k) for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def mask(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with each span replaced by its kind in angle brackets; of overlapping spans the first gives the name, and
    the longest the end. All columns stay."""
    by_start = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    one = per_text(spans(docs, doc_id, text, **options)).select("key", "copy", by_start.alias("spans"))
    keyed = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), F.col(text).alias("text"), F.xxhash64(F.col(doc_id)).alias("key"), F.xxhash64(F.col(text)).alias("copy"))
    x = F.col("text")
    before = F.transform("spans", lambda s, i: F.array_max(F.concat(F.array(F.lit(0).cast("long")), F.transform(F.slice("spans", 1, i), lambda p: p["end"]))))
    pieces = F.zip_with("spans", before, lambda s, b: F.when(s["start"] < b, F.lit("")).otherwise(F.concat(F.substring(x, (b + 1).cast("int"), (s["start"] - b).cast("int")), F.lit("<"), s["kind"], F.lit(">"))))
    last = F.array_max(F.transform("spans", lambda s: s["end"]))
    masked = F.concat(F.array_join(pieces, ""), F.substring(x, (last + 1).cast("int"), F.length(x)))
    done = F.when(F.col("spans").isNull(), x).otherwise(masked)
    return keyed.join(one, ["key", "copy"], "left").select(*[done.alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns])
