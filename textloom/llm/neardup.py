"""Near-duplicate documents by b-bit MinHash, confirmed on whole shingle sets.

Documents with equal sets form a class with one representative, so copies never meet in pairs. The minima of the
representatives make band keys; of each minimum the low bits are kept and packed into 64-bit lanes, from which counts
of equal lanes give a similarity corrected for lanes that agree by chance. Within a band, members are compared with
one hub, never all with all. What hubs have not joined can only be linked if the members' edits against their hub
overlap: each member looks up just so many of its rarest edits that a linked partner must hold one of them. Every link
is confirmed on the full sets before it counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graphs import components
from .shared import DOCUMENTS, cut, tasks_for
from .words import Words, blocks, mix, runs

BANDS, ROWS, BITS = 24, 4, 8
_rng = np.random.Generator(np.random.PCG64(97))
_A = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, text by text, and their bounds; fewer words make one shingle of all."""
    n = len(words.hashes)
    at = np.flatnonzero(words.of[: n - size + 1] == words.of[size - 1 :]) if n >= size else np.zeros(0, np.int64)
    counts = words.counts()
    short = np.flatnonzero((counts > 0) & (counts < size))
    start, end = np.concatenate([at, words.bounds[short]]), np.concatenate([at + size, words.bounds[short + 1]])
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    values, of = runs(words.hashes, start, end), words.of[start] if len(start) else np.zeros(0, np.int64)
    bounds = np.searchsorted(of, np.arange(len(counts) + 1))
    sets = [np.unique(values[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
    return np.concatenate(sets) if sets else values, np.cumsum([0, *map(len, sets)])


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """For each row of (node, text): n_shingles, two fingerprints of the set, its band keys, and its packed low bits."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part, texts in blocks(batches):
            values, bounds = shingles(Words(texts, lower=True), size)
            some = np.flatnonzero(np.diff(bounds))
            starts = bounds[some]
            minima = np.zeros((len(some), BANDS * ROWS), np.uint64)
            marks = np.zeros((2, len(texts)), np.uint64)
            if len(some):
                for k in range(BANDS * ROWS):
                    minima[:, k] = np.minimum.reduceat((values * _A[k] + _B[k]) >> np.uint64(16), starts)
                marks[0, some] = np.add.reduceat(mix(values), starts)
                marks[1, some] = np.add.reduceat(mix(values ^ np.uint64(0x5BD1E995A7C3F12D)), starts)
            grouped = minima.reshape(len(some) * BANDS, ROWS)
            keys = np.arange(BANDS, dtype=np.uint64)[None].repeat(len(some), 0).ravel() + np.uint64(1)
            for k in range(ROWS):
                keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + grouped[:, k])
            lanes = mix(minima).astype(np.uint8)
            packed = np.ascontiguousarray(lanes).view(np.uint64)
            has = np.zeros(len(texts), np.int64)
            has[some] = 1

            def lists(data: np.ndarray, each: int) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has * each)]), pa.int32()), pa.array(data.ravel().view(np.int64)))

            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(bounds)), pa.array(marks[0].view(np.int64)), pa.array(marks[1].view(np.int64)), lists(keys, BANDS), lists(packed, BANDS * ROWS // 8)],
                names=["node", "n_shingles", "f1", "f2", "bands", "low"],
            )

    kind = docs.schema["node"].dataType.simpleString()
    return docs.mapInArrow(run, f"node {kind}, n_shingles long, f1 long, f2 long, bands array<long>, low array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity of two packed signatures: the share of equal lanes, less those of unequal minima that agree by chance."""

    def differing(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        for shift in (4, 2, 1):
            z = z.bitwiseOR(F.shiftrightunsigned(z, shift))
        return F.bit_count(z.bitwiseAND(F.lit(0x0101010101010101)))

    unequal = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, x: s + x)
    chance = 2.0**-BITS
    return ((1 - unequal / (BANDS * ROWS)) - chance) / (1 - chance)


def compared(pairs: DataFrame, texts: DataFrame, size: int, percent: int, edits: bool) -> DataFrame:
    """The pairs of nodes (a, b) with linked: 100 * intersection >= percent * union of their full sets; with edits also
    the sizes of the sets of a and b and the shingles that only one of them has."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part, left in blocks([batch], "text_a", 1 << 20):
                right = [x or b"" for x in part.column(3).cast(pa.binary()).to_pylist()]
                values, bounds = shingles(Words([*left, *right], lower=True), size)
                sets = [values[i:j] for i, j in zip(bounds, bounds[1:], strict=False)]
                linked, differ = [], []
                for x, y in zip(sets, sets[len(left) :], strict=False):
                    apart = np.setxor1d(x, y, assume_unique=True)
                    union = (len(x) + len(y) + len(apart)) // 2
                    both = union - len(apart)
                    linked.append(both > 0 and 100 * both >= percent * union)
                    differ.append(apart if edits else apart[:0])
                columns = [part.column(0), part.column(1), pa.array(linked)]
                if edits:
                    sizes = np.diff(bounds)
                    offsets = pa.array(np.cumsum([0, *map(len, differ)]), pa.int32())
                    flat = pa.array(np.concatenate(differ).view(np.int64) if differ else [], pa.int64())
                    columns += [pa.array(sizes[: len(left)]), pa.array(sizes[len(left) :]), pa.ListArray.from_arrays(offsets, flat)]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "linked", "size_a", "size_b", "edits"][: len(columns)])

    kind = pairs.schema["a"].dataType.simpleString()
    joined = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    joined = joined.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    more = ", size_a long, size_b long, edits array<long>" if edits else ""
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, f"a {kind}, b {kind}, linked boolean{more}")


#: Members are sorted by v (see across) into classes of [0, STEP) and of STEP**k to STEP**(k + 1).
STEP = 1.15


def across(star: DataFrame, found: DataFrame, percent: int, tasks: int) -> DataFrame:
    """The pairs (a, b) of members of one hub, in different components, that may be linked.

    Members x and y of a hub h hold the edits E_x and E_y, shingles that either x or h has. Their sets differ in as many
    shingles as the edits do, so with sizes s and q = (100 - percent) / (100 + percent) a link asks for at least
    (|E_x| + |E_y| - q (s_x + s_y)) / 2 common edits: v_x + v_y - q s_h with v_x = (|E_x| - q s_x + q s_h) / 2 >= 0.
    This is 1 or more if the hub's component lacks one of the two. So if x lists the edits that members of several
    components hold, rare ones first, then all but the last common - 1 of them must hold one of y's, listed likewise. A
    member offers that many for each class of v among the members that it may meet.
    """
    q = (100 - percent) / (100 + percent)
    named = star.join(found.withColumnRenamed("id", "a"), "a", "left").withColumnRenamed("component", "of_a")
    named = named.join(found.withColumnRenamed("id", "b").withColumnRenamed("component", "of_b"), "b", "left")
    v = (F.size("edits") - q * F.col("size_a") + q * F.col("size_b")) / 2
    member = cut(
        named.select("b", "a", F.coalesce("of_a", "a").alias("component"), F.coalesce("of_b", "b").alias("core"), F.col("size_b").alias("s"), v.alias("v"), "edits")
        .withColumn("rest", F.col("component") != F.col("core"))
        .withColumn("own", F.floor(F.log(F.greatest(F.lit(1.0), F.col("v"))) / F.log(F.lit(STEP)) + 1e-12)),
        tasks=tasks,
    )
    #: The classes that members outside of the hub's component have, and all classes, of hubs with any such member.
    classes = member.groupBy("b").agg(F.collect_set("own").alias("all"), F.collect_set(F.when(F.col("rest"), F.col("own"))).alias("rests")).filter("size(rests) > 0")
    asked = member.join(classes, "b")
    each = asked.select("b", "a", "component", F.explode("edits").alias("edit"))
    # What two components share is held in both, so an edit within one leads to no link between them.
    often = each.groupBy("b", "edit").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    listed = each.join(often.select("b", "edit", "n"), ["b", "edit"]).groupBy("b", "a").agg(F.array_sort(F.collect_list(F.struct("n", "edit"))).alias("shared"))
    ranked = asked.drop("edits").join(listed, ["b", "a"])
    least = F.when(F.col("partner") < 1, 0.0).otherwise(F.pow(F.lit(STEP), F.col("partner")))
    common = F.greatest(F.lit(1.0), F.ceil(F.col("v") + least - q * F.col("s") - 1e-6))
    offers = cut(
        ranked.withColumn("partner", F.explode(F.when(F.col("rest"), F.col("all")).otherwise(F.col("rests"))))
        .withColumn("first", (F.size("shared") - common + 1).cast("int"))
        .filter("first > 0")
        .select("b", "a", "component", "rest", "own", "partner", F.explode(F.slice("shared", 1, F.col("first"))).alias("x"))
        .select("b", "a", "component", "rest", "own", "partner", F.col("x.edit").alias("edit")),
        tasks=tasks,
    )
    return meetings(offers)


def component_pairs(offers: DataFrame) -> DataFrame:
    """The pairs of different components (of_a, of_c) that meet under a key (b, own, partner, edit), of_a not the hub's.

    Components are counted once for each key, so the members of one never look at each other, however many there are.
    """
    once = offers.select("b", "own", "partner", "edit", "component", "rest").distinct()
    left = once.filter("rest").drop("rest").withColumnRenamed("component", "of_a")
    right = once.select("b", F.col("own").alias("partner"), F.col("partner").alias("own"), "edit", F.col("component").alias("of_c"))
    return left.join(right, ["b", "own", "partner", "edit"]).filter("of_a <> of_c")


def meetings(offers: DataFrame) -> DataFrame:
    """The pairs (a, b) of members in different components, not both in the hub's, whose offers (b, a, component, rest, own,
    partner, edit) meet: one's own class is the other's partner under the same hub and edit."""
    key = ["b", "own", "partner", "edit"]
    left = offers.filter("rest").select(*key, F.col("component").alias("of_a"), "a")
    right = offers.select("b", F.col("own").alias("partner"), F.col("partner").alias("own"), "edit", F.col("component").alias("of_c"), F.col("a").alias("c"), F.col("rest").alias("rest_c"))
    met = component_pairs(offers).join(left, [*key, "of_a"]).join(right, [*key, "of_c"]).filter(~F.col("rest_c") | (F.col("a") < F.col("c")))
    return met.select(F.least("a", "c").alias("a"), F.greatest("a", "c").alias("b")).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, slack: float = 0.25) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row: documents are linked where the sets of their `size`-word
    shingles (words lower-cased in A-Z) overlap by `percent` of their union, and kept is the smallest of each group.

    Bands of 4 minima times 24 leave a pair of similarity 0.8 unmet with a chance of 3e-6; pairs whose estimate lies
    `slack` (six standard deviations) under the limit aren't confirmed. A document with fewer words has them all as one
    shingle; one without words has no set and links with nothing. Rows that share a doc_id are one document: each
    gets its own n_shingles and may be linked by its own text, and they share a component. A row without doc_id stays
    alone, with a null component, and is kept. Other columns are dropped.
    """
    node = F.struct(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("copy")).alias("node")
    named = docs.select(node, F.col(text).alias("text"))
    tasks = tasks_for(docs.count(), DOCUMENTS)
    stage = cut(signatures(named, size), tasks=tasks)
    full = stage.filter("n_shingles > 0 and node.doc_id is not null")
    classes = full.groupBy("f1", "f2").agg(F.min("node").alias("rep"))
    members = full.select("node", "f1", "f2").join(classes, ["f1", "f2"]).select("node", "rep").distinct()
    reps = full.join(classes.select(F.col("rep").alias("node")), "node", "left_semi").dropDuplicates(["node"])
    keyed = reps.select("node", F.explode("bands").alias("band"))
    busy = keyed.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    met = cut(keyed.join(busy, "band"), tasks=tasks)
    # The hub of a band is the member that meets the most documents over all its bands: the least edited of a group.
    degree = met.groupBy("node").agg(F.sum("n").alias("degree"))
    hubs = met.join(degree, "node").groupBy("band").agg(F.max_by("node", F.struct("degree", F.xxhash64("node"))).alias("hub"))
    star = met.join(hubs, "band").filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    texts = cut(named.filter("node.doc_id is not null").join(degree.select("node"), "node", "left_semi").dropDuplicates(["node"]), tasks=tasks)
    low = cut(reps.join(degree.select("node"), "node", "left_semi").select("node", "low"), tasks=tasks)

    def estimated(pairs: DataFrame) -> DataFrame:
        sides = pairs.join(low.select(F.col("node").alias("a"), F.col("low").alias("low_a")), "a").join(low.select(F.col("node").alias("b"), F.col("low").alias("low_b")), "b")
        return sides.filter(estimate(F.col("low_a"), F.col("low_b")) >= percent / 100 - slack).select("a", "b")

    star = cut(star, tasks=tasks)
    near = estimated(star).withColumn("near", F.lit(True))
    first = cut(compared(star, texts, size, percent, edits=True).join(near, ["a", "b"], "left"), tasks=tasks)
    links = first.filter("linked and near").select("a", "b")
    second = compared(estimated(cut(across(first, components(links), percent, tasks), tasks=tasks)), texts, size, percent, edits=False)
    # Rows that share a doc_id but not their set stand in several classes; these are linked through it.
    smallest = members.groupBy("node.doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("other")).filter("b <> other").drop("other")
    many = members.select("node.doc_id", F.col("rep").alias("a")).join(smallest, "doc_id").select("a", "b").filter("a <> b")
    joined = components(cut(links.union(cut(second, tasks=tasks).filter("linked").select("a", "b")).union(many), tasks=tasks))
    of = members.join(joined.withColumnRenamed("id", "rep"), "rep", "left").select("node", F.coalesce("component", "rep").getField("doc_id").alias("component"))
    out = stage.select("node", "n_shingles").join(of, "node", "left").withColumn("component_id", F.coalesce("component", "node.doc_id"))
    return out.select("node.doc_id", "n_shingles", "component_id", F.coalesce(F.col("node.doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
