"""Token pieces of documents, and best-fit packing of them into sequences in bulk-synchronous supersteps.

Documents go by bands of sizes, the longest first. A superstep sorts what rooms the open sequences have and the waiting
documents of the band by size, and sweeps from the largest down: a document's successor is the smallest room met so
far that no document before it took. Rooms and documents that are matched stand on the same level of a running sum,
rooms up and documents down, so a sort within each level pairs them, and of documents that want the same room the first
by rank gets it. The gaps are updated, and the next superstep matches what is left; when none fits, the rest of the band
opens sequences. Ranks come from counts of each size and slice, so no size meets in one task; what is known of sizes is
a table of at most `length` rows.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .segments import SegmentIds
from .shared import DOCUMENTS, cut, kept, new_folder, partitions, tasks_for
from .words import blocks

#: Rows of sizes and places that are worth a task where they are written.
ROWS = 50_000
_encoders: dict[str, SegmentIds] = {}


def id_table(path: str) -> SegmentIds:
    """Ids of segments by a tokenizers file; one table per worker and file."""
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.encode_special_tokens = True

        def encode(texts: list[str]) -> list[np.ndarray]:
            return [np.array(x.ids, np.uint32) for x in model.encode_batch_fast(texts, add_special_tokens=False)]

        line = encode(["\n"])[0].tolist()
        _encoders[path] = SegmentIds(encode, line[0] if len(line) == 1 else None)
    return _encoders[path]


def pieces(docs: DataFrame, path: str, end_id: int, length: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of each document: doc_id, piece, start, length, ids_crc32.

    A document is the ids of its text (null: empty), then `end_id`. One of more than `length` ids is cut into pieces
    of `length`, but for the first, which takes what is over.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table, end = id_table(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part, texts in blocks([batch], limit=4 << 20):
                rows, of = [], []
                flat, bounds = table.of(texts)
                data = memoryview(flat.astype("<u4").tobytes())
                for i, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist(), strict=False)):
                    ids = bytes(data[4 * a : 4 * b]) + end
                    total = b - a + 1
                    edges = [0, *range(total % length or length, total + 1, length)] if total > length else [0, total]
                    for k, (x, y) in enumerate(zip(edges, edges[1:], strict=False)):
                        rows.append((k, x, y - x, zlib.crc32(ids[4 * x : 4 * y])))
                        of.append(i)
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), *columns], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def ranked(items: DataFrame, size: str, by: list[str], slices: int) -> DataFrame:
    """items with `rank`, numbering the rows of each size from 0, without bringing a size into one task."""
    dealt = items.withColumn("slice", F.pmod(F.xxhash64(*by), F.lit(slices)))
    before = Window.partitionBy(size).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(size, "slice").agg(F.count("*").alias("n"))
    offsets = counts.select(size, "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy(size, "slice").orderBy(*by)
    return (
        dealt.withColumn("within", F.row_number().over(within) - 1)
        .join(offsets, [size, "slice"])
        .withColumn("rank", F.col("before") + F.col("within"))
        .drop("slice", "before", "within")
    )


def bundled(items: DataFrame, length: int, size: str, by: tuple[str, ...], slices: int) -> DataFrame:
    """Rows as (size, key, members): one each, but sizes of at most a 32nd of length in bundles of one size of up to a 16th,
    so that no sequence takes more than some dozens."""
    tiny = length // 32
    each = items.select(F.col(size).cast("int").alias("size"), F.struct(*by).alias("key"), F.struct(*items.columns).alias("member"))
    single = each.filter(F.col("size") > tiny).select("size", "key", F.array("member").alias("members"))
    dealt = each.filter(F.col("size") <= tiny).withColumn("slice", F.pmod(F.xxhash64("key"), F.lit(slices)))
    place = F.row_number().over(Window.partitionBy("size", "slice").orderBy("key")) - 1
    few = dealt.withColumn("bundle", F.floor(place / F.floor(F.lit(2 * tiny) / F.col("size"))))
    rows = few.groupBy("size", "slice", "bundle").agg(F.min("key").alias("key"), F.collect_list("member").alias("members"))
    return single.unionByName(rows.select((F.col("size") * F.size("members")).cast("int").alias("size"), "key", "members"))


def swept(waiting: DataFrame, rooms: DataFrame) -> DataFrame:
    """The sweep over sizes: (size, placed, n) of documents and (size, rooms) to, for each size, the level `before` it, the
    `top` that its rooms reach, how many documents are `met`, and the `floor` that later sizes come down to: rooms above
    it are taken."""
    down = Window.orderBy(F.desc("size"))
    so_far, later = down.rowsBetween(Window.unboundedPreceding, 0), down.rowsBetween(0, Window.unboundedFollowing)
    both = waiting.withColumn("docs", F.col("n") - F.col("placed")).join(rooms, "size", "full").fillna(0, ["docs", "rooms", "n", "placed"])
    sums = both.withColumn("sum", F.sum(F.col("rooms") - F.col("docs")).over(so_far))
    after = sums.withColumn("after", F.col("sum") - F.least(F.lit(0), F.min("sum").over(so_far))).drop("sum")
    top = after.withColumn("before", F.coalesce(F.lag("after").over(down), F.lit(0))).withColumn("top", F.col("before") + F.col("rooms"))
    return top.withColumn("met", F.least("docs", "top")).withColumn("floor", F.min("after").over(later))


def matched(documents: DataFrame, slots: DataFrame, classes: DataFrame, slices: int) -> DataFrame:
    """(seq, size, members) of the documents (size, rank, members) that get one of the slots (room, seq, slot)."""
    known = F.broadcast(classes.withColumnRenamed("size", "of"))  # a row for each size
    rooms = ranked(slots, "room", ["seq", "slot"], slices).join(known, F.col("room") == F.col("of"))
    rooms = rooms.withColumn("level", F.col("before") + F.col("rank") + 1).filter(F.col("level") > F.col("floor"))
    docs = documents.join(known, F.col("size") == F.col("of")).withColumn("j", F.col("rank") - F.col("placed")).filter((F.col("j") >= 0) & (F.col("j") < F.col("met")))
    up = rooms.select("level", F.col("room").alias("size"), F.lit(0).alias("kind"), "seq", F.lit(None).cast(documents.schema["members"].dataType).alias("members"))
    down = docs.select((F.col("top") - F.col("j")).alias("level"), "size", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("seq"), "members")
    order = Window.partitionBy("level").orderBy(F.desc("size"), "kind")
    pairs = up.unionByName(down).withColumn("next", F.lead(F.struct("size", "members")).over(order)).filter("kind = 0")
    return pairs.select("seq", "next.size", "next.members")


def own_sequences(documents: DataFrame, waiting: DataFrame, length: int, opened: int, path: str) -> tuple[DataFrame, DataFrame, int]:
    """The waiting documents with seq, as many of one size in a sequence as fit; the new gaps; the number of sequences."""
    before = Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    new = waiting.withColumn("left", F.col("n") - F.col("placed")).filter("left > 0").withColumn("fits", F.floor(F.lit(length) / F.col("size")))
    new = kept(new.withColumn("bins", F.ceil(F.col("left") / F.col("fits"))).withColumn("base", F.coalesce(F.sum("bins").over(before), F.lit(0)) + opened), path, tasks=1)
    known = F.broadcast(new.withColumnRenamed("size", "of"))  # a row for each size
    rest = documents.join(known, F.col("size") == F.col("of")).withColumn("j", F.col("rank") - F.col("placed")).filter("j >= 0")
    rest = rest.withColumn("bin", F.floor(F.col("j") / F.col("fits"))).withColumn("seq", (F.col("base") + F.col("bin")).cast("long"))
    held = F.least("fits", F.col("left") - F.col("bin") * F.col("fits"))
    gaps = rest.filter(F.col("j") % F.col("fits") == 0).select("seq", (length - held * F.col("size")).cast("int").alias("gap")).filter("gap > 0")
    return rest, gaps, int(new.agg(F.sum("bins")).first()[0])


#: Bands from this one on, of sizes of at most a quarter of length, open sequences together; before it a band's sizes
#: lie between two successive fractions of length.
SHARED = 3


def pack(items: DataFrame, length: int = 1024, size: str = "length", by: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """items with sequence_id and offset: a packing into few sequences of at most `length`, gapless from offset 0.

    `size` is a column of whole numbers from 1 to `length`; `by` orders rows of the same size (repeated rows are
    placed one by one). An empty table gives no rows. Columns named sequence_id or offset are replaced. Reads items
    more than once: give a written table.
    """
    spark = items.sparkSession
    items = items.drop("sequence_id", "offset")
    slices, edges = max(8, partitions(spark)), [length, length // 2, length // 3, length // 4, length // 8, 0]
    band = sum((F.col("size") <= e).cast("int") for e in edges[1:-1])
    rows = ranked(bundled(items, length, size, by, slices), "size", ["key"], slices).drop("key").withColumn("band", band)
    folder = new_folder(spark, "packing")
    rows = kept(rows, f"{folder}/documents", by="band", tasks=tasks_for(items.count(), ROWS))
    sizes = kept(rows.groupBy("band", "size").agg(F.count("*").alias("n")), f"{folder}/sizes", tasks=1)
    gaps = spark.createDataFrame([], "seq long, gap int")
    steps, opened = itertools.count(), 0

    def place(found: DataFrame, number: int) -> DataFrame:
        return kept(found, f"{folder}/placed/step={next(steps)}", tasks=tasks_for(number, ROWS))

    place(rows.select(F.lit(0).cast("long").alias("seq"), "size", "members").limit(0), 0)
    for number in sorted(r.band for r in sizes.select("band").distinct().collect()):
        own, most, least = rows.filter(F.col("band") == number), edges[number], edges[number + 1] + 1
        waiting = sizes.filter(F.col("band") == number).select("size", F.lit(0).cast("long").alias("placed"), "n")
        last, total = number == len(edges) - 2, None
        while True:
            # A gap has a slot for each document of the band that it is sure to hold.
            number_of = F.greatest(F.lit(1), F.floor(F.col("gap") / most))
            slots = gaps.filter(F.col("gap") >= least).withColumn("slot", F.explode(F.sequence(F.lit(1).cast("long"), number_of))).withColumn("room", F.floor(F.col("gap") / number_of).cast("int"))
            classes = kept(swept(waiting, slots.groupBy(F.col("room").alias("size")).agg(F.count("*").alias("rooms"))), f"{folder}/classes-{next(steps)}", tasks=1)
            met, docs, left = classes.agg(F.sum("met"), F.sum("docs"), F.sum(F.col("docs") * F.col("size"))).first()
            total = total or docs
            if met:
                pairs = place(matched(own, slots.drop("gap"), classes, slices), met)
                used = pairs.groupBy("seq").agg(F.sum("size").alias("used"))
                gaps = kept(gaps.join(used, "seq", "left").select("seq", (F.col("gap") - F.coalesce("used", F.lit(0))).cast("int").alias("gap")).filter("gap > 0"), f"{folder}/gaps-{next(steps)}", tasks=tasks_for(opened, ROWS))
                waiting = classes.filter("docs > 0").select("size", (F.col("placed") + F.col("met")).alias("placed"), "n")
            if met == docs:
                break
            if number < SHARED or not last and 20 * (docs - met) < total and 4 * met < docs:
                # No two sizes of such a band leave room for another of its documents, or few are left and fewer fit: each size fills
                # sequences of its own, and smaller documents their gaps.
                rest, new, some = own_sequences(own, waiting, length, opened, f"{folder}/own-{next(steps)}")
                place(rest.select("seq", "size", "members"), docs - met)
                opened += some
                gaps = kept(gaps.unionByName(new), f"{folder}/gaps-{next(steps)}", tasks=tasks_for(opened, ROWS))
                break
            if not met:
                # Sequences for what is left, if they were filled whole; the next supersteps fill them.
                some = -(-left // length)
                gaps = gaps.unionByName(spark.range(opened, opened + some).select(F.col("id").alias("seq"), F.lit(length).alias("gap")))
                opened += some
    shape = T.StructType([T.StructField("seq", T.LongType()), rows.schema["members"]])
    each = spark.read.schema(shape).parquet(f"{folder}/placed").select("seq", F.explode("members").alias("m")).select(F.col("seq").alias("sequence_id"), "m.*")
    order = Window.partitionBy("sequence_id").orderBy(F.desc(size), *by)
    out = each.withColumn("offset", (F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col(size)).cast("long"))
    return out.select(*items.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, length: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """pieces() of whole documents with the sequence_id and offset of pack(). A null or empty text is one piece of the end
    id; repeated rows and rows without doc_id are placed one by one; an empty table gives no rows; other columns go."""
    return pack(cut(pieces(docs, path, end_id, length, doc_id, text), tasks=tasks_for(docs.count(), DOCUMENTS)), length, "length", ("doc_id", "piece", "start", "ids_crc32"))
