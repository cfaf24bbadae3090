"""Removal of long passages that an earlier document already holds, over a log-structured fingerprint index.

Every window of `window` words has an anchor: the smallest fingerprint of the `gram`-word runs inside it, so equal
windows have equal anchors, and a text has few of them. The index keeps anchors in sorted immutable runs. A batch
becomes a run of its own, is merge-joined with the runs before it, and what both hold is marked as shared; when too
many runs have gathered they are compacted into one.

Consecutive windows with one anchor are a unit, which has a digest of its words' bytes. Units with a shared anchor and
equal digests are equal as a whole. Only where a shared anchor has units of several digests, one unit of each is opened
and its windows are compared one by one.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import DOCUMENTS, drop_folder, kept, new_folder, partitions, tasks_for
from .words import Words, blocks, runs

#: Windows of a unit, at most.
UNIT = 64


def _smallest(values: np.ndarray, span: int) -> np.ndarray:
    """The minimum of each `span` consecutive values."""
    width, low = 1, values
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = span - width
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def anchored(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The start of each window that lies in one text, and its anchor."""
    n = len(words.hashes)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    start = np.arange(n - gram + 1)
    low = _smallest(runs(words.hashes, start, start + gram), window - gram + 1)
    inside = np.flatnonzero(words.of[: n - window + 1] == words.of[window - 1 :])
    return inside, low[inside]


def fingerprints(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """For each row of (doc_id, copy, text): n_words, the digest of all its words, and of its units the anchors, digests,
    first words and numbers of windows."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part, texts in blocks(batches):
            words = Words(texts)
            at, anchor = anchored(words, window, gram)
            of = words.of[at]
            new = np.ones(len(at), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1) | (of[1:] != of[:-1])
            first = np.flatnonzero(new)
            # Repeated words can give long units, which are cut.
            place = np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))
            first = np.flatnonzero(place % UNIT == 0)
            n = np.diff(first, append=len(at))
            bounds = np.searchsorted(of[first], np.arange(len(texts) + 1))
            pos = at[first] - words.bounds[of[first]]
            sha, marks = [], np.zeros(len(first), np.int64)
            for i, x in enumerate(texts):
                own = x.split()
                sha.append(hashlib.sha256(b" ".join(own)).hexdigest())
                for u in range(bounds[i], bounds[i + 1]):
                    span = b" ".join(own[pos[u] : pos[u] + n[u] + window - 1])
                    marks[u] = int.from_bytes(hashlib.blake2b(span, digest_size=8).digest(), "little", signed=True)
            lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, k)) for x, k in ((anchor[first].view(np.int64), pa.int64()), (marks, pa.int64()), (pos, pa.int32()), (n, pa.int32()))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(words.counts()), pa.array(sha), *lists], names=["doc_id", "copy", "n_words", "sha", "anchors", "marks", "pos", "n"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, copy long, n_words long, sha string, anchors array<long>, marks array<long>, pos array<int>, n array<int>")


class FingerprintIndex:
    """Sorted immutable runs of (anchor, lo, hi): the smallest and largest document that holds each anchor.

    A run is a folder under `path`, bucketed and sorted by anchor, so that a batch is merge-joined with it, and runs with
    each other, without dealing them out again. After each batch a new manifest names the runs that count; an index
    is opened, in the same session or another, by the path of its newest manifest's folder.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = 2, buckets: int | None = None):
        self.spark, self.fanout, self.buckets = spark, fanout, buckets or partitions(spark)
        self.path = path or new_folder(spark, "fingerprints")
        self.runs: list[str] = []
        self.marked: list[str] = []
        self.made, self.version, self.kind = 0, 0, "bigint"
        self._tables: dict[str, str] = {}
        while self._exists(f"{self.path}/manifest-{self.version + 1}"):
            self.version += 1
        if self.version:
            last = spark.read.parquet(f"{self.path}/manifest-{self.version}").first()
            self.runs, self.marked, self.made, self.buckets, self.kind = list(last.runs), list(last.marked), last.made, last.buckets, last.kind

    def _exists(self, path: str) -> bool:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)

    def _write(self, rows: DataFrame, name: str) -> str:
        run = f"{name}-{self.made}"
        self.made += 1
        table = f"fingerprints_{uuid.uuid4().hex}"
        rows.write.format("parquet").option("compression", "zstd").option("path", f"{self.path}/{run}").bucketBy(self.buckets, "anchor").sortBy("anchor").saveAsTable(table)
        self._tables[run] = table
        return run

    def run(self, name: str) -> DataFrame:
        """A run of the index as a bucketed table."""
        if name not in self._tables:
            table = f"fingerprints_{uuid.uuid4().hex}"
            more = "" if name.startswith("shared") else f", lo {self.kind}, hi {self.kind}"
            self.spark.sql(f"CREATE TABLE {table} (anchor BIGINT{more}) USING parquet CLUSTERED BY (anchor) SORTED BY (anchor) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
            self._tables[name] = table
        return self.spark.table(self._tables[name])

    def _forget(self, name: str) -> None:
        if table := self._tables.pop(name, None):
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")

    def ingest(self, batch: DataFrame) -> DataFrame:
        """Add a batch of (anchor, doc_id) as a run; returns its anchors that another document, of it or of an
        earlier batch, holds too."""
        self.kind = batch.schema["doc_id"].dataType.simpleString()
        grouped = batch.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
        run = self._write(grouped.repartition(self.buckets, "anchor").coalesce(self.buckets), "run")
        seen = self.run(run)
        for past in self.runs:
            old = self.run(past).select("anchor", F.col("lo").alias("past_lo"), F.col("hi").alias("past_hi"))
            seen = seen.hint("merge").join(old, "anchor", "left").select("anchor", F.least("lo", "past_lo").alias("lo"), F.greatest("hi", "past_hi").alias("hi"))
        self.marked.append(self._write(seen.filter("lo < hi").select("anchor"), "shared"))
        self.runs.append(run)
        old = self.compact() if len(self.runs) >= self.fanout else []
        self.version += 1
        manifest = self.spark.createDataFrame([(self.runs, self.marked, self.made, self.buckets, self.kind)], "runs array<string>, marked array<string>, made int, buckets int, kind string")
        manifest.coalesce(1).write.parquet(f"{self.path}/manifest-{self.version}")
        for name in old:
            self._forget(name)
            drop_folder(self.spark, f"{self.path}/{name}")
        return self.run(self.marked[-1])

    def compact(self) -> list[str]:
        """Merge all runs into one; returns the names of the old ones, which no manifest to come will name."""
        merged = self.run(self.runs[0])
        for name in self.runs[1:]:
            other = self.run(name).select("anchor", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
            merged = merged.hint("merge").join(other, "anchor", "full").select("anchor", F.least("lo", "lo2").alias("lo"), F.greatest("hi", "hi2").alias("hi"))
        old, self.runs = self.runs, [self._write(merged, "run")]
        return old

    def shared(self) -> DataFrame:
        """All anchors that two documents or more hold."""
        rows = self.run(self.marked[0])
        for name in self.marked[1:]:
            rows = rows.hint("merge").join(self.run(name), "anchor", "full")
        return rows

    def drop(self) -> None:
        """Delete the index with its tables."""
        for name in list(self._tables):
            self._forget(name)
        drop_folder(self.spark, self.path)


def compressed(docs: DataFrame) -> DataFrame:
    """(doc_id, copy, text) with each text as UTF-8, deflated."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part in batches:
            packed = [zlib.compress(x or b"", 1) for x in part.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(packed, pa.binary())], names=["doc_id", "copy", "packed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "copy", "text").mapInArrow(run, f"doc_id {kind}, copy long, packed binary")


def windows_of(asked: DataFrame, window: int) -> DataFrame:
    """For each row of (lo, packed, units), the units that are asked for as (anchor, mark, pos, n): lo, anchor, mark and
    the fingerprints of the unit's windows in order."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part, packed in blocks(batches, "packed", 1 << 21):
            words = Words([zlib.decompress(x) for x in packed])
            rows = part.column(2).flatten()
            of = np.repeat(np.arange(len(packed)), part.column(2).value_lengths().to_numpy(zero_copy_only=False))
            anchor, mark, pos, n = (rows.field(k) for k in range(4))
            n = n.to_numpy(zero_copy_only=False).astype(np.int64)
            bounds = np.concatenate([[0], np.cumsum(n)])
            start = words.bounds[of] + pos.to_numpy(zero_copy_only=False)
            each = np.repeat(start - bounds[:-1], n) + np.arange(bounds[-1])
            values = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(runs(words.hashes, each, each + window).view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), anchor, mark, values], names=["lo", "anchor", "mark", "windows"])

    kind = asked.schema["lo"].dataType.simpleString()
    return asked.select("lo", "packed", "units").mapInArrow(run, f"lo {kind}, anchor long, mark long, windows array<long>")


def _keep_rest(found: DataFrame, window: int, with_text: bool) -> DataFrame:
    """For each row of (doc_id, copy, packed, gone): what is left when the windows that start in these ranges of word
    positions go."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part, packed in blocks([batch], "packed", 1 << 21):
                rows = []
                for x, gone in zip(packed, part.column(3), strict=True):
                    words = zlib.decompress(x).split()
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, gone.values.field(0).to_numpy(zero_copy_only=False), 1)
                    np.add.at(edge, gone.values.field(1).to_numpy(zero_copy_only=False) + window - 1, -1)
                    left = [w for w, hit in zip(words, (np.cumsum(edge)[:-1] > 0).tolist(), strict=True) if not hit]
                    joined = b" ".join(left)
                    rows.append((len(words) - len(left), hashlib.sha256(joined).hexdigest(), joined.decode() if with_text else None))
                made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], names=["doc_id", "copy", "n_removed", "kept_sha", "kept_text"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.select("doc_id", "copy", "packed", "gone").mapInArrow(run, f"doc_id {kind}, copy long, n_removed long, kept_sha string, kept_text string")


def merged(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A sort-merge join, whatever the sizes: both sides grow with the input."""
    return a.join(b.hint("merge"), on, how)


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 50, gram: int = 12, batches: int = 3, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row, after removal of every word that lies in a window of
    `window` words whose words also start in a document with a smaller doc_id; with_text: also copy (xxhash64 of
    the text) and kept_text, null where nothing was removed.

    Words keep their case. The rows are ingested in `batches` by a hash of doc_id, as daily loads would be; the result
    doesn't depend on how. A null text has no words, and a text shorter than a window loses none. A row without doc_id
    neither loses words nor takes any. Rows that share a doc_id don't take words from each other. Other columns are
    dropped. What the work leaves in the shared folder is deleted but for the result.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "substrings")
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("copy"), F.col(text).alias("text"))
    tasks = tasks_for(docs.count(), DOCUMENTS)
    stage = kept(fingerprints(keyed, window, gram), f"{folder}/units", tasks=tasks)
    known = stage.filter("doc_id is not null")
    pairs = known.select("doc_id", F.explode("anchors").alias("anchor"))
    index = FingerprintIndex(spark, buckets=min(tasks, partitions(spark)))
    for k in range(batches):
        index.ingest(pairs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k).select("anchor", "doc_id"))
    every = known.select("doc_id", "copy", F.explode(F.arrays_zip("anchors", "marks", "pos", "n")).alias("u"))
    every = every.select("doc_id", "copy", F.col("u.anchors").alias("anchor"), F.col("u.marks").alias("mark"), F.col("u.pos").alias("pos"), F.col("u.n").alias("n"))
    units = kept(merged(every, index.shared(), ["anchor"]), f"{folder}/shared", tasks=tasks)
    index.drop()
    held = kept(merged(compressed(keyed), units.select("doc_id", "copy").distinct(), ["doc_id", "copy"], "left_semi"), f"{folder}/texts", tasks=tasks)
    # One class for each anchor and digest; of each, the first document that holds it and one of its places there.
    first = F.min(F.struct("doc_id", "copy", "pos", "n")).alias("first")
    classes = kept(units.groupBy("anchor", "mark").agg(first, F.max("doc_id").alias("hi")), f"{folder}/classes", tasks=tasks)
    several = classes.groupBy("anchor").agg(F.count("*").alias("c"), F.min("first.doc_id").alias("least"), F.max("hi").alias("most")).filter("c > 1 and least < most")
    opened = merged(classes, several.select("anchor"), ["anchor"]).select("first.doc_id", "first.copy", F.struct("anchor", "mark", "first.pos", "first.n").alias("u"))
    asked = merged(opened.groupBy("doc_id", "copy").agg(F.collect_list("u").alias("units")), held, ["doc_id", "copy"])
    each = kept(windows_of(asked.withColumnRenamed("doc_id", "lo"), window), f"{folder}/windows", tasks=tasks)
    each = each.select("lo", "anchor", "mark", F.posexplode("windows").alias("k", "window"))
    met = each.groupBy("anchor", "window").agg(F.min("lo").alias("least"), F.max("lo").alias("most")).filter("least < most").drop("most")
    earlier = merged(each, met, ["anchor", "window"]).filter("least < lo").groupBy("anchor", "mark").agg(F.collect_set("k").alias("ks"))
    verdict = merged(classes.select("anchor", "mark", F.col("first.doc_id").alias("lo"), "hi"), earlier, ["anchor", "mark"], "left").filter("lo < hi or ks is not null")
    # A later holder of a unit loses all its windows; the first one those that another unit's earlier document has.
    whole = F.array(F.struct(F.col("pos").alias("a"), (F.col("pos") + F.col("n")).alias("b")))
    parts = F.transform("ks", lambda k: F.struct((F.col("pos") + k).alias("a"), (F.col("pos") + k + 1).alias("b")))
    gone = merged(units, verdict.drop("hi"), ["anchor", "mark"]).select("doc_id", "copy", F.when(F.col("lo") < F.col("doc_id"), whole).otherwise(parts).alias("gone")).filter("size(gone) > 0")
    gone = gone.groupBy("doc_id", "copy").agg(F.flatten(F.collect_set("gone")).alias("gone"))
    found = _keep_rest(merged(held, gone, ["doc_id", "copy"]), window, with_text).dropDuplicates(["doc_id", "copy"])
    out = merged(stage.select("doc_id", "copy", "n_words", "sha"), found, ["doc_id", "copy"], "left")
    texts = ["copy", "kept_text"] if with_text else []
    out = out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha", "sha").alias("kept_sha256"), *texts)
    out = kept(out, f"{folder}-result", tasks=tasks)
    drop_folder(spark, folder)
    return out
