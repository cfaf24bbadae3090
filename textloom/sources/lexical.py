"""A kept BM25 index: immutable segments of postings bucketed by term, with block maxima, merged like log-structured runs.

Layout under a path: manifest/, and for each segment docs (shard, doc, chunk_id, len, other columns) and postings (by bucket
of a term's hash; a segment has as many buckets as its tokens are worth). A shard is some thousands of chunks, numbered in the order of their ids; a term's postings in
a shard are one row of arrays.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import terms
from ..operators.graph import _cut
from ..operators.postings import ALL, POSTINGS, best, inverted
from ..operators.retrieval import at_least, by_group, fill_zero, match_filter, narrow, top
from . import delete
from .manifest import Manifest

#: Chunks, characters of text, and tokens, of a shard.
SHARD, CHARACTERS, TOKENS = 2048, 4 << 20, 1 << 20

#: Tokens of a bucket, up to so many buckets; shards whose postings of a bucket go to one file.
BUCKET, BUCKETS, TOGETHER = 1 << 19, 4096, 1024

#: Questions that are answered together.
QUESTIONS = 256


def _invert(batches: Iterator) -> Iterator:
    """Of rows (chunk_id, ..., t) in a task, cut into shards: the rows without t in the order of their ids, with doc and len,
    and the shard's postings; kind tells them apart. Shards are numbered within the task's own range."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        tokens = np.concatenate([[0], np.cumsum(np.diff(batch.column("t").offsets.to_numpy()))])
        at = 0
        while at < batch.num_rows:
            # As many rows as stay below TOKENS, one at least.
            end = max(at + 1, min(at + SHARD, int(np.searchsorted(tokens, tokens[at] + TOKENS, "right")) - 1))
            table = pa.Table.from_batches([batch.slice(at, end - at)]).sort_by("chunk_id").combine_chunks()
            postings, sizes = inverted(table["t"].chunk(0), 0)
            m = table.num_rows
            rows = table.drop_columns("t").append_column("doc", pa.array(np.arange(m, dtype=np.int32))).append_column("len", pa.array(sizes.astype(np.int32))).append_column("kind", pa.array(["docs"] * m)).append_column("shard", pa.array(np.full(m, number)))
            postings = postings.set_column(postings.schema.get_field_index("shard"), "shard", pa.array(np.full(postings.num_rows, number))).append_column("kind", pa.array(["postings"] * postings.num_rows))
            names = [*rows.column_names, *[c for c in postings.column_names if c not in rows.column_names]]
            yield from pa.concat_tables([rows, postings], promote_options="default").select(names).combine_chunks().to_batches()
            at, number = end, number + 1


def _best(k: int, k1: float, b: float, mean_len: float):
    """The k best chunks of a shard for each of some questions, from the postings of all their terms."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        questions, docs, scores = best(table, k, k1, b, mean_len)
        m = len(questions)
        return pa.table({"query_id": pa.array(questions, table.schema.field("asked").type.value_type.field("query_id").type), "segment": pa.array([table["segment"][0].as_py()] * m, pa.string()), "shard": pa.array(np.full(m, table["shard"][0].as_py(), np.int32)), "doc": docs, "score": scores})

    return run


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


class LexicalIndex:
    """BM25 over chunks (chunk_id, text, ...) that come in batches. Each chunk_id is added once."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = 4):
        if fanout < 2:
            raise ValueError("fanout must be at least 2")
        self.spark, self.path, self.fanout = spark, path.rstrip("/"), fanout
        self.manifest = Manifest(spark, path)
        self._mean: tuple[object, float] | None = None

    def segments(self) -> list[dict]:
        return self.manifest.read()[1]

    def _table(self, name: str, segments: list[dict]) -> DataFrame:
        """A table of some segments, each row with its segment's name."""
        one = lambda s: self.spark.read.parquet(f"{self.path}/{s['name']}/{name}").withColumn("segment", F.lit(s["name"]))
        df = one(segments[0])
        for s in segments[1:]:
            df = df.unionByName(one(s), allowMissingColumns=True)
        return df

    def _write(self, postings: DataFrame, name: str, level: int, docs: int, tokens: int, shards: int) -> dict:
        """Write the postings of a segment of that size; its docs are written already."""
        buckets, ranges = min(BUCKETS, 1 + tokens // BUCKET), 1 + (shards - 1) // TOGETHER
        # A frequent term has postings in every shard; ranges of shards part them.
        rows = postings.withColumn("bucket", _bucket(buckets)).repartition(buckets * ranges, "bucket", F.floor(F.col("shard") / TOGETHER)).sortWithinPartitions("bucket", "term", "shard")
        rows.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/{name}/postings")
        return {"name": name, "level": level, "docs": docs, "tokens": tokens, "shards": shards, "buckets": buckets}

    def _shards(self, chunks: DataFrame, path: str) -> tuple[DataFrame, list]:
        """Write the rows of the shards that tasks make of the chunks they read, see _invert; with the size of each shard."""
        each = chunks.withColumn("t", terms(F.col("text"))).withColumn("_chars", F.length("text")).drop("text")
        kept = [f for f in each.schema if f.name != "t"]
        columns = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "doc int, len int, kind string, shard long", POSTINGS.replace("shard int, ", "")])
        rows = each.select(*[f.name for f in kept], "t").mapInArrow(_invert, columns)
        rows.write.mode("overwrite").option("compression", "zstd").partitionBy("kind").parquet(path)
        work = self.spark.read.schema(rows.schema).parquet(path)
        sizes = work.filter("kind = 'docs'").groupBy("shard").agg(F.count("*").alias("docs"), F.sum("len").alias("tokens"), F.coalesce(F.sum("_chars"), F.lit(0)).alias("chars"))
        return work, sorted(sizes.collect())  # one for some thousand chunks

    def add(self, chunks: DataFrame) -> None:
        """Index a batch as a new segment; nothing that is indexed already is read. Then tiers that are full are merged.

        Columns besides chunk_id and text are kept for filters; they may not be named like those of the index's tables. A
        null or empty text is a chunk without terms. An empty batch changes nothing."""
        name = f"segment-{uuid.uuid4().hex}"
        # A task makes shards of the texts that it reads, so none is dealt out, and texts are read once.
        work, made = self._shards(chunks, f"{self.path}/{name}/work")
        if not made:
            delete(self.spark, f"{self.path}/{name}")
            return
        docs, tokens, chars = (sum(r[c] for r in made) for c in ("docs", "tokens", "chars"))
        few = max(-(-docs // SHARD), -(-chars // CHARACTERS), self.spark.sparkContext.defaultParallelism)
        if len(made) > 2 * few:
            # Each task leaves an unfilled shard: where most are, fewer tasks make them anew.
            work, made = self._shards(chunks.coalesce(few), f"{self.path}/{name}/work")
        own = [c for c in chunks.columns if c != "text"]
        dense = F.broadcast(self.spark.createDataFrame([(r["shard"], i) for i, r in enumerate(made)], "shard long, dense int"))
        numbered = lambda kind: work.filter(F.col("kind") == kind).join(dense, "shard").drop("shard").withColumnRenamed("dense", "shard")
        ours = numbered("docs").select(*own, "shard", "doc", "len").coalesce(max(1, len(made) // 64))
        ours.write.parquet(f"{self.path}/{name}/docs")
        postings = numbered("postings").select("term", "n", "shard", "wide", "docs", "tfs", "blocks", "max_tf", "min_len")
        segment = self._write(postings, name, 0, docs, tokens, len(made))
        delete(self.spark, f"{self.path}/{name}/work")
        self.manifest.change(lambda parts: [*parts, segment])
        while self.merge():
            pass

    def merge(self) -> bool:
        """Merge the segments of the lowest tier that has `fanout` of them into one of the next tier: their shards are
        renumbered, postings are copied as they are. Returns whether there was such a tier. A chunk is so rewritten once for
        each tier, about log n times. Readers that opened the old manifest lose the merged folders."""
        parts = self.segments()
        for level in sorted({s["level"] for s in parts}):
            these = [s for s in parts if s["level"] == level]
            if len(these) < self.fanout:
                continue
            name, shift, at = f"segment-{uuid.uuid4().hex}", [], 0
            for s in these:
                shift.append(F.lit(s["name"]))
                shift.append(F.lit(at))
                at += s["shards"]
            moved = lambda t: self._table(t, these).withColumn("shard", (F.col("shard") + F.element_at(F.create_map(*shift), F.col("segment"))).cast("int")).drop("segment")
            moved("docs").write.parquet(f"{self.path}/{name}/docs")
            segment = self._write(moved("postings").drop("bucket"), name, level + 1, *[sum(s[c] for s in these) for c in ("docs", "tokens", "shards")])
            names = {s["name"] for s in these}
            kept = self.manifest.change(lambda now: [*[s for s in now if s["name"] not in names], segment] if names <= {s["name"] for s in now} else None)[1]
            if segment["name"] not in {s["name"] for s in kept}:
                delete(self.spark, f"{self.path}/{name}")  # another writer merged them
                return True
            for old in names:
                delete(self.spark, f"{self.path}/{old}")
            return True
        return False

    def _idf(self, n_docs: int, idf: str):
        df = F.col("df")
        return F.log((n_docs - df + 0.5) / (df + 0.5)) if idf == "okapi_eps" else F.log(1 + (n_docs - df + 0.5) / (df + 0.5))

    def _mean_idf(self, segments: list[dict], n_docs: int) -> float:
        """The mean over all terms, of their counts alone; kept for the manifest it was made for."""
        names = tuple(sorted(s["name"] for s in segments))
        if self._mean is None or self._mean[0] != names:
            df = self._table("postings", segments).filter(F.col("term") != ALL).groupBy("term").agg(F.sum("n").alias("df"))
            self._mean = (names, df.agg(F.avg(self._idf(n_docs, "okapi_eps"))).first()[0] or 0.0)
        return self._mean[1]

    def search(self, queries: DataFrame, k: int = 5, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, idf: str = "okapi_eps", keep_zero: bool = True, wanted: dict[str, str] | None = None) -> DataFrame:
        """The rows that retrieval.bm25 gives over all chunks: (query_id, chunk_id, score, rank).

        Of the postings only the buckets of terms that are asked for are read. Each row meets the questions that ask for its
        term, in groups of QUESTIONS, and a task scores one shard for one group at a time; k rows of each leave it.
        """
        if k < 1 or idf not in ("okapi_eps", "lucene"):
            raise ValueError("k must be at least 1, and idf okapi_eps or lucene")
        segments = self.segments()
        kind = queries.schema["query_id"].dataType.simpleString()
        if not segments:
            return self.spark.createDataFrame([], f"query_id {kind}, chunk_id string, score double, rank int")
        n_docs, tokens = sum(s["docs"] for s in segments), sum(s["tokens"] for s in segments)
        asked = queries.select("query_id", F.explode(terms(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
        number = queries.count()
        groups = max(1, -(-number // QUESTIONS))
        ours = None
        for size in sorted({s["buckets"] for s in segments}):
            # The row of a shard's lengths is always asked for.
            met = [r[0] for r in asked.select("term").union(asked.sparkSession.range(1).select(F.lit(ALL))).select(_bucket(size)).distinct().collect()] if size > 1 else [0]  # as many as there are buckets, at most
            some = self._table("postings", [s for s in segments if s["buckets"] == size]).filter(F.col("bucket").isin(met)).drop("bucket")
            ours = some if ours is None else ours.unionByName(some)
        weight = self._idf(n_docs, idf)
        if idf == "okapi_eps":
            weight = F.when(weight < 0, epsilon * self._mean_idf(segments, n_docs)).otherwise(weight)
        wished = narrow(asked.select("term").distinct(), number)
        known = ours.select("term", "n").join(wished, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
        weights = asked.join(known, "term").withColumn("weight", F.col("times") * weight).withColumn("group", F.pmod(F.xxhash64("query_id"), F.lit(groups)))
        grouped = by_group(weights, groups, number)
        hits = ours.join(grouped, "term").drop("n")
        found = hits.groupBy("segment", "shard", "group").applyInArrow(_best(k, k1, b, tokens / n_docs if tokens else 1.0), f"query_id {kind}, segment string, shard int, doc int, score double")
        near = at_least(found, k)
        docs = self._table("docs", segments)
        scores = near.join(docs.select("segment", "shard", "doc", "chunk_id"), ["segment", "shard", "doc"]).select("query_id", "chunk_id", "score")
        if keep_zero:
            # Read for the filling and the ranking; the chunks are scored once.
            scores = fill_zero(_cut(scores), queries, docs.select("chunk_id"), k)
        out = top(scores, k)
        if wanted:
            out = out.join(match_filter(docs, wanted).select("chunk_id").distinct(), "chunk_id", "left_semi")
        return out.select("query_id", "chunk_id", "score", "rank")

