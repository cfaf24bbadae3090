"""Approximate nearest neighbours: inverted lists of product-quantised vectors, fitted on a bounded sample, with exact
scores for what survives.

Layout under a path: model, manifest/, and for each segment blocks (list, block, ids, codes, vectors): up to BLOCK vectors of
one list, which is a folder of its own.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import neighbours, retrieval
from ..operators.retrieval import match_filter, top
from .manifest import Manifest

#: Vectors of a block, questions that meet a block together, and places of a codebook.
BLOCK, QUESTIONS, CODES = 4096, 1024, 256


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 15) -> np.ndarray:
    """k centres (fewer if there are fewer different rows); a centre without rows moves to the row that is farthest off."""
    centres = np.unique(x, axis=0)
    if len(centres) <= k:
        return centres
    centres = centres[rng.choice(len(centres), k, replace=False)].copy()
    for _ in range(rounds):
        off = (centres**2).sum(1) - 2 * x @ centres.T
        of = off.argmin(1)
        n = np.bincount(of, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
        if (n == 0).any():
            far = np.argsort(-(off[np.arange(len(x)), of] + (x**2).sum(1)))[: int((n == 0).sum())]
            centres[n == 0] = x[far]
    return centres


class Model:
    """Centres of the lists, and for each of `parts` slices of what is left of a vector a codebook."""

    def __init__(self, distance: str, centres: np.ndarray, books: np.ndarray, probes: int):
        self.distance, self.centres, self.books, self.probes = distance, centres, books, probes

    @property
    def dims(self) -> int:
        return self.centres.shape[1]

    def prepared(self, x: np.ndarray) -> np.ndarray:
        """For cosine, vectors of length 1 (zero vectors stay)."""
        if self.distance != "cosine":
            return x
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, size, out=np.zeros_like(x), where=size > 0)

    def lists(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of each row, nearest first."""
        off = (self.centres**2).sum(1) - 2 * x @ self.centres.T
        return np.argsort(off, axis=1, kind="stable")[:, :n]

    def encode(self, x: np.ndarray, of: np.ndarray) -> np.ndarray:
        left = (x - self.centres[of]).reshape(len(x), len(self.books), -1)
        off = (self.books**2).sum(2)[None] - 2 * np.einsum("npd,pcd->npc", left, self.books)
        return off.argmin(2).astype(np.uint8)

    def nearest(self, q: np.ndarray, of: int, codes: np.ndarray, keep: int) -> np.ndarray:
        """Which coded vectors of a list are among the `keep` nearest of each question, by coded distance."""
        x = self.centres[of] + self.books[np.arange(len(self.books)), codes].reshape(len(codes), -1)
        off = (x * x).sum(1) - 2 * q @ x.T
        return off <= np.partition(off, keep - 1, axis=1)[:, keep - 1 : keep]


def fit(sample: np.ndarray, rows: int, distance: str = "cosine", parts: int = 16, recall: float = 0.95, k: int = 10, seed: int = 7) -> Model:
    """A model for about `rows` vectors from a sample of them: as many lists as half the root of rows (of the sample's rows /
    8 at most), and as many probes as the sample needs so that `recall` of the true k neighbours of 200 of its rows lie in
    lists that are probed."""
    rng, d = np.random.default_rng(seed), sample.shape[1]
    parts = max(p for p in range(1, min(parts, d) + 1) if d % p == 0)
    model = Model(distance, np.zeros((1, d)), np.zeros((parts, 1, d // parts)), 1)
    x = model.prepared(sample)
    model.centres = k_means(x, max(1, min(int(rows**0.5 / 2), len(x) // 8)), rng)
    of = model.lists(x, 1)[:, 0]
    left = (x - model.centres[of]).reshape(len(x), parts, -1)
    books = [k_means(left[:, p], CODES, rng) for p in range(parts)]
    wide = max(len(b) for b in books)
    model.books = np.stack([np.concatenate([b, np.repeat(b[:1], wide - len(b), axis=0)]) for b in books])
    asked = rng.choice(len(x), min(200, len(x)), replace=False)
    near = np.argsort((x**2).sum(1) - 2 * x[asked] @ x.T, axis=1)[:, :k]
    place = np.argsort(model.lists(x[asked], len(model.centres)), axis=1)
    needed = np.sort(np.take_along_axis(place, of[near], axis=1).ravel())
    model.probes = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1
    return model


def _matrix(column, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors are whole (of dims entries, all finite), and those."""
    import pyarrow as pa
    import pyarrow.compute as pc

    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    right = size == dims
    x = pc.cast(column.filter(pa.array(right)).flatten(), pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
    finite = np.isfinite(x).all(1)
    right[np.flatnonzero(right)[~finite]] = False
    return right, x[finite]


class VectorIndex:
    """Nearest neighbours among (chunk_id, vector) that come in batches; each chunk_id is added once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifest = Manifest(spark, path)
        self._model: Model | None = None

    def model(self) -> Model:
        if self._model is None:
            r = self.spark.read.parquet(f"{self.path}/model").first()
            centres, books = np.frombuffer(r.centres).reshape(-1, r.dims), np.frombuffer(r.books)
            self._model = Model(r.distance, centres, books.reshape(r.parts, -1, r.dims // r.parts), r.probes)
        return self._model

    def create(self, vectors: DataFrame, distance: str = "cosine", rows: int = 20_000, parts: int = 16, recall: float = 0.95, k: int = 10) -> Model:
        """Fit the model on at most `rows` of the vectors, by a hash of chunk_id, and keep it. The driver gets that sample and
        no more. All vectors have as many entries as most of the sample's."""
        if distance not in ("cosine", "euclid"):
            raise ValueError("distance must be cosine or euclid")
        n = vectors.count()
        h = F.xxhash64("chunk_id")
        share = min(1.0, (rows + 6 * rows**0.5 + 10) / max(1, n))
        some = vectors.filter(h <= F.lit(int(-(2**63) + share * (2**64 - 1) * (1 - 2**-50)))).orderBy(h).limit(rows).select("vector").toArrow()
        column = some["vector"].combine_chunks()
        sizes = [len(v) for v in column.to_pylist() if v]
        if not sizes:
            raise ValueError("there are no vectors to fit on")
        x = _matrix(column, max(set(sizes), key=lambda s: (sizes.count(s), s)))[1]
        m = fit(x, n, distance, parts, recall, k)
        row = (distance, m.dims, len(m.books), m.probes, bytearray(np.ascontiguousarray(m.centres).tobytes()), bytearray(np.ascontiguousarray(m.books).tobytes()))
        self.spark.createDataFrame([row], "distance string, dims int, parts int, probes int, centres binary, books binary").coalesce(1).write.parquet(f"{self.path}/model")
        self._model = m
        return m

    def add(self, vectors: DataFrame) -> None:
        """Index a batch; every row is coded and kept. Nothing that is indexed already is read. Rows whose vector is null, of
        another size or not finite are left out."""
        m, name = self.model(), f"segment-{uuid.uuid4().hex}"
        kind = vectors.schema["chunk_id"].dataType.simpleString()
        dims = m.dims

        def coded(batches):
            import pyarrow as pa

            for batch in (b.slice(at, BLOCK) for b in batches for at in range(0, b.num_rows, BLOCK)):
                mask, raw = _matrix(batch.column(1), dims)
                x = m.prepared(raw)
                of = m.lists(x, 1)[:, 0]
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(mask)), pa.array(of.astype(np.int32)), pa.array([c.tobytes() for c in m.encode(x, of)], pa.binary()), pa.array([v.tobytes() for v in raw.astype("<f4")], pa.binary())], ["chunk_id", "list", "code", "vector"])

        def packed(batches):
            import pyarrow as pa

            held, of = [], None
            schema = pa.schema([("list", pa.int32()), ("ids", pa.list_(batch_type)), ("codes", pa.binary()), ("vectors", pa.binary())])
            flush = lambda: pa.RecordBatch.from_pydict({"list": [of], "ids": [[h[0] for h in held]], "codes": [b"".join(h[1] for h in held)], "vectors": [b"".join(h[2] for h in held)]}, schema)
            for batch in batches:
                for i, number, code, vector in zip(*(batch.column(c).to_pylist() for c in ("chunk_id", "list", "code", "vector"))):
                    if held and (number != of or len(held) == BLOCK):
                        yield flush()
                        held = []
                    of = number
                    held.append((i, code, vector))
            if held:
                yield flush()

        from pyspark.sql.pandas.types import to_arrow_type

        batch_type = to_arrow_type(vectors.schema["chunk_id"].dataType)
        rows = vectors.select("chunk_id", "vector").mapInArrow(coded, f"chunk_id {kind}, list int, code binary, vector binary")
        # A list that very many vectors are near to is dealt over several tasks.
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.repartition(n, "list", F.pmod(F.xxhash64("chunk_id"), F.lit(8))).sortWithinPartitions("list")
        blocks = dealt.mapInArrow(packed, f"list int, ids array<{kind}>, codes binary, vectors binary")
        blocks.withColumn("block", F.monotonically_increasing_id()).write.partitionBy("list").parquet(f"{self.path}/{name}")
        self.manifest.change(lambda parts: [*parts, {"name": name}])

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, depth: int = 20, wanted: dict[str, str] | None = None, attributes: DataFrame | None = None) -> DataFrame:
        """(query_id, chunk_id, score, rank) of a stated query set (query_id, q_vector), with exact scores.

        Blocks of questions meet blocks of vectors, in which those of a list lie together, and a question meets its nearest
        lists only; others aren't read. Of a list in a block the best depth * k by coded distance (and those that tie with the
        last) are scored exactly, all if it has no more; a task keeps k of each question, and only these are dealt out. Where
        all lists are probed and no list in a block can hold more, it is the search of retrieval.dense. wanted filters by columns
        of attributes (chunk_id, ...) after the cut to k, as an index without them does.
        """
        if k < 1 or depth < 1:
            raise ValueError("k and depth must be at least 1")
        m, kind = self.model(), queries.schema["query_id"].dataType.simpleString()
        segments = self.manifest.read()[1]
        if not segments:
            return self.spark.createDataFrame([], f"query_id {kind}, chunk_id string, score double, rank int")
        tables = [self.spark.read.parquet(f"{self.path}/{s['name']}").withColumn("segment", F.lit(i)) for i, s in enumerate(segments)]
        blocks = tables[0]
        for t in tables[1:]:
            blocks = blocks.unionByName(t)
        id_type = blocks.schema["ids"].dataType.elementType.simpleString()
        count, dims, keep = min(probes or m.probes, len(m.centres)), m.dims, depth * k

        def probed(batches):
            import pyarrow as pa

            for batch in batches:
                near = m.lists(m.prepared(_matrix(batch.column(0), dims)[1]), count)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(near).astype(np.int32))], ["list"])

        def asking(batches):
            import pyarrow as pa

            for batch in batches:
                mask, raw = _matrix(batch.column(1), dims)
                keys = batch.column(0).filter(pa.array(mask))
                for at in range(0, len(raw), QUESTIONS):
                    some = raw[at : at + QUESTIONS]
                    yield pa.RecordBatch.from_arrays([pa.array([keys.slice(at, QUESTIONS).to_pylist()], pa.list_(keys.type)), pa.array([some.tobytes()], pa.binary())], ["q_ids", "q"])

        def vectors(batches):
            import pyarrow as pa

            for batch in batches:
                for ids, held in zip(batch.column(0), batch.column(1)):
                    x = pa.array(np.frombuffer(held.as_py(), "<f4"))
                    yield pa.RecordBatch.from_arrays([ids.values, pa.FixedSizeListArray.from_arrays(x, dims).cast(pa.list_(pa.float32()))], ["chunk_id", "vector"])

        def gathered(batches):
            import pyarrow as pa

            held, rows = [], 0

            def made():
                ids = [i for h in held for i in h[1]]
                of = np.concatenate([np.full(len(h[1]), h[0], np.int32) for h in held])
                codes = np.concatenate([np.frombuffer(h[2], np.uint8).reshape(len(h[1]), -1) for h in held])
                x = np.concatenate([np.frombuffer(h[3], "<f4").reshape(-1, dims) for h in held])
                by = sorted(range(len(ids)), key=lambda j: (of[j], neighbours.order(ids[j])))
                return pa.RecordBatch.from_arrays([pa.array([of[by].tobytes()], pa.binary()), pa.array([[ids[j] for j in by]], pa.list_(kinds)), pa.array([codes[by].tobytes()], pa.binary()), pa.array([x[by].tobytes()], pa.binary())], ["lists", "ids", "codes", "vectors"])

            for batch in batches:
                kinds = batch.schema.field("ids").type.value_type
                for row in zip(*(batch.column(c).to_pylist() for c in ("list", "ids", "codes", "vectors"))):
                    held.append(row)
                    rows += len(row[1])
                    if rows >= BLOCK:
                        yield made()
                        held, rows = [], 0
            if held:
                yield made()

        def scored(batches):
            import pyarrow as pa

            best, kinds, names, asks = neighbours.Best(k, m.distance), None, {}, {}
            for batch in batches:
                kinds = [batch.schema.field(c).type.value_type for c in ("q_ids", "ids")]
                for i in range(batch.num_rows):
                    block, q = batch.column("q_block")[i].as_py(), np.frombuffer(batch.column("q")[i].as_py()).reshape(-1, dims)
                    if block not in names:
                        # Who asks for a list: a bit for each question.
                        names[block] = batch.column("q_ids")[i].as_py()
                        probe = np.zeros((len(m.centres), len(q)), bool)
                        probe[m.lists(m.prepared(q), count), np.arange(len(q))[:, None]] = True
                        asks[block] = np.packbits(probe, axis=1)
                    of, ids = np.frombuffer(batch.column("lists")[i].as_py(), np.int32), batch.column("ids")[i].as_py()
                    x = np.frombuffer(batch.column("vectors")[i].as_py(), "<f4").reshape(-1, dims).astype(float)
                    codes = np.frombuffer(batch.column("codes")[i].as_py(), np.uint8).reshape(len(ids), -1)
                    starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                    for start, end in zip(starts.tolist(), np.append(starts[1:], len(of)).tolist()):
                        who = np.flatnonzero(np.unpackbits(asks[block][of[start]], count=len(q)))
                        if not len(who):
                            continue
                        near = m.nearest(m.prepared(q[who]), int(of[start]), codes[start:end], keep) if end - start > keep else None
                        best.meet([(block, j) for j in who.tolist()], q[who], ids[start:end], x[start:end], near)
            if kinds:
                rows = list(best.rows(lambda key: names[key[0]][key[1]]))
                for at in range(0, len(rows), 100_000):
                    out = list(zip(*rows[at : at + 100_000]))
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], kinds[0]), pa.array(out[1], kinds[1]), pa.array(out[2], pa.float64())], ["query_id", "chunk_id", "score"])

        if count == len(m.centres) and keep >= BLOCK:
            whole = blocks.select("ids", "vectors").mapInArrow(vectors, f"chunk_id {id_type}, vector array<float>")
            packed = whole.mapInArrow(neighbours.packer(neighbours.BLOCK, k), f"ids array<{id_type}>, {neighbours.KINDS}")
            right = queries.filter(F.size("q_vector") == dims).filter(F.forall("q_vector", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))
            best = top(retrieval.among(right, packed, k, m.distance), k)
        else:
            lists = [r[0] for r in queries.select("q_vector").mapInArrow(probed, "list int").distinct().collect()]  # as many as there are lists, at most
            number = queries.count()
            dealt = queries.select("query_id", "q_vector").repartition(max(1, -(-number // (8 * QUESTIONS))), F.xxhash64("query_id"))
            asked = dealt.mapInArrow(asking, f"q_ids array<{kind}>, q binary").withColumn("q_block", F.monotonically_increasing_id())
            asked = F.broadcast(asked) if number <= 16 * QUESTIONS else asked
            met = blocks.filter(F.col("list").isin(lists)).select("list", "ids", "codes", "vectors").coalesce(2 * self.spark.sparkContext.defaultParallelism)
            met = met.mapInArrow(gathered, f"lists binary, ids array<{id_type}>, codes binary, vectors binary")
            rows = met.join(asked, F.lit(True)).mapInArrow(scored, f"query_id {kind}, chunk_id {id_type}, score double")
            best = top(rows, k)
        if wanted:
            best = best.join(match_filter(attributes, wanted).select("chunk_id").distinct(), "chunk_id", "left_semi")
        return best.select("query_id", "chunk_id", "score", "rank")


def recall(found: DataFrame, true: DataFrame) -> DataFrame:
    """(query_id, k, recall): of the true neighbours (query_id, chunk_id), the share that was found."""
    hits = true.join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return hits.groupBy("query_id").agg(F.count("*").alias("k"), (F.count("hit") / F.count("*")).alias("recall"))
