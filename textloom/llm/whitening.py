"""Whitening of embeddings by the eigenvectors of their covariance, which is multiplied tile by tile."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_folder, kept, new_folder, partitions

#: x = floor(SCALE * entry) + OFFSET; products beyond EDGE stop there.
SCALE, OFFSET, EDGE = 64, 1_000_000, 2.0**62

#: Rows of a row-block, whose column blocks meet for each tile.
ROWS = 4096

#: A component of less than this share of the largest eigenvalue is rounding.
LEAST = 1e-12


def integers(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have `dims` finite entries, and those as rows of x."""
    right = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False)
    entries = pc.cast(column.filter(right).flatten(), pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
    finite = np.isfinite(entries).all(axis=1)
    mask = np.array(right.to_numpy(zero_copy_only=False), bool)
    mask[np.flatnonzero(mask)[~finite]] = False
    with np.errstate(over="ignore"):
        return mask, np.floor(np.clip(SCALE * entries[finite], -EDGE, EDGE)).astype(np.int64) + OFFSET


def pack(x: np.ndarray) -> list[bytes]:
    """Each row as bytes, two for each entry where that is enough; equal rows, equal bytes."""
    y = x - OFFSET
    small = (np.abs(y) < 1 << 15).all(axis=1)
    short = y.astype("<i2").tobytes() if small.any() else b""
    d = x.shape[1]
    return [short[2 * d * i : 2 * d * (i + 1)] if s else y[i].astype("<i8").tobytes() for i, s in enumerate(small.tolist())]


def unpack(packed: list[bytes], d: int) -> np.ndarray:
    out = np.empty((len(packed), d), np.int64)
    small = np.array([len(p) == 2 * d for p in packed], bool)
    for kind, which in (("<i2", np.flatnonzero(small)), ("<i8", np.flatnonzero(~small))):
        out[which] = np.frombuffer(b"".join([packed[i] for i in which]), kind).reshape(-1, d)
    return out + OFFSET


def _sum(x: np.ndarray) -> np.ndarray:
    """Sums of columns as Python's integers, exact at any size."""
    safe = not len(x) or int(np.abs(x).max()) < 2**62 // len(x)
    return x.sum(axis=0).astype(object) if safe else x.astype(object).sum(axis=0)


def _distinct(dims: int) -> Callable:
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(pack(integers(batch.column(0), dims)[1]), pa.binary())], ["x"])

    return run


def _sums(dims: int) -> Callable:
    def run(batches):
        n, total = 0, np.zeros(dims, object)
        for batch in batches:
            n += batch.num_rows
            total = total + _sum(unpack(batch.column("x").to_pylist(), dims))
        yield pa.RecordBatch.from_pydict({"dim": list(range(-1, dims)), "s": [str(v) for v in (n, *total)]}, pa.schema([("dim", pa.int32()), ("s", pa.string())]))

    return run


def _row_blocks(batches, dims: int) -> Iterator[np.ndarray]:
    held: list[bytes] = []
    for batch in batches:
        held += batch.column("x").to_pylist()
        while len(held) >= ROWS:
            yield unpack(held[:ROWS], dims)
            held = held[ROWS:]
    if held:
        yield unpack(held, dims)


def _column_blocks(dims: int, base: list[int], tile: int) -> Callable:
    """Each row-block's column blocks, once for each tile they belong to, as the shortest integers that hold x - base."""

    def run(batches):
        near, wide = np.array(base, np.int64), -(-dims // tile)
        part = TaskContext.get().partitionId() << 32
        for number, x in enumerate(_row_blocks(batches, dims)):
            blocks = []
            for at in range(0, dims, tile):
                y = x[:, at : at + tile] - near[at : at + tile]
                most = int(np.abs(y).max())
                kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if most < 1 << 8 * int(k[2]) - 1)
                blocks.append((kind, y.astype(kind).tobytes()))
            rows = [(i * wide + j, part + number, side, *blocks[b]) for i in range(wide) for j in range(i, wide) for side, b in enumerate([i, j] if i < j else [i])]
            names, kinds = ["tile", "row_block", "side", "kind", "data"], [pa.int32(), pa.int64(), pa.int8(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def _products(dims: int, delta: list[float], tile: int) -> Callable:
    """Of sorted column blocks, the sum over a task's row-blocks of the product of the two of each tile."""

    def run(batches):
        off, wide = np.array(delta), -(-dims // tile)
        found: dict[int, np.ndarray] = {}
        first = None
        for batch in batches:
            for t, side, kind, data in zip(*(batch.column(c).to_pylist() for c in ("tile", "side", "kind", "data"))):
                i, j = divmod(t, wide)
                at = (j if side else i) * tile
                y = np.frombuffer(data, kind).reshape(-1, min(tile, dims - at)) - off[at : at + tile]
                if side == 0:
                    first = y
                if side == 1 or i == j:
                    product = first.T @ y
                    found[t] = found[t] + product if t in found else product
        for t, product in found.items():
            yield pa.RecordBatch.from_pydict({"tile": [t], "v": [product.ravel()]}, pa.schema([("tile", pa.int32()), ("v", pa.list_(pa.float64()))]))

    return run


def covariance(vectors: DataFrame, dims: int, n: int, sums: list[int], tile: int = 32) -> np.ndarray:
    """The covariance, divisor n, of packed vectors (x) whose columns add up to sums.

    Pairs of column blocks, `tile` wide, are tiles. The column blocks of each row-block are dealt out by tile and row-block;
    each pair is centred and multiplied where it meets, products add up in tasks and then over tasks, and the driver gets
    one number for each pair of dimensions.
    """
    n_tasks, wide = partitions(vectors.sparkSession), -(-dims // tile)
    base = [round(Fraction(s, n)) for s in sums]
    delta = [float(Fraction(s, n) - b) for s, b in zip(sums, base)]
    blocks = vectors.mapInArrow(_column_blocks(dims, base, tile), "tile int, row_block long, side tinyint, kind string, data binary")
    dealt = blocks.repartition(n_tasks, "tile", "row_block").sortWithinPartitions("tile", "row_block", "side").select("tile", "side", "kind", "data")
    parts = dealt.mapInArrow(_products(dims, delta, tile), "tile int, v array<double>").select("tile", F.posexplode("v").alias("cell", "v"))
    out = np.zeros((dims, dims))
    for t, cell, v in parts.groupBy("tile", "cell").agg(F.sum("v")).collect():
        i, j = divmod(t, wide)
        a, b = divmod(cell, min(tile, dims - j * tile))
        out[i * tile + a, j * tile + b] = out[j * tile + b, i * tile + a] = v / n
    return out


class Whitening:
    """n, sums, and the components: eigenvectors as columns, with their eigenvalues and shares of the trace."""

    def __init__(self, dims: int, n: int, sums: list[int], v: np.ndarray, most: int):
        values, vectors = np.linalg.eigh(v)
        order = [i for i in np.argsort(-values) if values[i] > LEAST * values.max() and values[i] > 0][:most]
        self.dims, self.n, self.sums = dims, n, sums
        self.values, self.vectors = values[order], vectors[:, order]
        self.explained = self.values / np.trace(v)
        self.base = np.array([round(Fraction(s, n)) for s in sums], np.int64)
        self.delta = np.array([float(Fraction(s, n) - int(b)) for s, b in zip(sums, self.base)])

    def apply(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.base) - self.delta) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - sum)^2; None beyond a long."""
        if not len(x):
            return []
        if max(int(np.abs(x).max()), 1) * self.n + max(abs(s) for s in self.sums) < 2**62:
            q = self.n * x - np.array(self.sums, np.int64)
            if int(np.abs(q).max()) ** 2 * self.dims < 2**63:
                return (q * q).sum(axis=1).tolist()
        q = self.n * x.astype(object) - np.array(self.sums, object)
        return [v if v < 2**63 else None for v in (q * q).sum(axis=1).tolist()]


def _moments(w: Whitening) -> Callable:
    """Of the whitened vectors of a task, sums of products and, in the row after them, of values."""

    def run(batches):
        k = len(w.values)
        total = np.zeros((k + 1, k))
        for batch in batches:
            y = w.apply(unpack(batch.column("x").to_pylist(), w.dims))
            total += np.vstack([y.T @ y, y.sum(axis=0)])
        yield pa.RecordBatch.from_pydict({"v": [total.ravel()]}, pa.schema([("v", pa.list_(pa.float64()))]))

    return run


def _apply(w: Whitening, key: pa.DataType, error: float) -> Callable:
    def run(batches):
        k = len(w.values)
        for batch in batches:
            mask, x = integers(batch.column(1), w.dims)
            m = len(x)
            ids = batch.column(0).filter(pa.array(mask)).take(pa.array(np.repeat(np.arange(m), k)))
            deviation = pa.array(w.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, w.n)), deviation, pa.array(w.apply(x).ravel()), pa.array(np.tile(w.explained, m)), pa.array(np.full(m * k, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def fit(rows: DataFrame, vector: str = "embedding", most: int = 16, tile: int = 32) -> tuple[Whitening | None, float]:
    """The whitening of the distinct vectors of a table, and the largest entry of (their covariance when whitened - the
    identity); None where no two vectors differ.

    The vectors' size is the one that most rows have, the largest of several. Vectors are compared whole, so each counts
    once however many rows have it, and copies go before they are dealt out. The driver gets sums by dimension and the
    covariance, whose size is the dimensions' alone.
    """
    spark = rows.sparkSession
    only = rows.select(F.col(vector).alias("v"))
    dims = only.groupBy(F.size("v").alias("d")).count().filter("d > 0").orderBy(F.desc("count"), F.desc("d")).first()
    if dims is None:
        return None, 0.0
    d, folder = dims["d"], new_folder(spark, "whitening")
    try:
        vectors = kept(only.filter("v is not null").mapInArrow(_distinct(d), "x binary").distinct(), folder, rows=10_000)
        sums = vectors.mapInArrow(_sums(d), "dim int, s string").groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38, 0)")).alias("s"))
        found = {r["dim"]: int(r["s"]) for r in sums.collect()}
        n = found.get(-1, 0)
        if not n:
            return None, 0.0
        whole = [found[i] for i in range(d)]
        w = Whitening(d, n, whole, covariance(vectors, d, n, whole, tile), most)
        k = len(w.values)
        if not k:
            return None, 0.0
        moments = vectors.mapInArrow(_moments(w), "v array<double>").select(F.posexplode("v").alias("cell", "v")).groupBy("cell").agg(F.sum("v").alias("v"))
        got = np.array([r["v"] for r in moments.orderBy("cell").collect()]).reshape(k + 1, k) / n
        return w, float(np.abs(got[:k] - np.outer(got[k], got[k]) - np.eye(k)).max())
    finally:
        drop_folder(spark, folder)


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = 16, tile: int = 32) -> DataFrame:
    """For each row with a usable vector and each of the `most` first components: vec_id, component (from 1), n, deviation,
    whitened, explained, identity_error.

    Entries c become x = floor(64 * c) + 1000000. All is fitted on the distinct x vectors, n of them, see `fit`. whitened is
    x less its mean, projected on the component, over the root of its eigenvalue; explained is the component's share of
    the trace; deviation is the exact sum of (n * x - sum)^2, null where a long can't hold it.

    Rows go whose vector is null, empty, of another size than most rows', or has an entry that is null, NaN or infinite.
    Entries whose 64-fold passes 2^62 stop there. Repeated rows and null keys stay; other columns don't matter. Components
    without variance have no rows, so an empty table, or one of equal vectors, gives none.
    """
    kind = rows.schema[key].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    w, error = fit(rows, vector, most, tile)
    if w is None:
        return rows.sparkSession.createDataFrame([], schema)
    return rows.select(F.col(key).alias("vec_id"), F.col(vector).alias("v")).filter("v is not null").mapInArrow(_apply(w, kind, error), schema)
