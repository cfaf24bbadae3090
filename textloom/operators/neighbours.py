"""Exact nearest neighbours between blocks of vectors, as a task sees them.

A block is (ids, dims, odd, data): vectors of one length as 64-bit numbers, in the order of their ids. dims -1: vectors that are
null or hold a null, whose scores are null. odd: vectors with entries that aren't finite or are very large. Scores are summed in
the order of the entries, as the column expressions of retrieval do; a matrix product only picks the pairs that can be among
the best, within a bound on its rounding.
"""

from __future__ import annotations

from collections.abc import Iterator

#: Vectors of a block of the index, and of the questions.
BLOCK, QUESTIONS = 4096, 1024
KINDS = "dims int, odd boolean, data binary"


def order(i):
    """Ids as Spark sorts them."""
    return (i is not None, i)


def blocks_of(ids: list, vectors, size: int, copies: int | None = None) -> Iterator[tuple]:
    """The blocks of some rows (a list array of vectors); of equal vectors in a block only the first `copies` stay."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    x = pc.cast(vectors, pa.list_(pa.float64()))
    lengths = pc.fill_null(pc.list_value_length(x), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = x.flatten()
    values = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)
    gone = np.asarray(pc.is_null(flat).to_numpy(zero_copy_only=False), bool)
    large = ~(np.abs(values) < 1e150)
    starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    held = lambda marks: np.concatenate([[0], np.cumsum(marks)])
    some = lambda sums: sums[starts + np.maximum(lengths, 0)] - sums[starts] > 0
    dims = np.where((lengths < 0) | some(held(gone)), -1, lengths)
    odd = some(held(large)) & (dims >= 0)
    for d in np.unique(dims):
        for o in (False, True):
            rows = sorted(np.flatnonzero((dims == d) & (odd == o)).tolist(), key=lambda i: order(ids[i]))
            for at in range(0, len(rows), size):
                these = np.array(rows[at : at + size])
                m = values[starts[these][:, None] + np.arange(max(d, 0))] if d > 0 else np.zeros((len(these), 0))
                if copies is not None and len(these) > copies:
                    keep = first_copies(m, copies)
                    these, m = these[keep], m[keep]
                yield [ids[i] for i in these], int(d), o, np.ascontiguousarray(m, "<f8").tobytes()


def first_copies(m, copies: int):
    """The places of the first `copies` of each distinct row."""
    import numpy as np

    if m.shape[1] == 0:
        return np.arange(min(len(m), copies))
    _, of = np.unique(np.ascontiguousarray(m).view(np.dtype((np.void, m.shape[1] * 8))).ravel(), return_inverse=True)
    by = np.argsort(of, kind="stable")
    group = of[by]
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    place = np.arange(len(by)) - np.repeat(begin, np.diff(np.append(begin, len(by))))
    return np.sort(by[place < copies])


def summed(p, q):
    """Sums of products of two arrays over their last axis, in its order."""
    import numpy as np

    s = np.zeros(np.broadcast_shapes(p.shape[:-1], q.shape[:-1]))
    for j in range(min(p.shape[-1], q.shape[-1])):
        s = s + p[..., j] * q[..., j]
    return s


def score(q, x, distance: str):
    """Scores of pairs of vectors along the last axis; q and x may differ in length by cosine only."""
    import numpy as np

    with np.errstate(all="ignore"):
        if distance == "euclid":
            d = q - x
            return -np.sqrt(summed(d, d))
        s = summed(q, x)
        if distance == "dot":
            return s
        size = np.sqrt(summed(q, q)) * np.sqrt(summed(x, x))
        return np.where(size == 0, 0.0, s / np.where(size == 0, 1.0, size))


def candidates(q, x, k: int, distance: str, least, of=None):
    """(places in q, places in x, scores) of the pairs that can be among the k best of each q; `least` has the k-th best score
    that is known of each, -inf where there is none. Both hold finite vectors of one length. `of` marks the pairs that count,
    k or more of each q; None: all."""
    import numpy as np

    sizes = lambda m: np.sqrt((m * m).sum(1))
    a, b = sizes(q), sizes(x)
    if distance == "cosine":
        unit = lambda m, n: np.divide(m, n[:, None], out=np.zeros_like(m), where=n[:, None] > 0)
        near, slack, worst = unit(q, a) @ unit(x, b).T, np.full(len(q), 1e-9), least
    elif distance == "dot":
        near, slack, worst = q @ x.T, 1e-13 * (q.shape[1] + 8) * a * b.max(initial=0), least
    else:
        near = 2 * (q @ x.T) - (x * x).sum(1)[None] - (q * q).sum(1)[:, None]
        slack, worst = 1e-13 * (q.shape[1] + 8) * (a + b.max(initial=0)) ** 2, -(least * least)
    if of is not None:
        near = np.where(of, near, -np.inf)
    if len(x) > k and not np.isfinite(least).all():
        own = np.isinf(least)
        worst = worst.copy()
        worst[own] = np.partition(near[own], len(x) - k, axis=1)[:, len(x) - k] if own.any() else worst[own]
    met = near >= (worst - 2 * slack)[:, None]
    qi, xi = np.nonzero(met if of is None else met & of)
    return qi, xi, score(q[qi], x[xi], distance)


class Best:
    """The k best rows of each question so far, as (class, -score, id): not a number first and null last, as Spark sorts."""

    def __init__(self, k: int, distance: str, threshold: float = 0.0):
        self.k, self.distance, self.threshold, self.held = k, distance, threshold, {}

    def least(self, keys: list):
        import numpy as np

        last = [h[-1] if len(h := self.held.get(q, [])) == self.k else (2, 0.0, None) for q in keys]
        return np.array([-v if kind == 1 else (-np.inf if kind == 2 else np.inf) for kind, v, _ in last])

    def _merge(self, key, rows: list[tuple]) -> None:
        if self.threshold:
            rows = [r for r in rows if r[0] == 0 or r[0] == 1 and -r[1] >= self.threshold]
        if rows:
            self.held[key] = sorted([*self.held.get(key, []), *rows], key=lambda r: (r[0], r[1], order(r[2])))[: self.k]

    def meet(self, keys: list, q, ids: list, x, of=None) -> None:
        """Finite vectors of one length; `of` marks the pairs that count, as in candidates()."""
        qi, xi, s = candidates(q, x, self.k, self.distance, self.least(keys), of)
        at = 0
        for i, n in zip(*(c.tolist() for c in _counts(qi))):
            self._merge(keys[i], [(1, -v, ids[j]) for j, v in zip(xi[at : at + n].tolist(), s[at : at + n].tolist())])
            at += n

    def meet_odd(self, keys: list, q, ids: list, x) -> None:
        """Vectors of any kind; None for those without scores."""
        import numpy as np

        none = q is None or x is None or (self.distance != "cosine" and q.shape[1] != x.shape[1])
        for i, key in enumerate(keys):
            if none:
                self._merge(key, [(2, 0.0, j) for j in ids[: self.k]])
                continue
            s = score(q[i][None], x, self.distance)
            kind = np.where(np.isnan(s), 0, 1)
            first = np.lexsort((np.arange(len(s)), -np.where(np.isnan(s), 0.0, s), kind))[: self.k]
            self._merge(key, [(int(kind[j]), 0.0 if kind[j] == 0 else -float(s[j]), ids[j]) for j in first])

    def rows(self, number_of=lambda key: key) -> Iterator[tuple]:
        for key, held in self.held.items():
            for kind, v, i in held:
                yield number_of(key), i, (float("nan"), -v, None)[kind]


def _counts(sorted_places):
    import numpy as np

    return np.unique(sorted_places, return_counts=True)


def matrix(dims: int, data: bytes, n: int):
    import numpy as np

    return None if dims < 0 else np.frombuffer(data, "<f8").reshape(n, dims)


def packer(size: int, copies: int | None = None):
    """A function for mapInArrow that turns (id, vector) into blocks (ids, dims, odd, data)."""

    def run(batches):
        import pyarrow as pa

        held, rows = [], 0

        def made():
            table = pa.Table.from_batches(held).combine_chunks()
            ids, kind = table.column(0).combine_chunks(), table.schema.field(0).type
            out = list(zip(*blocks_of(ids.to_pylist(), table.column(1).combine_chunks(), size, copies)))
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.list_(kind)), pa.array(out[1], pa.int32()), pa.array(out[2], pa.bool_()), pa.array(out[3], pa.binary())], ["ids", "dims", "odd", "data"])

        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                held.append(part)
                rows += part.num_rows
                if rows >= size:
                    yield made()
                    held, rows = [], 0
        if rows:
            yield made()

    return run


def finder(k: int, distance: str, threshold: float = 0.0):
    """A function for mapInArrow over pairs of blocks (ids, dims, odd, data) and questions (q_ids, q_dims, q_odd, q_data,
    q_block): the k best of each question in the task."""

    def run(batches):
        import pyarrow as pa

        best, names, kinds = Best(k, distance, threshold), {}, None
        for batch in batches:
            kinds = [batch.schema.field(c).type.value_type for c in ("q_ids", "ids")]
            for i in range(batch.num_rows):
                v = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                keys = [(v["q_block"], j) for j in range(len(v["q_ids"]))]
                names[v["q_block"]] = v["q_ids"]
                q, x = matrix(v["q_dims"], v["q_data"], len(keys)), matrix(v["dims"], v["data"], len(v["ids"]))
                plain = not v["odd"] and not v["q_odd"] and v["dims"] == v["q_dims"] >= 0
                (best.meet if plain else best.meet_odd)(keys, q, v["ids"], x)
        if kinds:
            rows = list(best.rows(lambda key: names[key[0]][key[1]]))
            for at in range(0, len(rows), 100_000):
                out = list(zip(*rows[at : at + 100_000]))
                yield pa.RecordBatch.from_arrays([pa.array(out[0], kinds[0]), pa.array(out[1], kinds[1]), pa.array(out[2], pa.float64())], ["query_id", "chunk_id", "score"])

    return run
