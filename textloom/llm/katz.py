"""A Katz back-off language model of bigrams: Good-Turing discounts, exactly normalised back-off weights, partitioned
tables of counts, and scores by recursion from bigram to word to unknown word.

Texts are cut into slices of about SLICE bytes. A slice asks for its distinct words, in buckets by fingerprint, and each
bucket answers with their training counts and with ids that are small for frequent words; then it asks for its distinct
bigrams, in buckets by the first word (and by the second where the first is frequent), and is answered with their counts
and with what the back-off weight of a first word is made of. Requests and answers are packed arrays, so a distinct word
or bigram of a slice costs a few bytes of shuffle. The buckets keep the model: tables of words and of bigrams partitioned
by bucket, one packed row for each, which open_words and open_bigrams read as rows. Slices are a bucketed table, so their
texts are never dealt out.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import DOCUMENTS, cut, drop_folder, kept, new_folder, partitions, tasks_for  # noqa: F401
from .words import Words, blocks, mix

SLICE = 8 << 20
#: Counts up to this are discounted.
LARGEST = 5
END, BEGIN = np.uint64(0x1D8E4E27C47D124F), np.uint64(0xEB44ACCAB455D165)
_TYPES = ("<u1", "<u2", "<u4", "<u8")


def pack(values: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes that hold the largest, byte plane by byte plane, compressed."""
    import zstandard

    largest = int(values.max()) if len(values) else 0
    k = next(k for k in range(4) if largest < 1 << (8 << k))
    planes = np.ascontiguousarray(values.astype(_TYPES[k])).view(np.uint8).reshape(len(values), 1 << k).T
    return bytes([k]) + zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8)
    width = 1 << data[0]
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(_TYPES[data[0]]).ravel().astype(np.uint64)


#: Taken off every count, however large, so that no first word leaves its unseen successors without probability.
LEAST = 0.01


def pack_sorted(values: np.ndarray) -> bytes:
    """Numbers in ascending order by their differences."""
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def discounts(counts_of: list[int]) -> np.ndarray:
    """d[r] for counts r = 0..LARGEST from the numbers of types seen 1..LARGEST+1 times: Katz's, each where it lies in
    (0, 1), but at most 1 - LEAST / r."""
    n = [0, *counts_of]
    d = np.concatenate([[1.0], 1 - LEAST / np.arange(1, LARGEST + 1)])
    common = (LARGEST + 1) * n[LARGEST + 1] / n[1] if n[1] else 1.0
    for r in range(1, LARGEST + 1):
        if n[r] and common < 1:
            value = ((r + 1) * n[r + 1] / (n[r] * r) - common) / (1 - common)
            if 0 < value < d[r]:
                d[r] = value
    return d


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The counts less what back-off takes from them."""
    c = counts.astype(np.float64)
    return np.where(c <= LARGEST, d[np.minimum(c, LARGEST).astype(np.int64)] * c, c - LEAST)


def taken(n_r: np.ndarray, d: np.ndarray) -> np.ndarray:
    """What is taken from n_r[r-1] types of each count r = 1..LARGEST and n_r[LARGEST] types of larger counts."""
    return sum((1 - d[r]) * r * n_r[r - 1] for r in range(1, LARGEST + 1)) + LEAST * n_r[LARGEST]


class WordModel:
    """Probabilities of words: discounted shares of the training tokens, and one class of unknown words for the rest."""

    def __init__(self, tokens: int, types: int, counts_of: list[int]):
        self.tokens, self.types = tokens, types
        self.d = discounts(counts_of)
        larger = types - sum(counts_of[:LARGEST])
        self.unknown = float(taken(np.array([*counts_of[:LARGEST], larger]), self.d)) / tokens if tokens else 1.0

    def probability(self, counts: np.ndarray) -> np.ndarray:
        """Of words with these counts; a count of 0 stands for the unknown class."""
        return np.where(counts > 0, discounted(counts, self.d) / max(1, self.tokens), self.unknown)


class Slice:
    """The tokens of a slice's texts: words and one end for each text, as places in its sorted distinct words."""

    def __init__(self, texts: list[bytes], held: np.ndarray):
        words = Words(texts, lower=True)
        n = words.counts() + 1
        self.bounds = np.concatenate([[0], np.cumsum(n)])
        hashes = np.full(self.bounds[-1], END, np.uint64)
        inside = np.ones(len(hashes), bool)
        inside[self.bounds[1:] - 1] = False
        hashes[inside] = words.hashes
        self.words, self.place = np.unique(hashes, return_inverse=True)
        self.of = np.repeat(np.arange(len(texts)), n)
        self.train = ~held[self.of]
        self.n = n

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.place[self.train], minlength=len(self.words)).astype(np.uint64)

    def edges(self, buckets: int) -> np.ndarray:
        """Where each bucket of words, an equal range of fingerprints, begins."""
        limits = [(k << 64) // buckets for k in range(1, buckets)]
        return np.concatenate([[0], np.searchsorted(self.words, np.array(limits, np.uint64)), [len(self.words)]]).astype(np.int64)

    def pairs(self, ids: np.ndarray):
        """The ids of each token's first word and of its own (-1: unknown), the distinct pairs of known ones as first and
        second ids in order, their training counts, and the pair of each token (-1: not known). The first word of a text
        follows BEGIN, whose id is 0."""
        place = self.place.astype(np.uint64)
        before = np.empty_like(place)
        before[1:] = place[:-1]
        before[self.bounds[:-1]] = len(self.words)
        every = np.append(ids, 0)
        first, own = every[before], every[place]
        known = (first >= 0) & (own >= 0)
        # Places within the slice fit into 32 bits; ids need not.
        distinct, inverse = np.unique((before[known] << np.uint64(32)) | place[known], return_inverse=True)
        h, w = every[distinct >> np.uint64(32)].astype(np.uint64), every[distinct & np.uint64(0xFFFFFFFF)].astype(np.uint64)
        order = np.lexsort((w, h))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        inverse = rank[inverse]
        counts = np.bincount(inverse[self.train[known]], minlength=len(distinct)).astype(np.uint64)
        pair = np.full(len(own), -1, np.int64)
        pair[known] = inverse
        return first, own, h[order], w[order], counts, pair


def _slices(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, text) to slices: id, the documents, and their texts compressed."""

    def run(batches: Iterator) -> Iterator:
        import secrets

        import pyarrow as pa
        import zstandard

        for part, texts in blocks(batches, limit=SLICE):
            data = zstandard.ZstdCompressor(level=9).compress(b"".join(texts))
            row = [secrets.randbits(62), part.column(0).to_pylist(), part.column(1).to_pylist(), [len(x) for x in texts], data]
            kinds = (pa.int64(), pa.list_(part.column(0).type), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["slice", "ids", "held", "sizes", "data"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"slice long, ids array<{kind}>, held array<boolean>, sizes array<long>, data binary")


def _read(row: dict) -> Slice:
    import zstandard

    raw, texts, at = zstandard.ZstdDecompressor().decompress(row["data"]), [], 0
    for n in row["sizes"]:
        texts.append(raw[at : at + n])
        at += n
    return Slice(texts, np.array(row["held"], bool))


def _ids(s: Slice, answers: list[dict], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids (-1: unknown) and counts of a slice's words from the buckets' answers."""
    edges, ids, counts = s.edges(buckets), np.full(len(s.words), -1, np.int64), np.zeros(len(s.words), np.uint64)
    for x in answers:
        a, b = edges[x["bucket"]], edges[x["bucket"] + 1]
        ids[a:b] = unpack(x["a"]).astype(np.int64) - 1
        counts[a:b] = unpack(x["b"])
    return ids, counts


def _rows(batches: Iterator) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _batch(rows: list[tuple], names: list[str], kinds: list):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _ask_words(slices: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for row in _rows(batches):
            s = _read(row)
            edges, counts = s.edges(buckets), s.word_counts()
            rows = [(k, row["slice"], pack_sorted(s.words[a:b]), pack(counts[a:b])) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
            yield _batch(rows, ["bucket", "slice", "a", "b"], [pa.int32(), pa.int64(), pa.binary(), pa.binary()])

    return slices.select("slice", "held", "sizes", "data").mapInArrow(run, "bucket int, slice long, a binary, b binary")


_ANSWER = "bucket int, slice long, a binary, b binary, c binary, d binary, e binary, n array<long>"


def _answer(bucket: int, slice_id, parts: list, n=None) -> dict:
    return {"bucket": bucket, "slice": slice_id} | dict(zip("abcde", [*parts, *[None] * 5], strict=False)) | {"n": n}


def _histogram(counts: np.ndarray) -> list[int]:
    """Tokens, types, and how many types occur 1..LARGEST+1 times."""
    seen = counts[counts > 0]
    return [int(seen.sum()), len(seen), *np.bincount(np.minimum(seen, LARGEST + 2).astype(np.int64), minlength=LARGEST + 3)[1 : LARGEST + 2].tolist()]


def _count_words(asked: DataFrame, buckets: int) -> DataFrame:
    """The buckets' answers, a row for each slice, and a row of the model (slice null) for each bucket."""

    def bucket(rows):
        import pandas as pd

        k = int(rows.bucket.iloc[0])
        words = [unpack_sorted(x) for x in rows.a]
        distinct, inverse = np.unique(np.concatenate(words), return_inverse=True)
        totals = np.bincount(inverse, np.concatenate([unpack(x) for x in rows.b]).astype(np.float64), len(distinct)).astype(np.uint64)
        order = np.argsort(-totals.astype(np.int64), kind="stable")
        ids = np.empty(len(distinct), np.uint64)
        ids[order] = np.arange(len(distinct), dtype=np.uint64) * np.uint64(buckets) + np.uint64(k + 1)  # 0 is BEGIN
        ids = np.where(totals > 0, ids + np.uint64(1), np.uint64(0))  # one more than the id, 0 for unknown
        out, at = [], 0
        for slice_id, own in zip(rows.slice, words, strict=True):
            mine = inverse[at : at + len(own)]
            at += len(own)
            out.append(_answer(k, slice_id, [pack(ids[mine]), pack(totals[mine])]))
        out.append(_answer(k, None, [pack_sorted(distinct), pack(totals), pack(ids)], _histogram(totals)))
        return pd.DataFrame(out, dtype=object)

    return asked.groupBy("bucket").applyInPandas(bucket, _ANSWER)


def _salts(heads: np.ndarray, buckets: int) -> np.ndarray:
    """Over how many buckets the successors of a first word are dealt: all for BEGIN, some for the most frequent word of
    each bucket of words (ids up to `buckets`), one for others."""
    some = min(buckets, max(2, buckets // 8))
    return np.where(heads == 0, buckets, np.where(heads <= buckets, some, 1)).astype(np.uint64)


def _pair_buckets(h: np.ndarray, w: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each pair, by its first word and, where that has salts, by its second."""
    n = np.uint64(buckets)
    return ((mix(h + np.uint64(1)) % n + mix(w + np.uint64(1)) % _salts(h, buckets)) % n).astype(np.int64)


def _head_buckets(heads: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """First words with each bucket that may hold successors of theirs."""
    salts, n = _salts(heads, buckets).astype(np.int64), np.uint64(buckets)
    each = np.repeat(heads, salts)
    salt = (np.arange(len(each)) - np.repeat(np.cumsum(salts) - salts, salts)).astype(np.uint64)
    return each, ((mix(each + np.uint64(1)) % n + salt) % n).astype(np.int64)


def _ask_pairs(slices: DataFrame, words: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for row in _rows(batches):
            s = _read(row)
            ids, counts = _ids(s, row["words"], buckets)
            first, own, h, w, trained, pair = s.pairs(ids)
            by_id = np.argsort(ids, kind="stable")
            w_count = counts[by_id][np.searchsorted(ids[by_id], w.astype(np.int64))]
            wanting = trained == 0
            # first words that an unknown word follows need their back-off weight too
            lone = np.unique(first[(first >= 0) & (own < 0)]).astype(np.uint64)
            heads, start = np.unique(h, return_index=True)
            need = np.add.reduceat(wanting, start) > 0 if len(start) else np.zeros(0, bool)
            wanted, wanted_bucket = _head_buckets(np.union1d(heads[need], lone), buckets)
            rows, of = [], _pair_buckets(h, w, buckets)
            for k in range(buckets):
                these, x = of == k, wanted[wanted_bucket == k]
                if these.any() or len(x):
                    mine, sizes = np.unique(h[these], return_counts=True)
                    bare = x[~np.isin(x, mine)]
                    all_heads = np.concatenate([mine, bare])
                    all_sizes = np.concatenate([sizes.astype(np.uint64), np.zeros(len(bare), np.uint64)])
                    rows.append((k, row["slice"], pack(all_heads), pack(all_sizes), pack(w[these]), pack(w_count[these]), pack(trained[these]), np.packbits(np.isin(all_heads, x)).tobytes()))
            yield _batch(rows, ["bucket", "slice", "a", "b", "c", "d", "e", "f"], [pa.int32(), pa.int64(), *[pa.binary()] * 6])

    answers = words.filter("slice is not null").groupBy("slice").agg(F.collect_list(F.struct("bucket", "a", "b")).alias("words"))
    joined = slices.select("slice", "held", "sizes", "data").join(answers, "slice")
    return joined.mapInArrow(run, "bucket int, slice long, a binary, b binary, c binary, d binary, e binary, f binary")


def _count_pairs(asked: DataFrame, model: WordModel) -> DataFrame:
    """Answers: totals of the pairs, and for each wanting first word the numbers n_r and the sum of its successors' word
    probabilities. Model rows (slice null): first words, numbers of successors, successors, counts."""

    def bucket(rows):
        import pandas as pd

        k = int(rows.bucket.iloc[0])
        parts = [(unpack(a), unpack(b).astype(np.int64), unpack(c), unpack(d), unpack(e), np.unpackbits(np.frombuffer(f, np.uint8)).astype(bool)) for a, b, c, d, e, f in zip(rows.a, rows.b, rows.c, rows.d, rows.e, rows.f, strict=True)]
        # Ids may need 64 bits; their places among the bucket's own don't.
        all_h, h_of = np.unique(np.concatenate([np.repeat(h, n) for h, n, *_ in parts]), return_inverse=True)
        all_w, w_of = np.unique(np.concatenate([p[2] for p in parts]), return_inverse=True)
        key = (h_of.astype(np.uint64) << np.uint64(32)) | w_of.astype(np.uint64)
        distinct, index, inverse = np.unique(key, return_index=True, return_inverse=True)
        of_h, of_w = all_h[distinct >> np.uint64(32)], all_w[distinct & np.uint64(0xFFFFFFFF)]
        totals = np.bincount(inverse, np.concatenate([p[4] for p in parts]).astype(np.float64), len(distinct)).astype(np.uint64)
        seen = totals > 0
        p1 = np.where(seen, model.probability(np.concatenate([p[3] for p in parts])[index]), 0.0)
        heads, start, sizes = np.unique(of_h, return_index=True, return_counts=True)
        sums = np.add.reduceat(p1, start) if len(start) else np.zeros(0)
        totals_or_more = np.minimum(totals, LARGEST + 1)
        n_r = np.stack([np.add.reduceat((totals_or_more == r).astype(np.int64), start) if len(start) else np.zeros(0, np.int64) for r in range(1, LARGEST + 2)])
        out, at = [], 0
        for slice_id, (h, n, w, _, _, wants) in zip(rows.slice, parts, strict=True):
            mine = inverse[at : at + len(w)]
            at += len(w)
            asked_heads = h[wants[: len(h)]]
            place = np.minimum(np.searchsorted(heads, asked_heads), max(0, len(heads) - 1))
            hit = heads[place] == asked_heads if len(heads) else np.zeros(len(asked_heads), bool)
            table = n_r[:, place] * hit if len(heads) else np.zeros((LARGEST + 1, len(asked_heads)), np.int64)
            given = np.where(hit, sums[place], 0.0) if len(heads) else np.zeros(len(asked_heads))
            out.append(_answer(k, slice_id, [pack(totals[mine]), pack(asked_heads), pack(table.ravel().astype(np.uint64)), given.tobytes()]))
        out.append(_answer(k, None, [pack_sorted(heads), pack(sizes.astype(np.uint64)), pack(of_w), pack(totals)], _histogram(totals)))
        return pd.DataFrame(out, dtype=object)

    return asked.groupBy("bucket").applyInPandas(bucket, _ANSWER)


def _totals(answers: DataFrame) -> list[int]:
    n = LARGEST + 3
    sums = answers.filter("slice is null").agg(*[F.coalesce(F.sum(F.col("n")[i]), F.lit(0)) for i in range(n)]).first()
    return [int(x) for x in sums]


def _evaluate(slices: DataFrame, words: DataFrame, pairs: DataFrame, model: WordModel, d2: np.ndarray, buckets: int, texts_trained: int) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for row in _rows(batches):
            s = _read(row)
            ids, counts = _ids(s, row["words"], buckets)
            first, own, h, w, _, pair = s.pairs(ids)
            bucket = _pair_buckets(h, w, buckets)
            totals = np.zeros(len(h), np.uint64)
            heads, n_r, sums = [np.zeros(0, np.uint64)], [np.zeros((LARGEST + 1, 0))], [np.zeros(0)]
            for x in row["pairs"]:
                totals[bucket == x["bucket"]] = unpack(x["a"])
                heads.append(unpack(x["b"]))
                n_r.append(unpack(x["c"]).reshape(LARGEST + 1, -1).astype(np.float64))
                sums.append(np.frombuffer(x["d"], np.float64))
            heads, n_r, sums = np.concatenate(heads), np.concatenate(n_r, axis=1), np.concatenate(sums)
            # The parts of a first word whose successors several buckets hold add up.
            order = np.argsort(heads, kind="stable")
            heads, start = np.unique(heads[order], return_index=True)
            if len(heads):
                n_r, sums = np.add.reduceat(n_r[:, order], start, axis=1), np.add.reduceat(sums[order], start)
            c_own = counts[s.place]
            c_first = np.empty(len(c_own), np.uint64)
            c_first[1:] = c_own[:-1]
            c_first[s.bounds[:-1]] = texts_trained
            p1 = model.probability(c_own)
            c_pair = np.where(pair >= 0, totals[np.maximum(pair, 0)] if len(totals) else 0, 0)
            c_pair = c_pair.astype(np.float64)
            total = c_first.astype(np.float64)
            place = np.minimum(np.searchsorted(heads, np.maximum(first, 0).astype(np.uint64)), max(0, len(heads) - 1))
            seen, backs = c_pair > 0, (c_pair == 0) & (total > 0)
            p = p1.copy()
            p[seen] = discounted(c_pair[seen], d2) / total[seen]
            if backs.any():
                at = place[backs]
                p[backs] = taken(n_r[:, at], d2) / total[backs] / (1 - sums[at]) * p1[backs]
            base = np.log10((c_own + np.uint64(1)).astype(np.float64) / (model.tokens + model.types + 1))
            ends = s.bounds[:-1]
            known = np.add.reduceat((c_own > 0).astype(np.int64), ends)
            columns = [pa.array(row["ids"]), pa.array(row["held"]), pa.array(s.n), pa.array(known), pa.array(np.full(len(s.n), model.tokens, np.int64)), pa.array(np.add.reduceat(base, ends)), pa.array(np.add.reduceat(np.log10(p), ends))]
            names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
            yield pa.RecordBatch.from_arrays([c.cast(kind_of) if i == 0 else c for i, c in enumerate(columns)], names=names)

    import pyarrow as pa  # noqa: F401
    from pyspark.sql.pandas.types import to_arrow_type

    element = slices.schema["ids"].dataType.elementType
    kind_of = to_arrow_type(element)
    a = words.filter("slice is not null").groupBy("slice").agg(F.collect_list(F.struct("bucket", "a", "b")).alias("words"))
    b = pairs.filter("slice is not null").groupBy("slice").agg(F.collect_list(F.struct("bucket", "a", "b", "c", "d")).alias("pairs"))
    none = F.array().cast("array<struct<bucket:int,a:binary,b:binary,c:binary,d:binary>>")
    joined = slices.join(a, "slice").join(b, "slice", "left").withColumn("pairs", F.coalesce("pairs", none))
    return joined.mapInArrow(run, f"doc_id {element.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _buckets(slices: int, shuffles: int) -> int:
    """More buckets for more slices, so that what meets in one doesn't grow with the input."""
    return max(8, min(shuffles, slices // 2), slices // 16)


def _bucketed(slices: DataFrame, folder: str, buckets: int) -> tuple[DataFrame, str]:
    """The slices as a table in the shared folder, bucketed by slice, so that joins by slice don't deal the texts out; and
    the table's name."""
    table = f"slices_{uuid.uuid4().hex}"
    slices.write.format("parquet").option("path", f"{folder}/slices").bucketBy(buckets, "slice").sortBy("slice").saveAsTable(table)
    return slices.sparkSession.table(table), table


def open_words(spark: SparkSession, tables: str) -> DataFrame:
    """(word, id, n) of a model that score() kept: fingerprints of words, their ids, and their training counts; ids are
    one more than those in bigrams, 0 for words that training never saw."""
    return _opened(spark.read.parquet(f"{tables}/words").filter("slice is null"), "bucket int, word long, id long, n long", lambda x: (unpack_sorted(x["a"]), unpack(x["c"]), unpack(x["b"])))


def open_bigrams(spark: SparkSession, tables: str) -> DataFrame:
    """(first, second, n) of a model that score() kept: ids of words (0: the beginning of a text), and training counts."""
    return _opened(spark.read.parquet(f"{tables}/bigrams").filter("slice is null"), "bucket int, first long, second long, n long", lambda x: (np.repeat(unpack_sorted(x["a"]), unpack(x["b"]).astype(np.int64)), unpack(x["c"]), unpack(x["d"])))


def _opened(rows: DataFrame, schema: str, columns) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [x.split()[0] for x in schema.split(", ")]
        for row in _rows(batches):
            made = columns(row)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(made[0]), row["bucket"], np.int32)), *[pa.array(x.view(np.int64)) for x in made]], names=names)

    return rows.mapInArrow(run, schema)


def score(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", tables: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 of the whole text's probability) of
    each row, by a model of the rows where held_out isn't true.

    Tokens are words, lower-cased in A-Z, and an end; a null text has the end alone. Words that training never saw are
    one class, which has what Good-Turing discounts take from seen words. Repeated rows count each time. An empty
    table gives no rows; without training rows every token is of the unknown class, with probability 1.

    tables: a folder of the shared place where the model's tables, partitioned by bucket, stay for open_words and
    open_bigrams; without one they go when the scores are written.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "katz")
    kept_in = tables or folder
    named = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    tasks = tasks_for(docs.count(), DOCUMENTS)
    slices, table = _bucketed(_slices(named.coalesce(tasks)), folder, min(tasks, partitions(spark)))
    of = slices.agg(F.count("*"), F.coalesce(F.sum(F.size(F.filter("held", lambda h: ~h))), F.lit(0))).first()
    trained, buckets = int(of[1]), _buckets(int(of[0]), partitions(spark))
    words = kept(_count_words(_ask_words(slices, buckets), buckets), f"{kept_in}/words", rows=4, by="bucket")
    tokens, types, *counts_of = _totals(words)
    model = WordModel(tokens, types, counts_of)
    pairs = kept(_count_pairs(_ask_pairs(slices, words, buckets), model), f"{kept_in}/bigrams", rows=4, by="bucket")
    d2 = discounts(_totals(pairs)[2:])
    out = kept(_evaluate(slices, words, pairs, model, d2, buckets, trained), f"{folder}-scores", rows=4)
    spark.sql(f"DROP TABLE {table}")
    drop_folder(spark, folder)
    return out
