"""Phrase collocations by counting suffixes: each word starts a suffix of at most `longest` words, suffixes are dealt out
by language and first word and sorted in reverse, and one pass with a stack of open prefixes counts all phrases."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, partitions
from .words import hashed

#: Bytes of text that are taken apart at a time; memory per task is about 30 times this.
BLOCK = 4 << 20

#: Rows of sorted suffixes that are written or counted at a time.
ROWS = 20_000

#: In a suffix words are parted by byte 0, which sorts before all others; byte 0 within a word is written as a space, which
#: words never hold. Ends of pieces become line feeds.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_LETTERS = bytes(range(65, 91))
_CODES = bytes.maketrans(_LETTERS + b"\0 \t" + _ENDS, _LETTERS.lower() + b" \0\0" + b"\n" * len(_ENDS))
_BETWEEN = re.compile(rb"[ \t-\r.,;:!?]")

#: A row's count and the words of its key share a number; so phrases have less than this many words.
_DEPTHS = 16


class Block:
    """The words of some parts of texts as numbers in order, and what suffixes start at those that stand within the first
    `owned` bytes of their part (`at`).

    buffer[start[i]:end[i + k - 1]] are the first k words from word i on, and size[i] says how many there are within its
    piece, `longest` at most.
    """

    def __init__(self, langs: list[str], parts: list[bytes], owned: list[int], longest: int):
        data = np.frombuffer(b"\n".join(parts).translate(_CODES) + b"\n", np.uint8)
        blank = data == 0
        gap = blank | (data == 10)
        edge = np.flatnonzero(np.diff(gap.view(np.int8), prepend=np.int8(1)))
        start, end = edge[0::2], edge[1::2]
        n, width = len(start), end - start
        ends = np.cumsum([len(p) + 1 for p in parts])
        part = np.searchsorted(ends, start, side="right")
        self.at = np.flatnonzero(start - np.concatenate([[0], ends[:-1]])[part] < np.array(owned)[part])
        self.langs = sorted(set(langs))
        number = {x: i for i, x in enumerate(self.langs)}
        self.lang = np.array([number[x] for x in langs], np.int64)[part]
        keep = ~(blank & np.concatenate([[True], gap[:-1]]))
        self.start = np.cumsum(keep, dtype=np.int32)[start] - 1
        self.end = self.start + width.astype(np.int32)
        tight = data[keep]
        self.buffer = tight.tobytes()
        last = np.ones(n, bool)
        if n:
            last[:-1] = ~((self.start[1:] == self.end[:-1] + 1) & (tight[self.end[:-1]] == 0))
        stops = np.flatnonzero(last)
        self.size = np.minimum(longest, stops[np.searchsorted(stops, np.arange(n))] - np.arange(n) + 1) if n else np.zeros(0, np.int64)
        offsets = np.concatenate([[0], np.cumsum(width)]).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data[~gap])]).dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        self.words = coded.dictionary.take(order)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(1, len(order) + 1)
        self.word = rank[coded.indices.to_numpy()] if n else np.zeros(0, np.int64)

    def longer(self, places: np.ndarray, of: np.ndarray, k: int) -> np.ndarray:
        """Numbers, in order, of groups of suffixes by their first k words, from those by one word less. A suffix that ends
        before has 0 for a word."""
        following = np.where(self.size[places] >= k, self.word[np.minimum(places + k - 1, len(self.word) - 1)], 0)
        return np.unique(of * (len(self.words) + 1) + following, return_inverse=True)[1]

    def groups(self, longest: int) -> tuple[np.ndarray, np.ndarray]:
        """One place of each different suffix, by language and its first two words, and how many there are."""
        of = self.longer(self.at, self.lang[self.at], 1)
        if longest > 1:
            of = self.longer(self.at, of, 2)
        left, rank = self.at, of
        places, ranks, counts = [], [], []
        for k in range(3, longest + 2):
            n = np.bincount(of)
            # Suffixes that are alone already aren't looked at again.
            one = n[of] == 1 if k <= longest else np.zeros(len(of), bool)
            places.append(left[one])
            ranks.append(rank[one])
            counts.append(n[of[one]])
            left, rank, of = left[~one], rank[~one], of[~one]
            if k <= longest:
                of = self.longer(left, of, k)
        some = np.zeros(int(of.max()) + 1 if len(of) else 0, np.int64)
        some[of] = np.arange(len(of))
        place, count = np.concatenate([*places, left[some]]), np.concatenate([*counts, np.bincount(of)[: len(some)]])
        order = np.argsort(np.concatenate([*ranks, rank[some]]), kind="stable")
        return place[order], count[order]

    def prefix(self, i: int, k: int) -> bytes:
        return self.buffer[self.start[i] : self.end[i + k - 1]]


def _blocks(batches, longest: int) -> Iterator[Block]:
    """Blocks of about BLOCK bytes. A longer text is cut between words, with what its last suffixes need put to each part."""
    more = re.compile(rb"(?:[ \t]*[^ \t-\r.,;:!?]+){0,%d}" % (longest - 1))
    langs, parts, owned, held = [], [], [], 0
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for lang, text in zip(batch.column("lang").to_pylist(), (x.as_py() for x in texts)):
            at = 0
            while at < len(text):
                near = _BETWEEN.search(text, at + BLOCK)
                end = near.start() if near else len(text)
                whole = more.match(text, end).end() if near else end
                langs.append(lang)
                parts.append(text[at:whole])
                owned.append(end - at)
                held, at = held + whole - at, end
                if held >= BLOCK:
                    yield Block(langs, parts, owned, longest)
                    langs, parts, owned, held = [], [], [], 0
    if parts:
        yield Block(langs, parts, owned, longest)


def _frequent(longest: int, share: float) -> Callable:
    """Of each block the prefixes that begin at least `share` of its suffixes, and (words = 0) how many it has."""

    def run(batches):
        for block in _blocks(batches, longest):
            rows = [("", b"", 0, len(block.at))]
            left, of = block.at, block.lang[block.at]
            for k in range(1, longest):
                left, of = left[block.size[left] >= k], of[block.size[left] >= k]
                if not len(left):
                    break
                of = block.longer(left, of, k)
                n = np.bincount(of)
                often = n[of] >= share * len(block.at)
                left, of = left[often], of[often]
                for g, i in zip(*np.unique(of, return_index=True)):
                    rows.append((block.langs[block.lang[left[i]]], block.prefix(left[i], k), k, int(n[g])))
            lang, prefix, words, c = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(prefix, pa.binary()), pa.array(words, pa.int32()), pa.array(c, pa.int64())], ["lang", "prefix", "words", "c"])

    return run


def _depths(block: Block, place: np.ndarray, longest: int, hot: dict[str, set[bytes]]) -> np.ndarray:
    """How many words of each suffix make up its key: those of its shortest prefix that isn't hot."""
    depth = np.ones(len(place), np.int64)
    for number, lang in enumerate(block.langs):
        known = hot.get(lang, set())
        first = pc.index_in(pa.array([p for p in known if b"\0" not in p], pa.binary()), value_set=block.words).drop_null().to_numpy()
        left = np.flatnonzero((block.lang[place] == number) & np.isin(block.word[place], first + 1))
        for k in range(2, longest + 1):
            depth[left] = k
            left = left[block.size[place[left]] >= k]
            if k < longest:
                start, end = block.start[place[left]].tolist(), block.end[place[left] + k - 1].tolist()
                left = left[np.fromiter((block.buffer[a:b] in known for a, b in zip(start, end)), bool, len(left))]
    return depth


def _slices(buffer: bytes, start: np.ndarray, end: np.ndarray, heads: list[bytes], head: np.ndarray) -> pa.Array:
    """buffer[start:end] for each pair, each led by one of heads."""
    ahead, body = np.array([len(h) for h in heads])[head], (end - start).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(ahead + body)])
    out, at = np.empty(offsets[-1], np.uint8), offsets[:-1]
    inner = np.arange(body.sum()) - np.repeat(np.cumsum(body) - body, body)
    out[np.repeat(at + ahead, body) + inner] = np.frombuffer(buffer, np.uint8)[np.repeat(start, body) + inner]
    for i, h in enumerate(heads):
        out[at[head == i][:, None] + np.arange(len(h))] = np.frombuffer(h, np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])


def _suffixes(longest: int, hot: dict[str, set[bytes]]) -> Callable:
    """The suffixes of each block, led by their language, with how often each occurs there and the words of its key."""

    def run(batches):
        for block in _blocks(batches, longest):
            place, count = block.groups(longest)
            depth, size = _depths(block, place, longest, hot), block.size[place]
            key = (hashed(block.buffer, block.start[place], block.end[place + np.minimum(depth, size) - 1]) >> np.uint64(44)).astype(np.int32)
            start, end, lang, c = block.start[place], block.end[place + size - 1], block.lang[place], count * _DEPTHS + depth
            names = [quote(x, safe="").encode() + b"\0" for x in block.langs]
            for a in range(0, len(place), ROWS):
                b = a + ROWS
                yield pa.RecordBatch.from_arrays([pa.array(key[a:b]), _slices(block.buffer, start[a:b], end[a:b], names, lang[a:b]), pa.array(c[a:b])], ["key", "suffix", "c"])

    return run


def _tables(batches, rows: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


class Stack:
    """Counts of all prefixes of suffixes that come in order. Level k holds the open prefix of a language and k words as
    (prefix, whether it is always reported, count). Tables of rows are taken at a time."""

    def __init__(self, longest: int, least: int):
        self.longest, self.least = longest, least
        self.open: list[tuple[list[bytes], bool, int] | None] = [None] * (longest + 1)
        self.closed: list[tuple[str, str, int, int]] = []

    def close(self, k: int) -> None:
        if self.open[k]:
            prefix, always, c = self.open[k]
            if always or c >= self.least:
                self.closed.append((unquote(prefix[0].decode()), b" ".join(w.replace(b" ", b"\0") for w in prefix[1:]).decode(), k, c))
        self.open[k] = None

    def shared(self, parts: list[bytes]) -> int:
        """The last level of the stack that a suffix goes on with, or -1."""
        k = 0
        while k < len(parts) and self.open[k] and self.open[k][0][k] == parts[k]:
            k += 1
        return k - 1

    def add(self, rows: pa.Table) -> None:
        suffix = rows["suffix"].combine_chunks()
        c, depth = np.divmod(rows["c"].to_numpy(), _DEPTHS)
        cut_up = pc.split_pattern(suffix, "\0")
        bounds = cut_up.offsets.to_numpy()
        n, size = len(rows), np.diff(bounds)
        part = np.full((n, self.longest + 1), -1, np.int32)
        part[np.repeat(np.arange(n), size), np.arange(bounds[-1] - bounds[0]) - np.repeat(bounds[:-1] - bounds[0], size)] = cut_up.flatten().dictionary_encode().indices.to_numpy()
        going_on = self.shared(cut_up[0].as_py())
        same = np.ones(n - 1, bool)
        for k in range(self.longest + 1):
            same = same & (part[1:, k] == part[:-1, k]) & (part[1:, k] >= 0)
            starts = np.flatnonzero(np.concatenate([[going_on < k], ~same]))
            lead = int(c[: starts[0]].sum()) if len(starts) else int(c.sum())
            if lead:
                prefix, always, before = self.open[k]
                self.open[k] = (prefix, always, before + lead)
            if not len(starts):
                continue
            self.close(k)
            sums = np.add.reduceat(c, starts)
            has, always = size[starts] > k, depth[starts] > k
            told = always | (sums >= self.least)
            told[-1] = True  # stays open, if it is there
            for g in np.flatnonzero(has & told):
                i = int(starts[g])
                self.open[k] = (cut_up[i].as_py()[: k + 1], bool(always[g]), int(sums[g]))
                if g < len(starts) - 1:
                    self.close(k)

    def taken(self) -> pa.RecordBatch:
        rows, self.closed = self.closed, []
        lang, phrase, words, f = zip(*rows) if rows else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(phrase, pa.string()), pa.array(words, pa.int32()), pa.array(f, pa.int64())], ["lang", "phrase", "words", "f"])


def _counted(longest: int, least: int) -> Callable:
    def run(batches):
        stack = Stack(longest, least)
        for rows in _tables(batches, ROWS):
            stack.add(rows)
            yield stack.taken()
        for k in range(longest + 1):
            stack.close(k)
        yield stack.taken()

    return run


def phrase_counts(docs: DataFrame, longest: int = 5, least: int = 100) -> DataFrame:
    """(lang, phrase, words, f): the phrases of 1 to `longest` words that occur `least` times or more in a language, and with
    words = 0 the number of all word occurrences of each language. Phrases of at least `least` occurrences only leave the
    tasks that count them.

    A suffix goes to the task of its first word. Where a prefix begins more than a fourth of a partition's share of all
    suffixes, those that begin with it are dealt out by one word more, and so on; the counts of such prefixes come in parts
    that are added up. Prefixes are compared with their share of each block of text: one that passes its share of all passes
    half of it over enough blocks to be seen. No more than 8 prefixes for each partition and number of words can pass, so
    they are few for the driver and the tasks. Equal suffixes of a block are one row.
    """
    if not 1 < longest < _DEPTHS:
        raise ValueError(f"longest must be from 2 to {_DEPTHS - 1}")
    n = partitions(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").filter("text <> ''")
    often = texts.mapInArrow(_frequent(longest, 1 / (8 * n)), "lang string, prefix binary, words int, c long")
    often = cut(often.groupBy("lang", "prefix", "words").agg(F.sum("c").alias("c")))
    total = often.filter("words = 0").agg(F.sum("c")).first()[0] or 0
    hot: dict[str, set[bytes]] = {}
    for r in often.filter((F.col("words") > 0) & (F.col("c") * 8 * n >= total)).collect():
        hot.setdefault(r.lang, set()).add(bytes(r.prefix))
    suffixes = texts.mapInArrow(_suffixes(longest, hot), "key int, suffix binary, c long")
    dealt = suffixes.repartition(n, "key").select("suffix", "c").sortWithinPartitions(F.desc("suffix"))
    parts = dealt.mapInArrow(_counted(longest, least), "lang string, phrase string, words int, f long")
    return cut(parts.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).filter((F.col("words") == 0) | (F.col("f") >= least)))


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, percent: int = 100, top: int = 2000) -> DataFrame:
    """The best phrases of 2 to `longest` words of each language of (text, lang): lang, rank, phrase, a, l, r, n, score.

    ASCII letters are lower-cased; pieces end at . , ; : ! ? and line ends, words at spaces and tabs. a is how often a phrase
    occurs, n the words of its language; of the cuts into two parts, which occur l and r times, the one with the lowest
    floor(1000 * a * n / (l * r)) counts, the first of equal ones. A phrase within a longer one that occurs `least` times
    and at least `percent` % as often is left out; whoever holds a phrase holds one that is one word longer and occurs as
    often or more, so those are enough to look at. Arithmetic is exact up to 10^17 occurrences.

    A null lang is `und`; null and empty texts have no words; rows count one by one, repeated ones too; other columns don't
    matter. An empty table gives no rows.
    """
    counts = phrase_counts(docs, longest, least)
    candidates = counts.filter("words > 1")
    inside = F.explode(F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)")))
    holders = counts.filter("words > 2").select("lang", inside.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("held"))
    kept = candidates.join(holders, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("held") < percent * F.col("f"), F.lit(True)))
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("first"), F.expr("substring_index(phrase, ' ', k - words)").alias("rest"))
    parts = counts.filter(f"words between 1 and {longest - 1}")
    both = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    both = both.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    both = both.join(counts.filter("words = 0").select("lang", F.col("f").alias("n")), "lang").withColumn("score", score("a", "n", "l", "r"))
    best = both.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("s")).select("lang", "phrase", "a", "n", "s.score", "s.l", "s.r")
    n = partitions(docs.sparkSession)
    for ways in (n, int(n**0.5), 1):
        # The best of each of many parts of a language, then of fewer: none is sorted in one task as a whole.
        order = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(ways))).orderBy(F.desc("score"), F.desc("a"), "phrase")
        best = best.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def score(a: str, n: str, l: str, r: str):  # noqa: E741
    """floor(1000 * a * n / (l * r)) as a long, exact beyond 64 bits."""
    big = lambda c: f"cast({c} as decimal(17, 0))"
    return F.expr(f"(cast(1000 as decimal(4, 0)) * {big(a)} * {big(n)}) div ({big(l)} * {big(r)})")
