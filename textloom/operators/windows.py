"""Word windows with overlap: one row per window."""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import words

_tokenizers: dict[str, tuple] = {}
#: Words whose counts a process keeps, and characters of windows that leave a task together.
WORDS_KNOWN, TOGETHER = 1 << 17, 4 << 20
COUNTERS: dict[str, Callable[[str], int]] = {"word_count": lambda text: len(text.split())}


@dataclass(frozen=True)
class SubwordCounter:
    """A counter of the tokens of a tokenizers file, for COUNTERS: the file must lie at the same path on every executor."""

    path: str

    def _file(self):
        if self.path not in _tokenizers:
            from tokenizers import Tokenizer

            # The file, whether it cuts at spaces first, and the counts of words that were met.
            t = Tokenizer.from_file(self.path)
            _tokenizers[self.path] = t, cuts_at_spaces(t.to_str()), {}
        return _tokenizers[self.path]

    def __call__(self, text: str) -> int:
        return len(self._file()[0].encode(text, add_special_tokens=False).ids)

    def of_words(self, tokens: list[str]) -> list[tuple[int, int]] | None:
        """The count of each word at the start of a text and after a space, where these add up to the count of any run of the
        words joined by spaces; None where they need not."""
        _, additive, known = self._file()
        if not additive:
            return None
        out = []
        for w in tokens:
            pair = known.get(w)
            if pair is None:
                pair = self(w), self(" " + w)
                if len(known) >= WORDS_KNOWN:
                    known.clear()
                if len(w) <= 64:
                    known[w] = pair
            out.append(pair)
        return out


def cuts_at_spaces(tokenizer: str) -> bool:
    """Whether a tokenizers file, as JSON, leaves a text as it is, cuts it before each space that a word follows, and merges
    within pieces only."""
    t = json.loads(tokenizer)
    cut = t.get("pre_tokenizer") or {}
    byte_level = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
    plain = not any(a["lstrip"] or a["rstrip"] or a["single_word"] or " " in a["content"] for a in t.get("added_tokens") or [])
    return bool(byte_level and plain and not t.get("normalizer") and not t.get("truncation") and t["model"].get("type") in ("BPE", None))


def subword_counter(path: str) -> Callable[[str], int]:
    return SubwordCounter(path)


@dataclass(frozen=True)
class WindowConfig:
    """size and overlap count tokens. boundary: end windows at a word that ends in one of boundary_chars, but not at
    a word index below min_size // 3. scope: whether that index counts from the text's start or the window's.
    exact_overlap: an overlap of 0 repeats nothing. counter: a name in COUNTERS."""

    size: int = 500
    overlap: int = 50
    boundary: bool = True
    boundary_chars: str = ".!?"
    min_size: int = 50
    scope: str = "text"
    exact_overlap: bool = False
    counter: str = "word_count"

    def __post_init__(self):
        if self.size < 1 or self.min_size < 1:
            raise ValueError("size and min_size must be at least 1")
        if not 0 <= self.overlap < self.size:
            raise ValueError("overlap must be from 0 to below size")
        if self.scope not in ("text", "window"):
            raise ValueError("scope must be text or window")
        if self.counter not in COUNTERS:
            raise ValueError(f"unknown counter {self.counter}")


def fitting(over: Callable[[int], bool], low: int, most: int, guess: int) -> int:
    """The largest end from low to most that isn't over the size; low itself counts as fitting.

    Steps that double, up or down from a guess, enclose it, and halving finds it: about twice the logarithm of the guess's
    error in calls. over must not turn false again as the end grows.
    """
    at, step = min(most, max(low, guess)), 1
    if at > low and over(at):
        high, at = at, max(low, at - 1)
        while at > low and over(at):
            step *= 2
            high, at = at, max(low, at - step)
        low = at
    else:
        low, high = at, most + 1
        while low < most:
            at = min(most, low + step)
            if over(at):
                high = at
                break
            low, step = at, step * 2
    while high - low > 1:
        at = (low + high) // 2
        low, high = (low, at) if over(at) else (at, high)
    return low


def spans(tokens: list[str], c: WindowConfig, counter: Callable[[str], int] | None = None) -> Iterator[tuple[int, int]]:
    """Start and end of each window that isn't empty. The counter that c names is looked up where it isn't given.

    A window of another counter than words has as many words as stay within the size, one at least. They are searched from
    the length of the window before, so a window costs a logarithm of counts; a count must not fall by a further word. A
    counter with `of_words` counts each word once for all windows, and ends are looked up in running sums.
    """
    n, start, count = len(tokens), 0, counter or COUNTERS[c.counter]
    each = count.of_words(tokens) if c.counter != "word_count" and hasattr(count, "of_words") else None
    sums = list(accumulate((later for _, later in each), initial=0)) if each is not None else None
    floor = max(1, c.min_size // 3)
    ends = {i for i, w in enumerate(tokens) if w[-1] in c.boundary_chars} if c.boundary else set()
    length = c.size
    while start < n:
        end = min(start + c.size, n)
        if sums is not None:
            end = min(end, max(start + 1, bisect_right(sums, c.size - each[start][0] + sums[start + 1]) - 1))
        elif c.counter != "word_count":
            end = fitting(lambda e, a=start: count(" ".join(tokens[a:e])) > c.size, start + 1, end, start + length)
            length = end - start
        if c.boundary and end < n:
            lowest = floor if c.scope == "text" else start + floor
            end = next((i + 1 for i in range(end - 1, lowest - 1, -1) if i in ends), end)
        if end > start:
            yield start, end
        if end >= n:
            return
        start = max(start + 1, end - (c.overlap if c.exact_overlap else max(1, c.overlap)))


def fixed_step(c: WindowConfig) -> int:
    """Words from one window's start to the next one's, without boundaries."""
    return max(1, c.size - (c.overlap if c.exact_overlap else max(1, c.overlap)))


def fixed_windows(df: DataFrame, text: str, c: WindowConfig, index: str = "window_index", out: str = "window", count: str | None = None) -> DataFrame:
    """Windows without boundaries in closed form: column expressions only. Each text is cut into its windows before they
    become rows, so no row carries more than its own."""
    step = fixed_step(c)
    n = F.size("_words")
    last = F.when(n <= c.size, 0).otherwise(F.ceil((n - c.size) / step)).cast("int")
    each = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.least(F.lit(c.size), n - i * step).alias("n"), F.array_join(F.slice("_words", i * step + 1, c.size), " ").alias("w")))
    rows = df.withColumn("_words", words(F.col(text))).withColumn("_windows", F.when(n > 0, each)).drop("_words")
    # The outer form, as Spark would test the array of the other one below, and make it twice.
    rows = rows.select(*df.columns, F.posexplode_outer("_windows").alias(index, "_window")).filter(F.col("_window").isNotNull())
    counted = [F.col("_window.n").alias(count)] if count else []
    return rows.select(*df.columns, index, F.col("_window.w").alias(out), *counted)


def windows(df: DataFrame, text: str, c: WindowConfig, index: str = "window_index", out: str = "window", count: str | None = None, source: bool = True) -> DataFrame:
    """df with a row for each window of `text`, numbered from 0, and in `count` its number of words; blank texts have none.
    Columns named like an output are replaced. Without `source` the text itself is left out, which would otherwise stand in
    the rows of all its windows. Without boundaries the closed form is used; a boundary makes each end depend on the one
    before, so a task then walks each text once."""
    df = df.drop(*[x for x in (index, out, count) if x and x != text])
    if not c.boundary and c.counter == "word_count":
        rows = fixed_windows(df, text, c, index, out, count)
        return rows if source or text in (index, out, count) else rows.drop(text)
    names = df.columns
    at = names.index(text)
    kept = [i for i, n in enumerate(names) if source or i != at]
    counter = COUNTERS[c.counter]  # entries made on the driver aren't known to the tasks
    most = TOGETHER

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            of, numbers, made, sizes, held = [], [], [], [], 0

            def flush():
                rows = batch.select(kept).take(pa.array(of, pa.int64()))
                new = [pa.array(numbers, pa.int32()), pa.array(made, pa.string()), *([pa.array(sizes, pa.int32())] if count else [])]
                return pa.RecordBatch.from_arrays([*rows.columns, *new], names=[*rows.schema.names, index, out, *([count] if count else [])])

            for i, x in enumerate(batch.column(at)):
                x = x.as_py() or ""
                tokens = x.split()
                for k, (a, b) in enumerate(spans(tokens, c, counter)):
                    of.append(i)
                    numbers.append(k)
                    made.append(" ".join(tokens[a:b]))
                    sizes.append(b - a)
                    held += len(made[-1]) + (len(x) if source else 0)
                    if held >= most:
                        yield flush()
                        of, numbers, made, sizes, held = [], [], [], [], 0
            if of:
                yield flush()

    fields = [df.schema[i] for i in kept]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{index}` int", f"`{out}` string", *([f"`{count}` int"] if count else [])])
    return df.mapInArrow(run, schema)
