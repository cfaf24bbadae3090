"""Texts cut into segments that byte-level tokenizers encode independently of each other.

The usual pre-token pattern never joins characters across the start of " word": a segment is a run of other
characters with at most one space before it, or white space. Segments repeat, so each task encodes a distinct
one once and keeps the result in a bounded table.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterable, Iterator

import numpy as np

from .words import LONG, hashed

_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SEGMENT = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]")
_SAFE = re.compile(f"(?<=[^{_WHITE}])(?= [^{_WHITE}])")
_PART = 1 << 20


def parts(text: str) -> Iterator[str]:
    """A very long text in parts, cut only before a space that starts a segment."""
    at = 0
    while len(text) - at > _PART and (found := _SAFE.search(text, at + _PART)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


class _Known(dict):
    """Values of segments; those asked for in vain are gathered in `new`."""

    new: set

    def __missing__(self, segment: str):
        self.new.add(segment)


class SegmentTable:
    """Values of segments: `make` computes those that are new in a block of texts together.

    Up to `limit` values are kept from block to block, but not those of segments of over `longest` characters.
    """

    def __init__(self, make: Callable[[list[str]], list], limit: int = 600_000, longest: int = 48, block: int = 1 << 20):
        self.make, self.limit, self.longest, self.block = make, limit, longest, block
        self.kept = _Known()

    def _learn(self, found: list[list[list[str]]]) -> None:
        if len(self.kept) > self.limit:
            self.kept.clear()
        self.kept.new = set()
        for each in found:
            for segments in each:
                deque(map(self.kept.__getitem__, segments), maxlen=0)
        new = list(self.kept.new)
        if new:
            self.kept.update(zip(new, self.make(new), strict=True))

    def values(self, texts: Iterable[str]) -> Iterator[list[list]]:
        """For each text the values of its segments, in lists for its parts."""
        group, size = [], 0
        for x in texts:
            group.append(x)
            size += len(x)
            if size >= self.block:
                yield from self._of(group)
                group, size = [], 0
        yield from self._of(group)

    def _of(self, group: list[str]) -> Iterator[list[list]]:
        found = [[SEGMENT.findall(part) for part in parts(x)] for x in group]
        self._learn(found)
        for each in found:
            yield [list(map(self.kept.__getitem__, segments)) for segments in each]
        for segment in [x for x in self.kept.new if len(x) > self.longest]:
            del self.kept[segment]


_UNSURE = np.zeros(256, bool)
_UNSURE[[*range(0x21), 0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = True


def cuts(data: np.ndarray) -> np.ndarray:
    """Where segments may begin in UTF-8 data, as flags: before a space that stands right before a character that is surely
    not white, and around a line break between two such characters. Bytes that may begin white space of other kinds are
    taken as not sure, so some segments hold several words."""
    sure = ~_UNSURE[data]
    after = np.append(sure[1:], False)
    out = (data == 0x20) & after
    line = np.flatnonzero((data == 10) & after)
    # The byte before may end a wide character, white or not; only ASCII tells.
    line = line[(line > 0) & sure[line - 1] & (data[line - 1] < 0x80)]
    out[line] = True
    out[line + 1] = True
    return out


class SegmentIds:
    """Ids of texts by their segments, distinct ones encoded once.

    `encode` gives the ids of each of some texts. `line` is the id of a line break, if that is always a token of its own:
    segments without white space inside are then encoded as the lines of one text. Up to `limit` ids of segments are kept
    from block to block, as sorted fingerprints and one array of ids. Within a block, equal fingerprints are confirmed by
    the segments' bytes.
    """

    def __init__(self, encode: Callable[[list[str]], list[np.ndarray]], line: int | None, limit: int = 8_000_000):
        self.encode, self.line, self.limit = encode, line, limit
        self.clear()

    def clear(self) -> None:
        self.prints, self.first, self.count, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, prints: np.ndarray, segments: list[bytes], plain: np.ndarray) -> None:
        count, flat = np.zeros(len(prints), np.int64), []
        lines = np.flatnonzero(plain)
        if len(lines) and self.line is not None:
            ids = self.encode([b"\n".join([segments[i] for i in lines]).decode()])[0]
            at = np.flatnonzero(ids == self.line)
            if len(at) == len(lines) - 1:
                count[lines] = np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1
                flat.append(ids[ids != self.line])
            else:
                plain = np.zeros(len(plain), bool)
        else:
            plain = np.zeros(len(plain), bool)
        rest = np.flatnonzero(~plain)
        made = self.encode([segments[i].decode() for i in rest])
        count[rest] = list(map(len, made))
        order = np.concatenate([np.flatnonzero(plain), rest])
        first = np.empty(len(prints), np.int64)
        first[order] = len(self.ids) + np.cumsum(count[order]) - count[order]
        at = np.searchsorted(self.prints, prints)
        self.prints, self.first, self.count = np.insert(self.prints, at, prints), np.insert(self.first, at, first), np.insert(self.count, at, count)
        self.ids = np.concatenate([self.ids, *flat, *made])

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, and their bounds."""
        if len(self.ids) > self.limit:
            self.clear()
        raw = b"".join(texts)
        if not raw:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        data, edges = np.frombuffer(raw, np.uint8), np.cumsum([0, *map(len, texts)])
        begins = cuts(data)
        begins[edges[:-1][edges[:-1] < len(raw)]] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(raw))
        prints = hashed(raw, start, end)
        distinct, index, inverse = np.unique(prints, return_index=True, return_inverse=True)
        if not equal(raw, start, end, index[inverse]).all():
            return self._apart(texts)
        at = np.minimum(np.searchsorted(self.prints, distinct), max(0, len(self.prints) - 1))
        new = self.prints[at] != distinct if len(self.prints) else np.ones(len(distinct), bool)
        if new.any():
            a, b = start[index[new]], end[index[new]]
            unsure = np.concatenate([[0], np.cumsum(_UNSURE[data], dtype=np.int32)])
            plain = (unsure[b] == unsure[a + 1]) & (~_UNSURE[data[a]] | (data[a] == 0x20) & (b > a + 1))
            self._learn(distinct[new], [raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)], plain)
            at = np.searchsorted(self.prints, distinct)
        count, first = self.count[at][inverse], self.first[at][inverse]
        ends = np.cumsum(count)
        flat = self.ids[np.repeat(first - ends + count, count) + np.arange(ends[-1])]
        return flat, np.concatenate([[0], ends])[np.searchsorted(start, edges)]

    def _apart(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Each text encoded whole: where two segments of a block share a fingerprint."""
        made = self.encode([x.decode() for x in texts])
        return np.concatenate([np.zeros(0, np.uint32), *made]), np.cumsum([0, *map(len, made)])


def equal(raw: bytes, start: np.ndarray, end: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether raw[start:end] equals the run that `other` numbers, for each run."""
    size = end - start
    same = size == size[other]
    at_each = np.ndarray(len(raw), "<u8", raw + bytes(8), strides=(1,))
    left = np.flatnonzero(same & (other != np.arange(len(start))))
    for k in range(0, LONG, 8):
        left = left[size[left] > k]
        if not len(left):
            return same
        rest = np.minimum(size[left] - k, 8).astype(np.uint64)
        differ = (at_each[start[left] + k] ^ at_each[start[other[left]] + k]) << (np.uint64(64) - np.uint64(8) * rest)
        same[left] &= differ == 0
    for i in left[size[left] > LONG]:
        same[i] &= raw[start[i] : end[i]] == raw[start[other[i]] : end[other[i]]]
    return same
