"""Words as 64-bit fingerprints, computed for many texts at once with numpy inside a task.

A word is a maximal run of bytes other than space and 0x09-0x0D. Its fingerprint folds in its bytes eight at a time,
each time through a mixing function that isn't linear, so no family of words or of word sequences is known to collide;
words over LONG bytes are digested whole by BLAKE2b.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

#: Bytes of text that are hashed at a time; memory per task is about 60 times this.
PIECE = 1 << 20

#: Words of more bytes than this are rare, and hashed one by one.
LONG = 64
_SEED, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed(raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The fingerprint of raw[start:end] for each pair."""
    size = end - start
    at_each = np.ndarray(len(raw), "<u8", raw + bytes(8), strides=(1,))
    out = mix(size.astype(np.uint64) * _SEED)
    left = np.arange(len(start))
    for k in range(0, LONG, 8):
        left = left[size[left] > k]
        if not len(left):
            break
        rest = np.minimum(size[left] - k, 8)
        part = at_each[start[left] + k] & (~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * rest.astype(np.uint64)))
        out[left] = mix((out[left] ^ part) * _STEP + np.uint64(k + 1))
    for i in np.flatnonzero(size > LONG):
        out[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


def runs(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The fingerprint of values[start:end] for each pair; independent of where the run stands.

    Fingerprints of 1, 2, 4, ... values from each place on are made from those of half the length; a run folds in those
    that its length is the sum of.
    """
    size, at = end - start, start.copy()
    out = mix(size.astype(np.uint64) + _SEED)
    level, width, longest = values, 1, int(size.max()) if len(size) else 0
    while width <= longest:
        with_it = np.flatnonzero(size & width)
        out[with_it] = mix(out[with_it] * _STEP + level[at[with_it]])
        at[with_it] += width
        width *= 2
        if width <= longest:
            level = mix(level[: -(width // 2)] * _SEED ^ level[width // 2 :])
    return out


def _pieces(texts: list[bytes]) -> Iterator[list[tuple[int, bytes]]]:
    """Groups of (index, part) of about PIECE bytes; a longer text is cut at white space."""
    group, size = [], 0
    for i, text in enumerate(texts):
        at = 0
        while True:
            end = at + PIECE
            if end < len(text):
                while end < len(text) and not _SPACE[text[end]]:
                    end += 1
            part = text[at:end]
            if size and size + len(part) > PIECE:
                yield group
                group, size = [], 0
            group.append((i, part))
            size += len(part) + 1
            at = end
            if at >= len(text):
                break
    if group:
        yield group


class Words:
    """Fingerprints of all words of some texts in order, with `bounds`: text i has hashes[bounds[i]:bounds[i+1]].

    `lines` (if asked for) numbers the line of each word within its text, from 0.
    """

    def __init__(self, texts: list[bytes], lower: bool = False, lines: bool = False):
        hashes, of, line = [], [], []
        base_line = 0
        last = -1
        for group in _pieces(texts):
            raw = b"\n".join(part for _, part in group) + b"\n"
            raw = raw.lower() if lower else raw
            data = np.frombuffer(raw, np.uint8)
            space = _SPACE[data]
            edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1)))
            start, end = edge[0::2], edge[1::2]
            hashes.append(hashed(raw, start, end))
            ends = np.cumsum([len(part) + 1 for _, part in group])
            which = np.searchsorted(ends, start, side="right")
            index = np.array([i for i, _ in group])
            of.append(index[which])
            if lines:
                breaks = np.cumsum(data == 10)
                first = np.concatenate([[0], ends[:-1]])
                before = np.where(first > 0, breaks[first - 1], 0)
                carried = base_line if group[0][0] == last else 0
                add = np.where(index == group[0][0], carried, 0)
                line.append(breaks[start] - before[which] + add[which])
                tail = len(group) - 1
                base_line = int(breaks[-2] - before[tail]) + int(add[tail]) if len(breaks) > 1 else 0
                last = group[-1][0]
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        of = np.concatenate(of) if of else np.zeros(0, np.int64)
        self.bounds = np.searchsorted(of, np.arange(len(texts) + 1))
        self.of = of
        self.lines = (np.concatenate(line) if line else np.zeros(0, np.int64)) if lines else None

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def blocks(batches, column: str = "text", limit: int = 2 * PIECE) -> Iterator[tuple[object, list[bytes]]]:
    """Slices of Arrow batches with about `limit` bytes of text each, and the texts as UTF-8 (null: empty)."""
    import pyarrow as pa

    for batch in batches:
        texts = [x or b"" for x in batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()]
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= limit):
                size += len(texts[end])
                end += 1
            yield batch.slice(at, end - at), texts[at:end]
            at = end
