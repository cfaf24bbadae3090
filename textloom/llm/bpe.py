"""Byte-level BPE encoding and decoding with a sentencepiece model that is written straight from a rank file."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .segments import SegmentTable

_encoders: dict[str, SegmentTable] = {}


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where printable in Latin-1, else the next from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def _field(number: int, value: bytes | int | float | str) -> bytes:
    """A protocol-buffer field: a length-delimited one, a varint or a 32-bit float."""
    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file, by rank."""
    with open(path, "rb") as lines:
        pairs = sorted((int(rank), base64.b64decode(piece)) for piece, rank in map(bytes.split, lines))
    if [rank for rank, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks aren't 0, 1, 2, ...")
    return [piece for _, piece in pairs]


def serialised_model(pieces: list[bytes]) -> bytes:
    """A sentencepiece BPE model: piece i is the byte-mapped i-th byte string with score -i; then one unknown piece."""
    shown = byte_characters()
    out = [_field(1, _field(1, "".join(shown[b] for b in piece)) + _field(2, float(-rank))) for rank, piece in enumerate(pieces)]
    out.append(_field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(pieces) + 1) + _field(40, len(pieces))
    normaliser = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normaliser)


def encoder(path: str, pattern: str) -> SegmentTable:
    """Of each segment: its ids as decimal text, and the bytes that they decode to; one per worker and file."""
    if path not in _encoders:
        import regex
        import sentencepiece

        pieces = read_ranks(path)
        model = sentencepiece.SentencePieceProcessor(model_proto=serialised_model(pieces))
        shown, split = byte_characters(), regex.compile(pattern)
        byte_of = {c: b for b, c in enumerate(shown)}
        to_shown = {b: ord(c) for b, c in enumerate(shown)}
        decoded = [bytes(byte_of[c] for c in model.id_to_piece(i)) for i in range(len(pieces))]

        def make(segments: list[str]) -> list[tuple[str, bytes]]:
            cut = [split.findall(x) for x in segments]
            ids = iter(model.encode([x.encode("utf-8", "surrogatepass").decode("latin-1").translate(to_shown) for found in cut for x in found], num_threads=1))
            out = []
            for found in cut:
                own = [i for _ in found for i in next(ids)]
                out.append((",".join(map(str, own)), b"".join([decoded[i] for i in own])))
            return out

        _encoders[path] = SegmentTable(make)
    return _encoders[path]


def encode_decode(docs: DataFrame, path: str, pattern: str, text: str = "text", digests: bool = False) -> DataFrame:
    """Ids of each whole text and the bytes they decode to.

    Args: path: the rank file on every worker. pattern: cuts a text into pre-tokens, encoded separately.
    digests: n_tokens, ids_sha256 and decoded_sha256 instead of the columns ids (array of int) and decoded
    (binary); nothing of a text's size then leaves the task.
    A null or empty text has no ids, and decodes to nothing. Rows, and the other columns, stay as they are, but
    columns that carry an output's name are replaced.
    """
    out = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary"
    names = [x.split()[0] for x in out.split(", ")]
    kept = [c for c in docs.columns if c not in {text, *names}]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = encoder(path, pattern)
        for batch in batches:
            rows = []
            for each in table.values(x or "" for x in batch.column(batch.num_columns - 1).to_pylist()):
                n, commas, ids, decoded = 0, "", hashlib.sha256(), hashlib.sha256()
                all_ids, all_bytes = [], []
                for values in each:
                    if not values:
                        continue
                    said, back = ",".join([v[0] for v in values]), b"".join([v[1] for v in values])
                    if digests:
                        n += said.count(",") + 1
                        ids.update((commas + said).encode())
                        decoded.update(back)
                        commas = ","
                    else:
                        all_ids += map(int, said.split(","))
                        all_bytes.append(back)
                rows.append((n, ids.hexdigest(), decoded.hexdigest()) if digests else (all_ids, b"".join(all_bytes)))
            kinds = (pa.int64(), pa.string(), pa.string()) if digests else (pa.list_(pa.int32()), pa.binary())
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], *names])

    picked = docs.select(*[f"`{c}`" for c in kept], f"`{text}`")
    shape = picked.drop(text).schema.fields
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in shape), out])
    return picked.mapInArrow(run, schema)
