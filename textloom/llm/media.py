"""Media columns: signature sniffing of bytes, correction of declared types, and carving of embedded media.

One Aho-Corasick automaton finds all magic bytes and end marks in one pass; a validator of the format then checks
structure and lengths, so text that happens to hold a magic string isn't taken for media. Validators look up end marks
by bisection and remember where walks over blocks led, so many false starts cost no more than a few passes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_automaton = None

# The magic bytes of public formats, and where they stand in a file.
MAGIC = [
    (b"RIFF", 0, "riff"),
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"BM", 0, "image/bmp"),
    (b"%PDF-", 0, "application/pdf"),
    (b"PK\x03\x04", 0, "application/zip"),
    (b"\x1f\x8b\x08", 0, "application/gzip"),
    (b"fLaC", 0, "audio/flac"),
    (b".snd", 0, "audio/basic"),
]


#: What ends a file, or stands near its end.
ENDS = [b"%%EOF", b"startxref", b"PK\x05\x06", b"\xff\xd9"]


class Bytes:
    """Data with the places of end marks and starts, and what walks over it have found."""

    def __init__(self, data: bytes, marks: dict[bytes, list[int]]):
        self.data, self.marks = data, marks
        self.after: dict[str, dict[int, int]] = {}
        self._zips: dict[int, int] | None = None

    def next(self, mark: bytes, at: int) -> int:
        """The first place of a mark from `at` on, or -1."""
        places = self.marks.get(mark, [])
        k = bisect_left(places, at)
        return places[k] if k < len(places) else -1

    def last(self, mark: bytes, before: int) -> int:
        """The last place of a mark before `before`, or -1."""
        places = self.marks.get(mark, [])
        k = bisect_left(places, before)
        return places[k - 1] if k else -1

    def walk(self, name: str, p: int, step) -> int:
        """Where step, from place to place until it gives a place negated less one, leads from p; steps are remembered."""
        known, path = self.after.setdefault(name, {}), []
        while p >= 0 and p not in known:
            path.append(p)
            p = step(self.data, p)
        end = known[p] if p >= 0 else p
        known.update(dict.fromkeys(path, end))
        return end

    def zips(self) -> dict[int, int]:
        """For each start that an end-of-directory record leads back to: the first such record."""
        if self._zips is None:
            self._zips = {}
            for p in self.marks.get(b"PK\x05\x06", []):
                if p <= len(self.data) - 22:
                    size, offset, note = struct.unpack_from("<IIH", self.data, p + 12)
                    if p + 22 + note <= len(self.data):
                        self._zips.setdefault(p - offset - size, p + 22 + note)
        return self._zips


FAILED = -1


def _ended(p: int) -> int:
    """A walk's result: it ended well at p."""
    return -2 - p


def _riff(b: Bytes, at: int) -> tuple[int, str] | None:
    """RIFF: four-byte form, then chunks that fill the stated length; WAVE needs a fmt and a data chunk."""
    data = b.data
    if len(data) - at < 12:
        return None
    total, form = struct.unpack_from("<I4s", data, at + 4)
    end = at + 8 + total
    kinds = {b"WAVE": "audio/wav", b"AVI ": "video/x-msvideo", b"WEBP": "image/webp"}
    if form not in kinds or end > len(data):
        return None
    seen, p = set(), at + 12
    while p + 8 <= end:
        name, n = struct.unpack_from("<4sI", data, p)
        seen.add(name)
        p += 8 + n + (n & 1)
    if p not in (end, end + 1) or form == b"WAVE" and not {b"fmt ", b"data"} <= seen:
        return None
    return end, kinds[form]


def _png_chunk(data: bytes, p: int) -> int:
    if p + 12 > len(data):
        return FAILED
    n, name = struct.unpack_from(">I4s", data, p)
    if p + 12 + n > len(data) or not name.isalpha():
        return FAILED
    return _ended(p + 12 + n) if name == b"IEND" else p + 12 + n


def _png(b: Bytes, at: int) -> tuple[int, str] | None:
    """PNG: an IHDR of 13 bytes, chunks that lead to IEND, with right CRCs."""
    data = b.data
    if data[at + 8 : at + 16] != b"\0\0\0\x0dIHDR" or (end := b.walk("png", at + 8, _png_chunk)) == FAILED:
        return None
    p, end, view = at + 8, -2 - end, memoryview(data)
    while p < end:
        n = struct.unpack_from(">I", data, p)[0]
        if zlib.crc32(view[p + 4 : p + 8 + n]) != struct.unpack_from(">I", data, p + 8 + n)[0]:
            return None
        p += 12 + n
    return end, "image/png"


def _jpeg_segment(data: bytes, p: int) -> int:
    if p + 4 > len(data) or data[p] != 0xFF:
        return FAILED
    n = struct.unpack_from(">H", data, p + 2)[0]
    return _ended(p + 2 + n) if data[p + 1] == 0xDA else p + 2 + n


def _jpeg(b: Bytes, at: int) -> tuple[int, str] | None:
    """JPEG: marker segments up to a start of scan, then an end marker."""
    scan = b.walk("jpeg", at + 2, _jpeg_segment)
    end = b.next(b"\xff\xd9", -2 - scan) if scan != FAILED else -1
    return (end + 2, "image/jpeg") if end >= 0 else None


def _gif_piece(data: bytes, p: int) -> int:
    """A sub-block, from its length on; the end of the blocks is where the next extension or image begins."""
    if p >= len(data):
        return FAILED
    return p + 1 + data[p] if data[p] else _ended(p + 1)


def _gif(b: Bytes, at: int) -> tuple[int, str] | None:
    """GIF: screen descriptor, then blocks whose lengths lead to the trailer."""
    data = b.data
    if len(data) - at < 14:
        return None

    def block(data: bytes, p: int) -> int:
        if p >= len(data):
            return FAILED
        if data[p] == 0x3B:
            return _ended(p + 1)
        if data[p] == 0x21:
            p += 2
        elif data[p] == 0x2C and p + 10 < len(data):
            p += 11 + (3 << (data[p + 9] & 7) + 1 if data[p + 9] & 128 else 0)
        else:
            return FAILED
        rest = b.walk("gif piece", p, _gif_piece)
        return FAILED if rest == FAILED else -2 - rest

    end = b.walk("gif", at + 13 + (3 << (data[at + 10] & 7) + 1 if data[at + 10] & 128 else 0), block)
    return (-2 - end, "image/gif") if end != FAILED else None


def _bmp(b: Bytes, at: int) -> tuple[int, str] | None:
    """BMP: file size, zero reserved words, a pixel offset past a known header size."""
    if len(b.data) - at < 26:
        return None
    size, reserved, start, header = struct.unpack_from("<IIII", b.data, at + 2)
    ok = reserved == 0 and header in (12, 40, 52, 56, 108, 124) and 14 + header <= start <= size <= len(b.data) - at
    return (at + size, "image/bmp") if ok else None


def _pdf(b: Bytes, at: int) -> tuple[int, str] | None:
    """PDF: a version number after the magic, and the last end mark before another PDF begins, with a cross-reference
    offset before it; a file that was saved again has an end mark for each revision."""
    if not b.data[at + 5 : at + 6].isdigit():
        return None
    other = b.next(b"%PDF-", at + 5)
    end = b.last(b"%%EOF", other if other >= 0 else len(b.data))
    if end < at or not 0 <= b.next(b"startxref", at) < end:
        return None
    return end + 5, "application/pdf"


def _zip(b: Bytes, at: int) -> tuple[int, str] | None:
    """ZIP: an end-of-directory record whose sizes and offsets lead back to the first entry."""
    end = b.zips().get(at)
    return (end, "application/zip") if end else None


def _gzip(b: Bytes, at: int) -> tuple[int, str] | None:
    """gzip: the stream inflates, in bounded steps, to its end and its check values hold."""
    data, inflate, p = b.data, zlib.decompressobj(31), at
    try:
        while p < len(data) and not inflate.eof:
            inflate.decompress(data[p : p + 65536], 1 << 20)
            rest = inflate.unconsumed_tail
            while rest and not inflate.eof:
                inflate.decompress(rest, 1 << 20)
                rest = inflate.unconsumed_tail
            p += 65536
    except zlib.error:
        return None
    return (min(p, len(data)) - len(inflate.unused_data), "application/gzip") if inflate.eof else None


def _flac_block(data: bytes, p: int) -> int:
    if p + 4 > len(data):
        return FAILED
    n = p + 4 + int.from_bytes(data[p + 1 : p + 4], "big")
    return n if not data[p] & 128 else _ended(n) if n <= len(data) else FAILED


def _flac(b: Bytes, at: int) -> tuple[int, str] | None:
    """FLAC: a stream-info block of 34 bytes first, and metadata blocks within the data; runs to the end."""
    head = b.data[at + 4 : at + 8]
    if len(head) < 4 or head[0] & 127 or head[1:] != b"\0\0\x22" or b.walk("flac", at + 4, _flac_block) == FAILED:
        return None
    return len(b.data), "audio/flac"


def _au(b: Bytes, at: int) -> tuple[int, str] | None:
    """AU: header offset, data length and a known encoding."""
    if len(b.data) - at < 24:
        return None
    start, size, code, rate, channels = struct.unpack_from(">5I", b.data, at + 4)
    ok = 24 <= start and code in range(1, 28) and 0 < rate and 0 < channels < 65 and at + start + size <= len(b.data)
    return (at + start + size, "audio/basic") if ok else None


_VALID = {"riff": _riff, "image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp, "application/pdf": _pdf, "application/zip": _zip, "application/gzip": _gzip, "audio/flac": _flac, "audio/basic": _au}


def _machine():
    global _automaton
    if _automaton is None:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for magic, offset, kind in MAGIC:
            machine.add_word(magic.decode("latin-1"), (magic, offset, kind))
        for mark in ENDS:
            machine.add_word(mark.decode("latin-1"), (mark, 0, None))
        machine.make_automaton()
        _automaton = machine
    return _automaton


def sniffed(data: bytes) -> tuple[list[tuple[int, int, str, int]], int]:
    """The valid media in data as (start, end, type, depth), in order; depth is the number of media around it, and one that
    runs over the end of what it begins in doesn't count. And the number of magic strings seen."""
    starts, marks = [], {}
    for last, (mark, offset, kind) in _machine().iter(data.decode("latin-1")):
        marks.setdefault(mark, []).append(last - len(mark) + 1)
        if kind:
            starts.append((last - len(mark) + 1 - offset, kind))
    found, around, b = [], [], Bytes(data, marks)
    for at, kind in sorted(starts):
        while around and around[-1] <= at:
            around.pop()
        if at >= 0 and (hit := _VALID[kind](b, at)) and hit[0] <= (around[-1] if around else len(data)):
            found.append((at, hit[0], hit[1], len(around)))
            around.append(hit[0])
    return found, len(starts)


def sniff(media: DataFrame, data: str = "media", declared: str = "declared") -> DataFrame:
    """media with detected (type of what starts at byte 0, else application/octet-stream), corrected (the declared
    type was another), carved (start, end, type and depth of each valid medium) and n_magic (magic strings, valid or not).

    Null data: no detected type, nothing carved. Null declared: corrected where a type is found. Columns with an
    output's name are replaced. Repeated rows get equal results, and an empty table gives no rows.
    """
    names = ["detected", "corrected", "carved", "n_magic"]
    picked = media.select(*[f"`{c}`" for c in media.columns if c not in names])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("type", pa.string()), ("depth", pa.int32())]))
        for batch in batches:
            rows = []
            said = batch.column(batch.schema.get_field_index(declared)).to_pylist()
            for x, was in zip(batch.column(batch.schema.get_field_index(data)).to_pylist(), said, strict=True):
                found, seen = sniffed(x) if x is not None else ([], 0)
                kind = next((k for a, _, k, _ in found if a == 0), "application/octet-stream") if x is not None else None
                carved = [{"start": a, "end": b, "type": k, "depth": d} for a, b, k, d in found]
                rows.append((kind, kind is not None and kind != was and bool(found), carved, seen))
            kinds = (pa.string(), pa.bool_(), span, pa.int64())
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema), "detected string, corrected boolean, carved array<struct<start:long,end:long,type:string,depth:int>>, n_magic long"])
    return picked.mapInArrow(run, schema)


def wave(samples: bytes, rate: int = 8000) -> bytes:
    """A mono WAV file of 8-bit samples."""
    pad = b"\0" * (len(samples) & 1)
    head = struct.pack("<4sIHHIIHH4sI", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return struct.pack("<4sI4s", b"RIFF", 4 + len(head) + len(samples) + len(pad), b"WAVE") + head + samples + pad


def wave_samples(data: bytes, start: int, end: int) -> bytes:
    """The samples of the WAV file at data[start:end]."""
    p = start + 12
    while p + 8 <= end:
        name, n = struct.unpack_from("<4sI", data, p)
        if name == b"data":
            return data[p + 8 : p + 8 + n]
        p += 8 + n + (n & 1)
    raise ValueError("no data chunk")


#: What stored texts are declared to be.
DECLARED = ["application/octet-stream", "text/plain", "image/png", "application/zip"]


def store_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: int = 64) -> DataFrame:
    """Each text (null: empty) as a WAV file of its bytes, padded with bytes 0 to a positive multiple of `unit`:
    doc_id, n_bytes, media, declared. `declared` is one of DECLARED by a checksum of the text, as files come with
    vague and wrong types. Repeated rows are stored one by one; an empty table gives no rows."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            media = [wave(x.ljust(max(unit, -(-len(x) // unit) * unit), b"\0")) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary()), pa.array([DECLARED[zlib.crc32(x) % len(DECLARED)] for x in texts])], names=["doc_id", "n_bytes", "media", "declared"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), text).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary, declared string")


def payload_digests(found: DataFrame) -> DataFrame:
    """Digests of the samples of the WAV file that sniff() carved at byte 0 of each stored text, and a feature:
    detected type, declared type corrected, number of carved media, number of magic strings, mean and variation
    of the samples. A null medium, or one that isn't a WAV file, has null digests."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rows = []
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for data, kind, fixed, carved, magic in zip(*(columns[n].to_pylist() for n in ("media", "detected", "corrected", "carved", "n_magic")), strict=True):
                span = next((c for c in carved or [] if c["start"] == 0 and c["type"] == "audio/wav"), None)
                if span is None:
                    rows.append((None,) * 6)
                    continue
                read = wave_samples(data, span["start"], span["end"])
                samples = np.frombuffer(read, np.uint8)
                step = int(np.abs(np.diff(samples.astype(np.int16))).sum()) / max(1, len(samples) - 1)
                feature = f"{kind};corrected={int(fixed)};carved={len(carved)};magic={magic};mean={int(samples.sum(dtype=np.int64)) / len(samples):.4f};step={step:.4f}"
                rows.append((len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([columns["doc_id"], columns["n_bytes"], *made], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
