"""Encoding, media, packing and quality rules against plain restatements of their contracts."""

import base64
import hashlib
import io
import re
import zlib
import zipfile
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from textloom.llm import bpe, media, packing, quality
from textloom.llm.words import PIECE, Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(*frames):
    return [(r.doc_id, r.text or "") for f in frames for r in f.select("doc_id", "text").collect()]


def test_byte_bpe_equals_tiktoken(spark, odd, sample):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = odd.select("doc_id", "text").union(sample.select("doc_id", "text"))
    got = Counter(tuple(r) for r in bpe.encode_decode(docs, path, public_tokenizers.PATTERN, digests=True).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter((i, len(ids := plain.encode_ordinary(x)), sha(",".join(map(str, ids)).encode()), sha(x.encode())) for i, x in rows_of(docs))
    assert got == want
    full = bpe.encode_decode(odd, path, public_tokenizers.PATTERN)
    assert full.columns == ["doc_id", "lang", "source", "ids", "decoded"]
    assert all(r.ids == plain.encode_ordinary(x) and bytes(r.decoded).decode() == x for r, (_, x) in zip(full.collect(), rows_of(odd)))


def test_media_round_trip(spark, odd):
    got = media.payload_digests(media.sniff(media.store_texts(odd))).collect()
    for r, (i, x) in zip(got, rows_of(odd)):
        raw = x.encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (i, len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        stored = media.wave(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert r.feature.startswith("audio/wav;corrected=1;carved=1")


def test_sniff_carves_and_rejects(spark):
    import gzip
    import io
    import struct
    import zipfile

    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")
    zipped = io.BytesIO()
    with zipfile.ZipFile(zipped, "w") as z:
        z.writestr("a.txt", "hello")
    packed = gzip.compress(b"x" * 100000)
    bad = bytearray(png)
    bad[20] ^= 1
    rows = [
        (1, png, "image/jpeg"), (2, b"junk" + png + b"tail" + media.wave(b"abc"), None), (3, bytes(bad), "image/png"),
        (4, zipped.getvalue(), "application/zip"), (5, b"--" + packed + b"--", "text/plain"), (6, b"BM not a bitmap at all, really not", "text/plain"), (7, None, "x"), (8, b"", None),
    ]
    got = {r.id: r for r in media.sniff(spark.createDataFrame(rows, "id int, media binary, declared string")).collect()}
    assert (got[1].detected, got[1].corrected) == ("image/png", True)
    assert [(c.start, c.end, c.type) for c in got[2].carved] == [(4, 4 + len(png), "image/png"), (8 + len(png), 8 + len(png) + len(media.wave(b"abc")), "audio/wav")]
    assert not got[3].carved and got[3].n_magic == 1 and got[3].detected == "application/octet-stream"
    assert (got[4].detected, got[4].corrected) == ("application/zip", False)
    assert [(c.start, c.end, c.type) for c in got[5].carved] == [(2, 2 + len(packed), "application/gzip")]
    assert not got[6].carved and got[7].detected is None and got[8].detected == "application/octet-stream"


def test_nested_media_and_revisions():
    wave = media.wave(b"abc" * 9)
    zipped = io.BytesIO()
    with zipfile.ZipFile(zipped, "w") as z:  # stored, so the medium inside stands as it is
        z.writestr("a.wav", wave)
    data = b"--" + zipped.getvalue() + wave
    inner = data.index(wave)
    assert [x[:4] for x in media.sniffed(data)[0]] == [(2, 2 + len(zipped.getvalue()), "application/zip", 0), (inner, inner + len(wave), "audio/wav", 1), (len(data) - len(wave), len(data), "audio/wav", 0)]
    twice = b"%PDF-1.4 x startxref 9 %%EOF more startxref 30 %%EOF"
    assert media.sniffed(twice + b" rest %PDF-1.7 startxref 1 %%EOF")[0] == [(0, len(twice), "application/pdf", 0), (len(twice) + 6, len(twice) + 32, "application/pdf", 0)]
    assert media.sniffed(b"%PDF-1.4 without an end, startxref 3")[0] == [] and media.sniffed(b"%PDF-x startxref 1 %%EOF")[0] == []


@pytest.mark.parametrize("piece", [b"PK\x03\x04" + b"PK\x05\x06" + b"\0" * 18, b"%PDF-1", b"GIF89a!\x09abcdefghi,", b"\xff\xd8\xff\xe0\x00\x02", b"\x89PNG\r\n\x1a\n\0\0\0\x0dIHDR"])
def test_false_starts_cost_linear_time(piece):
    import time

    took = []
    for size in (32_000, 320_000):
        data = piece * (size // len(piece))
        began = time.process_time()
        media.sniffed(data)
        took.append(time.process_time() - began)
    assert took[1] < 40 * max(took[0], 0.01)


def test_declared_types_and_odd_media(spark, odd):
    found = media.sniff(media.store_texts(odd)).collect()
    assert len({r.declared for r in found}) > 1 and all(r.corrected and r.detected == "audio/wav" for r in found)
    rows = spark.createDataFrame([(1, 3, None, None), (2, 4, b"text", "x")], "doc_id long, n_bytes long, media binary, declared string")
    assert [r.payload_sha256 for r in media.payload_digests(media.sniff(rows)).collect()] == [None, None]
    assert media.payload_digests(media.sniff(media.store_texts(odd.limit(0)))).count() == 0
    clash = odd.withColumn("media", F.lit("clash")).withColumn("declared", F.lit(1))
    assert media.sniff(media.store_texts(clash)).count() == odd.count()


def test_packing(spark, odd, sample):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    docs = odd.select("doc_id", "text").union(sample.select(F.col("doc_id") + 100, "text"))
    got = packing.pack_documents(docs.withColumn("sequence_id", F.lit("clash")).withColumn("length", F.lit("clash")), path).collect()
    assert packing.pack_documents(docs.limit(0), path).count() == 0
    # Of the repeated row one is compared; all of them are placed.
    assert Counter(r.doc_id for r in got)[6] == 2 and Counter(r.doc_id for r in got)[None] == 1
    by = {(r.doc_id, r.piece): r for r in got}
    docs = docs.distinct()
    total = 0
    for i, x in rows_of(docs):
        ids = [*model.encode(x, add_special_tokens=False).ids, 2]
        total += len(ids)
        first = len(ids) % 1024 or 1024
        edges = [0, *range(first, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            r = by.pop((i, k))
            assert (r.start, r.length, r.ids_crc32) == (a, b - a, zlib.crc32(b"".join(t.to_bytes(4, "little") for t in ids[a:b])))
    assert not by
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(places) <= 1.03 * total / 1024 + 2


@pytest.mark.parametrize("counts", [{}, {1: 5000}, {1024: 7, 1: 3}, {600: 50, 400: 70, 25: 1000}, {s: s % 7 for s in range(1, 1025)}])
def test_supersteps_place_each_once(spark, counts):
    rows = [(k, 0, s) for s, n in counts.items() for k in range(n)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, piece int, length int").withColumn("offset", F.lit("clash"))).collect()
    assert Counter((r.doc_id, r.piece, r.length) for r in got) == Counter(rows)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for offset, size in sorted(spans):
            assert offset == at
            at += size
        assert at <= 1024
    assert len(bins) <= 1.02 * plain_best_fit(counts) + 2


def plain_best_fit(counts, length=1024):
    """The number of sequences of best fit, the longest first."""
    from bisect import bisect_left, insort

    gaps, opened = [], 0
    for s in sorted(counts, reverse=True):
        for _ in range(counts[s]):
            at = bisect_left(gaps, s)
            if at == len(gaps):
                opened += 1
                rest = length - s
            else:
                rest = gaps.pop(at) - s
            insort(gaps, rest)
    return opened


def brute_quality(rows):
    """rows: (host, text, doc_id) -> the base counts, and the rule's verdict. Rows without doc_id are documents of their own."""
    ids, rows = [("row", i) if r[2] is None else r[2] for i, r in enumerate(rows)], [r[:2] for r in rows]
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    lines = [{k: v for y in x.split("\n") if (k := tuple(WORD.findall(y.translate(low)))) for v in [len(k)]} for _, x in rows]
    docs, hosts = Counter((h, k) for h, k, _ in {(h, k, i) for (h, _), i, own in zip(rows, ids, lines) for k in own}), Counter(h for h, _ in {(h, i) for (h, _), i in zip(rows, ids)})
    out = []
    for (h, x), own in zip(rows, lines):
        words = WORD.findall(x)
        grams = Counter(zip(words, words[1:], words[2:]))
        covered = {i + k for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for k in range(3)}
        each = [tuple(WORD.findall(y)) for y in x.split("\n")]
        seen = [y for y in each if y]
        removed = sum(len(k) for y in x.split("\n") if (k := tuple(WORD.findall(y.translate(low)))) and docs[h, k] >= 3 and docs[h, k] > 0.001 * hosts[h])
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        kept = not failed and 100 * (len(words) - removed) >= 50 * len(words)
        out.append((len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", x)), len(seen) - len(set(seen)), len(covered), removed, failed, kept))
    return out


def test_quality_rules(spark, odd, sample):
    some = sample.select("doc_id", "text", "lang", "source")
    docs = odd.union(some).union(some.filter("doc_id < 30")).union(some.filter("doc_id < 30"))  # the same documents again
    for k in (1, 2):
        docs = docs.union(some.filter("doc_id < 30").withColumn("doc_id", F.col("doc_id") + 10_000 * k))
    got = quality.quality_rules(docs.withColumn("host", F.lit("clash")).withColumn("lines", F.lit("clash")), line_docs=3)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed", "base_failed", "kept"]
    rows = [(r.source, r.text or "", r.doc_id) for r in docs.collect()]
    assert Counter(tuple(r[n] for n in names) for r in got.collect()) == Counter(brute_quality(rows))
    assert quality.quality_rules(docs.limit(0)).count() == 0


def test_words_of_long_texts():
    long = b"alpha beta\n" * (PIECE // 4)
    texts = [b"x y\nz", long, b"", b" q\n\nr"]
    words = Words(texts, lines=True)
    want = [WORD.findall(t.decode()) for t in texts]
    assert words.counts().tolist() == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    code = {}
    assert all(code.setdefault(w, h) == h for w, h in zip(flat, words.hashes.tolist())) and len(set(code.values())) == len(code)
    assert words.lines.tolist() == [k for t in texts for k, y in enumerate(t.decode().split("\n")) for _ in WORD.findall(y)]


def test_segment_ids_equal_whole_texts():
    import random

    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    rng = random.Random(3)
    marks = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "a", "b", "'s", "'ll", "é", "\xa0", " ", "　", "“", "ß", "1", "!", "你", "😀", "\x1c", "\x85", "\x0b", "<|endoftext|>", "word", "The"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(40))) for _ in range(3000)]
    for table in (packing.id_table(path), packing.SegmentIds(packing.id_table(path).encode, None, limit=10)):
        for part in (texts[:1500], texts[1500:], texts[:10]):
            flat, bounds = table.of([x.encode() for x in part])
            want = [x.ids for x in model.encode_batch(part, add_special_tokens=False)]
            assert [flat[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == want
        flat, bounds = table._apart([b"", b"a b"])
        assert bounds.tolist()[:2] == [0, 0] and len(flat) == bounds[-1]


def test_encoding_of_nothing_and_of_clashing_columns(spark, odd):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    assert bpe.encode_decode(odd.limit(0), path, public_tokenizers.PATTERN, digests=True).count() == 0
    clash = odd.withColumn("ids_sha256", F.lit(1)).withColumn("n_tokens", F.lit("clash"))
    got = bpe.encode_decode(clash, path, public_tokenizers.PATTERN, digests=True).collect()
    want = bpe.encode_decode(odd, path, public_tokenizers.PATTERN, digests=True).collect()
    key = lambda rows: Counter((r.doc_id, r.lang, r.source, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows)
    assert key(got) == key(want)
