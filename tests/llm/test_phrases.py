import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from oracle import compare, connect
from textloom.llm import phrases, queries

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
        yield re.findall("[^ \t]+", piece)


def plain(rows, longest=5, least=100, percent=100, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {p: c for p, c in counts.items() if c >= least}
        found = []
        for p, a in often.items():
            if len(p) < 2:
                continue
            if any(len(q) > len(p) and 100 * c >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, c in often.items()):
                continue
            s, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-s, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1):  # noqa: E741
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_odd(spark, odd):
    want = plain([(r.lang, r.text) for r in odd.collect()], least=2)
    assert rows_of(phrases.collocations(odd, least=2)) == want
    assert any(len(r[2].split()) == 5 for r in want)


@pytest.mark.parametrize("longest, least, percent, top", [(5, 3, 100, 2000), (4, 2, 60, 2000), (2, 2, 100, 7), (5, 4, 30, 20)])
def test_random(spark, longest, least, percent, top):
    rng = random.Random(longest * 100 + percent)
    # Few words, one of them in most places, with bytes that sort below and above the separator.
    words = ["the", "The", "a\x00", "a\x01b", "a", "é", "\x00", "x,y", "b. c", "q\tq", "  ", "\n", "ß😀"]
    rows = [(rng.choice(["en", "de", None, "und", ""]), " ".join(rng.choices(words, [12, 4] + [1] * 11, k=rng.choice([0, 1, 3, 40, 200])))) for _ in range(120)]
    rows += [("en", "one passage that all of them have " * 3)] * 30 + [("en", None)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = rows_of(phrases.collocations(df, longest, least, percent, top))
    assert got == plain(rows, longest, least, percent, top)
    assert got


def test_long_text_in_parts(monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["a", "b", "c.", "dd", "e  f", "g\nh"], k=3000)), "no-end" * 2000, "a b c", " \t", "." * 500 + " a b " * 400]
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "en", "de", "en", "de"], "text": texts})

    def counted(limit):
        monkeypatch.setattr(phrases, "BLOCK", limit)
        out = Counter()
        for block in phrases._blocks([batch], 5):
            place, count = block.groups(5)
            for c, i in zip(count.tolist(), place.tolist()):
                out[block.langs[block.lang[i]], block.prefix(i, block.size[i])] += c
        return out

    whole = counted(1 << 20)
    assert whole == counted(64) == counted(1000)
    assert sum(whole.values()) == sum(len(w) for t in texts for w in pieces(t))


def test_stack_over_tables():
    rng = random.Random(9)
    suffixes = sorted(((rng.choice(["x", "y"]), b"\0".join(rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 4))), rng.randint(1, 3)) for _ in range(500)), reverse=True)
    want = Counter()
    for lang, s, c in suffixes:
        w = s.split(b"\0")
        for k in range(len(w) + 1):
            want[lang, b" ".join(w[:k]).decode(), k] += c
    for size in (1, 7, 500):
        stack, got = phrases.Stack(4, 1), []
        for at in range(0, 500, size):
            lang, s, c = zip(*suffixes[at : at + size])
            stack.add(pa.table({"suffix": pa.array([x.encode() + b"\0" + y for x, y in zip(lang, s)], pa.binary()), "c": pa.array([16 * x + 1 for x in c], pa.int64())}))
            got += stack.taken().to_pylist()
        for k in range(5):
            stack.close(k)
        got += stack.taken().to_pylist()
        assert {(g["lang"], g["phrase"], g["words"]): g["f"] for g in got} == want and len(got) == len(want)


def test_exact_beyond_64_bits(spark):
    rows = [(3 * 10**15 + 7, 10**17 - 3, 5 * 10**15, 7 * 10**15 + 1), (10**17 - 1, 10**17 - 1, 10**17 - 1, 100), (100, 100, 100, 100)]
    got = spark.createDataFrame(rows, "a long, n long, l long, r long").select("a", "n", "l", "r", phrases.score("a", "n", "l", "r").alias("s")).collect()
    assert all(r.s == 1000 * r.a * r.n // (r.l * r.r) for r in got) and len(got) == 3


def test_empty_and_extra_columns(spark, odd):
    assert phrases.collocations(odd.limit(0)).count() == 0
    assert phrases.collocations(odd.filter("text is null"), least=1).count() == 0
    wide = odd.selectExpr("*", "1 as f", "'x' as phrase", "2 as words", "3 as rank", "4 as n", "5 as score", "6 as c")
    assert rows_of(phrases.collocations(wide, least=2)) == rows_of(phrases.collocations(odd, least=2))


def test_oracle(spark):
    assert compare(queries.op11_collocations(spark, SF), connect(SF), queries.OP11_SQL) == ""
