"""Personal data against a plain restatement of the fixed patterns."""

import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from textloom.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

TRICKY = [
    "a.b@c.d_e@f.gh x@y x@y.z. @no.com me@@you.com a@b.c@d.e", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.0255 1.2.3. 1.2.3.4", "é 4111 1111 1111 1111 😀 4111-1111-1111-1112 4111111111111111 12345678901234567890",
    "+1 (515) 555-6608 +12 +1 2 3 4 5 6 7 ++44 20 7946 0958. +1-2) (", "4" * 3000 + " " + "a" * 3000 + "@" + "b-" * 50 + ".c", "1 " * 2000, "+" + "1 " * 900, "", "call +1 (515) 555-6608 a.b@c.de 10.0.0.1 4111 1111 1111 1111 4111-1111-1111-1111",
]


def luhn(m):
    d = [int(c) for c in m if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def brute(text):
    found = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text, re.ASCII):
            n = sum(c.isdigit() for c in m[0])
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 16 <= n <= 19 and luhn(m[0]), "phone": 8 <= n <= 15}[kind]:
                found.append((kind, m.start(), m.end()))
    counts = Counter(k for k, *_ in found)
    said = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
    return *(counts[k] for k in PLAIN), hashlib.sha256(said.encode()).hexdigest(), said


def test_base_spans_equal_plain_patterns(spark, odd, sample):
    more = spark.createDataFrame(list(enumerate(TRICKY * 2, 500)), "doc_id long, text string")
    docs = odd.select("doc_id", "text").union(more).union(sample.select(F.col("doc_id") + 1000, "text")).repartition(3)
    got = pii.find(docs.withColumn("spans", F.lit(1))).collect()
    want = Counter((r.doc_id, *brute(r.text or "")) for r in docs.collect())
    base = lambda r: ",".join(x for x in r.spans.split(",") if x and not x.startswith("id:"))
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, base(r)) for r in got) == want
    assert pii.find(docs.limit(0)).count() == 0


def test_patterns_discover_identifiers(spark):
    rows = [(i, f"reach user{i}@mail.example.com today or badge 10.0.{i}.7 now") for i in range(30)]
    rows += [(100 + i, f"please reach ZX{i}K77Q9 today") for i in range(10)]
    rows += [(200 + i, f"released under version 2.{i}.0 of it") for i in range(30)]
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[100 + i] == f"id:13:{13 + len(f'ZX{i}K77Q9')}" for i in range(10))
    assert all(got[200 + i] == "" for i in range(30))


def test_mask(spark):
    text = "mail a@b.co and 1.2.3.4, card 4111 1111 1111 1111."
    df = spark.createDataFrame([(1, text, "x"), (2, None, "y"), (3, "nothing 😀", "z"), (None, "😀 a@b.co", "z")], "doc_id long, text string, spans string")
    got = [tuple(r) for r in pii.mask(df).orderBy("spans", F.desc("doc_id")).collect()]
    assert got == [(1, "mail <email> and <ip>, card <card>.", "x"), (2, None, "y"), (3, "nothing 😀", "z"), (None, "😀 <email>", "z")]


def test_an_identifier_reveals_another_context(spark):
    """Badges stand where seeds do; some of them stand in lockers too, and so other things in lockers are identifiers."""
    rows = [(i, f"reach user{i}@mail.example.com today or reach 10.0.{i}.7 now") for i in range(30)]
    rows += [(100 + i, f"please reach ZX{i}K77Q9 today, locker ZX{i}K77Q9") for i in range(10)]
    rows += [(200 + i, f"a locker QF{i}M41W3 is there") for i in range(3)] + [(300 + i, f"a shelf QF{i}M41W3, a rack QG{i}M41W3") for i in range(3)]
    got = {r.doc_id: r.spans.split(",") for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(len([x for x in got[100 + i] if x.startswith("id:")]) == 2 for i in range(10))
    assert all(got[200 + i] == ["id:9:17"] for i in range(3))  # by the second context
    assert all(got[300 + i] == ["id:8:16"] for i in range(3))  # as an instance, wherever it stands


def plain_scores(edges, rounds, confidence, support):
    s = {}
    for inst, _, _, _, seed in edges:
        s[inst] = max(s.get(inst, 0.0), float(seed))
    for _ in range(rounds):
        score = lambda at, v: sum(e[3] * s[e[0]] for e in edges if e[at] == v) / (sum(e[3] for e in edges if e[at] == v) + 2)  # noqa: B023, E731
        left, shapes = {e[1]: score(1, e[1]) for e in edges}, {e[2]: score(2, e[2]) for e in edges}
        backed = {v: sum(s[e[0]] >= confidence for e in edges if e[1] == v) for v in left}
        new = {}
        for inst, lf, sh, _, seed in edges:
            x = 1.0 if seed else round((left[lf] + shapes[sh]) / 2, 9) if backed[lf] >= support else 0.0
            new[inst] = max(new.get(inst, 0.0), x)
        s = new
    return s


def test_scores_equal_a_plain_restatement(spark):
    import random

    rng = random.Random(8)
    shape_of = {i: rng.choice("xyz") for i in range(60)}
    seeds = {i: rng.random() < 0.4 for i in range(60)}
    pairs = {(i, rng.choice(["a", "b", "c", "", "d"])) for i in range(60) for _ in range(3)}
    edges = [(i, w, shape_of[i], rng.randrange(1, 9), seeds[i]) for i, w in sorted(pairs)]
    df = spark.createDataFrame(edges, "inst long, left string, shape string, n long, seed boolean")
    got = {r.inst: r.s for r in pii.scored(df, 4, 0.5, 3).collect()}
    want = plain_scores(edges, 4, 0.5, 3)
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-8 for i in want)
    assert pii.scored(df.limit(0), 2, 0.5, 3).count() == 0


def test_long_and_odd_tokens(spark):
    """No length limit: words before and tokens of thousands of letters count whole, and short tokens have shapes too."""
    word, long = "w" * 500, "Z9" * 200
    rows = [(i, f"{word} user{i}@mail.example.com and id {i}x") for i in range(20)] + [(50, f"{word} {long}!"), (51, "x" * 3000 + "1" + "." * 3000), (52, "1 " * 3000 + "+")]
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[50] in ("", f"id:501:{501 + len(long)}") and got[52] == ""
    assert [r.s for r in spark.createDataFrame([("ab12cd-34.5",), ("7",), ("é9",), ("1-2",)], "t string").select(pii.shape(F.col("t")).alias("s")).collect()] == ["9-9.9:4", "9:1", "9:2", "9-9:2"]
