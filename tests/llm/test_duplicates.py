"""Near duplicates and repeated passages against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.llm import graphs, neardup, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_near(rows, size, percent=80):
    """(doc_id, n_shingles, component_id, kept) for each row, from all pairs."""
    sets = []
    for i, x in rows:
        w = WORD.findall((x or "").translate(LOW))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a]) * 100 >= percent * len(sets[b]) and len(sets[b]) * 100 >= percent * len(sets[a]):
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(rows[a][0]), root(rows[b][0])))
                    parent[y] = x
    return [(i, len(s), root(i), root(i) == i) for (i, _), s in zip(rows, sets)]


def variants(seed, n, edits, length=120):
    """Texts that differ from one base in a few words each."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(length)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(edits)):
            words[rng.randrange(length)] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_brute_force(spark, odd, sample, size):
    rows = [(r.doc_id, r.text) for r in odd.filter("doc_id is not null").select("doc_id", "text").union(sample.select(F.col("doc_id") + 1000, "text")).collect()]
    rows += [(5000 + i, x) for i, x in enumerate(variants(1, 60, 9) + variants(2, 40, 14) + ["Same text here"] * 30 + ["SAME\ttext  here"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash")).repartition(3)
    got = Counter(tuple(r) for r in neardup.near_duplicates(df, size=size).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == Counter(brute_near(rows, size))


@pytest.mark.parametrize("size", [2, 5])
def test_links_between_documents_that_no_hub_joins(spark, size):
    """Far variants of one base, each with copies of its own that drop, add or cut a little more; ids in any order."""
    rng, texts = random.Random(size), []
    for far in variants(11, 40, 40, 200):
        words = far.split()
        for _ in range(rng.randrange(1, 5)):
            kind, at = rng.randrange(3), rng.randrange(150)
            words = words[: rng.randrange(150, 190)] if kind == 0 else words[:at] + words[at + 3 :] if kind == 1 else words[:at] + [f"u{rng.randrange(9)}"] + words[at:]
            texts.append(" ".join(words))
    ids = rng.sample(range(10**6), len(texts))
    rows = [*zip(ids, texts, strict=True), (ids[3], texts[60]), (ids[3], "another text of the same document"), (ids[5], texts[5])]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), size=size)
    want = Counter(brute_near(rows, size))
    assert Counter(tuple(r) for r in got.collect()) == want and 3 < len({c for _, _, c, _ in want}) < len(rows) - 3


def offered(rng, members, components, keys):
    """Offers of members of two hubs; component 0 of each hub is the hub's own."""
    rows = set()
    for a in range(members):
        hub, component = a % 2, rng.randrange(components)
        for _ in range(3):
            rows.add((hub, a, component, component != 0, rng.randrange(2), rng.randrange(2), rng.randrange(keys)))
    return sorted(rows)


OFFER = "b int, a int, component int, rest boolean, own int, partner int, edit int"


def test_meetings_equal_nested_loops(spark):
    rows = offered(random.Random(5), 90, 4, 5)
    want = set()
    for b, a, of_a, rest, own, partner, edit in rows:
        for b2, c, of_c, rest_c, own_c, partner_c, edit_c in rows:
            if (b, own, partner, edit) == (b2, partner_c, own_c, edit_c) and of_a != of_c and (rest or rest_c):
                want.add((min(a, c), max(a, c)))
    got = [tuple(r) for r in neardup.meetings(spark.createDataFrame(rows, OFFER)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_members_of_one_component_do_not_meet(spark):
    """What a key's join looks at is a matter of its components, whatever their members; one component alone gives nothing."""
    for n in (20, 40, 80):
        one = [(0, a, 1, True, 0, 0, 7) for a in range(n)]
        assert neardup.component_pairs(spark.createDataFrame(one, OFFER)).count() == 0
        two = [*one, (0, n, 2, True, 0, 0, 7)]
        assert neardup.component_pairs(spark.createDataFrame(two, OFFER)).count() == 2
        assert neardup.meetings(spark.createDataFrame(two, OFFER)).count() == n


def test_offers_of_two_clusters_grow_with_the_documents(spark, monkeypatch):
    """Two clusters of near copies that share three quarters of their text: pairs looked at across components."""
    seen = []
    plain = neardup.meetings

    def counted(offers):
        seen.append((offers.count(), neardup.component_pairs(offers).count()))
        return plain(offers)

    monkeypatch.setattr(neardup, "meetings", counted)
    rng = random.Random(9)
    first = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    second = first[:150] + [f"u{rng.randrange(10**6)}" for _ in range(50)]
    for n in (100, 200):
        rows = []
        for i in range(n):
            words = list((first, second)[i % 2])
            for _ in range(rng.randrange(7)):
                words[rng.randrange(200)] = f"v{rng.randrange(10**6)}"
            rows.append((i, " ".join(words)))
        got = Counter(tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect())
        assert got == Counter(brute_near(rows, 2))
    (_, small), (offers, large) = seen
    assert offers <= 100 * 200 and large <= 3 * max(small, 200)


def thue_morse(n, a, b):
    """The first n letters of the sequence, and their complement."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return [[a, b][x] for x in bits], [[b, a][x] for x in bits]


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_and_runs_of_two_letters_stay_apart(spark, n):
    """Polynomials modulo a power of two can't tell these apart."""
    x, y = thue_morse(n, "a", "b")
    rows = [(1, "".join(x)), (2, "".join(y)), (3, " ".join(x)), (4, " ".join(y)), (5, "".join(x) + " z" * 60), (6, "".join(y) + " z" * 60)]
    rows += [(7, " ".join(["".join(x), *map(str, range(60))])), (8, " ".join(["".join(y), *map(str, range(60))]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (2, n):
        assert Counter(tuple(r) for r in neardup.near_duplicates(df, size=size).collect()) == Counter(brute_near(rows, size))
    got = substrings.dedup(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == Counter(brute_removed(rows, 50))


def test_near_duplicates_of_nothing(spark):
    rows = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (1, None)], "doc_id long, text string")
    got = neardup.near_duplicates(rows)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == ["(1, 0, 1, True)", "(None, 1, None, True)", "(None, 1, None, True)"]
    assert neardup.near_duplicates(rows.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(0, 50)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.id: r.component for r in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 90: 90, 95: 90, 100: 90}


def test_components_of_a_path_in_any_order(spark):
    ids = list(range(600))
    random.Random(4).shuffle(ids)
    edges = [*zip(ids[:500], ids[1:500], strict=False), *zip(ids[500:], ids[501:], strict=False), (7, 7), (None, 3)]
    got = {r.id: r.component for r in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(ids[:500], min(ids[:500])) | dict.fromkeys(ids[500:], min(ids[500:]))
    with pytest.raises(RuntimeError):
        graphs.components(spark.createDataFrame(edges, "a long, b long"), rounds=1)


def brute_removed(rows, window):
    """(doc_id, n_words, n_removed, kept_sha256) for each row."""
    first = {}
    for i, x in rows:
        w = WORD.findall(x or "")
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, x in rows:
        w = WORD.findall(x or "")
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(v for k, v in enumerate(w) if k not in gone).encode()).hexdigest()))
    return out


def test_substrings_equal_brute_force(spark, odd, sample):
    rng = random.Random(5)
    passage = [f"p{rng.randrange(99)}" for _ in range(90)]
    mixed = []
    for i in range(60):
        own = [f"q{rng.randrange(9999)}" for _ in range(rng.randrange(120))]
        a = rng.randrange(40)
        mixed.append((9000 + i, " ".join(own + passage[a : a + rng.randrange(90)] + own[:30] + ["loop", "loop"] * rng.randrange(60))))
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").union(sample.select(F.col("doc_id") + 1000, "text")).collect()]
    rows += mixed + [(500, rows[20][1]), (9999, rows[30][1]), (9999, rows[30][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = substrings.dedup(df, with_text=True).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out) == Counter(brute_removed(rows, 50))
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in out if r.n_removed)
    assert substrings.dedup(df.limit(0)).count() == 0


def test_index_compacts_and_marks(spark):
    index = substrings.FingerprintIndex(spark, fanout=2)
    batch = lambda rows, s=spark: s.createDataFrame(rows, "anchor long, doc_id long")
    assert index.ingest(batch([(1, 1), (2, 1), (2, 1)])).count() == 0
    assert [r.anchor for r in index.ingest(batch([(2, 2), (3, 2), (4, 3), (4, 2)])).orderBy("anchor").collect()] == [2, 4]
    assert len(index.runs) == 1
    other = spark.newSession()  # knows nothing but the path
    index = substrings.FingerprintIndex(other, index.path, fanout=2)
    assert [r.anchor for r in index.ingest(batch([(1, 9), (2, 9)], other)).orderBy("anchor").collect()] == [1, 2]
    assert sorted(r.anchor for r in index.shared().collect()) == [1, 2, 4]
    assert sorted(tuple(r) for r in index.run(index.runs[0]).collect()) == [(1, 1, 9), (2, 1, 9), (3, 2, 2), (4, 2, 3)]
    index.drop()
    assert substrings.FingerprintIndex(spark, index.path).runs == []


def test_substrings_drop_clashing_columns(spark):
    rows = [(1, "a " * 60), (2, "a " * 60), (None, "a " * 60), (2, "a " * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("copy", F.lit("x")).withColumn("n_words", F.lit("x")).withColumn("anchors", F.lit(0))
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in substrings.dedup(df).collect())
    assert got == {(1, 60, 0): 1, (2, 60, 60): 2, (None, 60, 0): 1}
