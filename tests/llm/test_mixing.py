import itertools
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from textloom.llm import mixing


def plain_targets(sizes, weights=(5, 2, 1), percent=150, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, done = Fraction(percent * sum(sizes.values()), 100), {}
    while True:
        left = [s for s in names if s not in done]
        total = sum(weight[s] for s in left)
        share = {s: (budget - sum(done.values())) * weight[s] / total for s in left}
        above = [s for s in left if share[s] > most * sizes[s]]
        if not above:
            return done | share
        done |= {s: Fraction(most * sizes[s]) for s in above}


def best(sizes, counts, budget):
    sums = {0}
    for s, c in zip(sizes, counts):
        sums = {x + s * k for x in sums for k in range(c + 1)}
    return min(abs(x - budget) for x in sums)


def test_subset_is_nearest():
    rng = random.Random(3)
    for _ in range(300):
        sizes = rng.sample(range(1, 40), rng.randint(1, 5))
        counts = [rng.randint(1, 4) for _ in sizes]
        total = sum(s * c for s, c in zip(sizes, counts))
        budget = rng.choice([rng.uniform(0, total), float(rng.randint(0, total)), total - 0.5, 0.5])
        got = mixing.subset(np.array(sizes), np.array(counts), budget)
        assert ((got >= 0) & (got <= counts)).all()
        near = abs(int((got * sizes).sum()) - budget)
        # The share of each size that is given first may cost a little where there are very few documents.
        assert near <= max(sizes)
        if len(sizes) > 2 and min(sizes) == 1 and sum(counts) > 12:
            assert near <= 1.0


def test_fill_is_nearest():
    rng = random.Random(4)
    for _ in range(300):
        sizes = np.array(rng.sample(range(1, 30), rng.randint(1, 5)))
        counts = np.array([rng.randint(1, 4) for _ in sizes])
        rest = rng.uniform(0, float((sizes * counts).sum()) / 2)
        taken = np.zeros(len(sizes), np.int64)
        mixing._fill(sizes, counts, taken, rest, np.argsort(-sizes))
        assert ((taken >= 0) & (taken <= counts)).all()
        assert abs(abs(int((taken * sizes).sum()) - rest) - best(sizes.tolist(), counts.tolist(), rest)) < 1e-9


def test_small_window_and_large_documents():
    sizes, counts = np.array([1, 2, 3, 50, 70, 1000]), np.array([40, 40, 40, 5, 5, 3])
    for budget in (10.0, 77.0, 1500.5, 3000.0, 3700.0):
        for window in (4, 64, 1 << 16):
            got = mixing.subset(sizes, counts, budget, window)
            assert abs(int((got * sizes).sum()) - budget) <= 0.5 and (got <= counts).all()
    assert mixing.subset(np.array([100_000]), np.array([3]), 160_000.0).tolist() == [2]
    assert mixing.subset(np.array([100_000]), np.array([3]), 90_000.0).tolist() == [1]
    assert mixing.subset(np.array([100_000]), np.array([3]), 20_000.0).tolist() == [0]


def checked(df, rows, tolerance):
    got = df.collect()
    assert len(got) == len(rows)
    words = defaultdict(int)
    for source, _, text in rows:
        words[source] += len([w for w in __import__("re").findall("[^ \t-\r]+", text or "")])
    want, taken = plain_targets(words), defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == words[r.source] and r.taken == r.copies * r["size"] and 0 <= r.taken <= 2 * r["size"]
        assert abs(r.target - float(want[r.source])) < 1e-6 * max(1, r.target)
    for s in words:
        assert abs(taken[s] - float(want[s])) <= tolerance, s
    return sorted(got, key=str)


def test_odd_and_random(spark, odd):
    rows = [(r.source, r.doc_id, r.text) for r in odd.collect()]
    checked(mixing.mix(odd), rows, 5000)
    rng = random.Random(8)
    rows = []
    for k in range(900):
        source = "big" if rng.random() < 0.4 else rng.choice(["a", "B", "é", "", None, "z😀", "10", "9"])
        rows.append((source, rng.choice([None, k, k, k]), rng.choice([None, "", " \n", "w " * rng.randint(1, 60), "w " * 7])))
    rows += [("big", 5, "same words here")] * 40
    df = spark.createDataFrame(rows, "source string, doc_id long, text string")
    first = checked(mixing.mix(df), rows, 1.0)
    assert first == sorted(mixing.mix(df.repartition(7)).collect(), key=str)
    assert first != sorted(mixing.mix(df, seed=99).collect(), key=str)


def test_many_sources(spark):
    rows = [(f"s{i:04}", i, "w " * (1 + i % 13)) for i in range(500)]
    got = mixing.mix(spark.createDataFrame(rows, "source string, doc_id long, text string"), percent=100)
    want = plain_targets({s: 1 + i % 13 for s, i, _ in rows}, percent=100)
    for r in got.collect():
        assert abs(r.target - float(want[r.source])) < 1e-6


@pytest.mark.parametrize("rows", [[], [("a", 1, "")], [(None, None, None)], [("a", 1, "one")]])
def test_tiny(spark, rows):
    got = mixing.mix(spark.createDataFrame(rows, "source string, doc_id long, text string")).collect()
    assert len(got) == len(rows) and all(r.taken <= 2 * r["size"] for r in got)


def test_clashing_columns(spark, odd):
    wide = odd.selectExpr("*", "1 as size", "'x' as key", "2 as bucket", "3 as u", "4 as c", "5 as target", "6 as base", "7 as place")
    assert sorted(mixing.mix(wide).collect(), key=str) == sorted(mixing.mix(odd).collect(), key=str)


def test_weights_repeat():
    assert list(itertools.islice(itertools.cycle((5, 2, 1)), 4)) == [5, 2, 1, 5]
    t = plain_targets({"a": 100, "b": 100, "c": 100, "d": 100})
    assert t["a"] == t["d"] == 200 and t["b"] + t["c"] == 200
