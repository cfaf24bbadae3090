import math

import numpy as np
import pytest

from textloom.llm import whitening

SF = "/root/testdata/sf0.001"


def plain(rows, most=16):
    sizes = [len(v) for _, v in rows if v]
    d = max(set(sizes), key=lambda s: (sizes.count(s), s))
    good = [(k, [math.floor(64.0 * c) + 1_000_000 for c in v]) for k, v in rows if v and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array(sorted({tuple(v) for _, v in good}), object)
    n, s = len(x), x.sum(axis=0)
    centred = ((n * x - s) / n).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:most]
    out = []
    for k, v in good:
        q = n * np.array(v, object) - s
        y = (q / n).astype(float) @ vectors[:, order] / np.sqrt(values[order])
        out += [(k, i + 1, n, int((q * q).sum()), abs(y[i]), values[order][i] / values.sum()) for i in range(len(order))]
    return sorted(out, key=str)


def agree(df, want):
    got = df.collect()
    rows = sorted([(r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in got], key=str)
    key = lambda r: (str(r[0]), r[1], r[3], round(r[4], 6))
    assert len(rows) == len(want)
    for a, b in zip(sorted(rows, key=key), sorted(want, key=key)):
        assert a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-7 and abs(a[5] / b[5] - 1) < 1e-9
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    return got


@pytest.fixture(scope="module")
def mixed():
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=5) * [5, 3, 2, 1, 0.5] + 0.3).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)] + [rows[3], rows[3], (None, rows[4][1])]
    rows += [(1, None), (2, []), (3, [1.0, None, 2.0, 3.0, 4.0]), (4, [1.0, float("nan"), 2.0, 3.0, 4.0]), (5, [float("inf")] * 5), (6, [-float("inf")] * 5), (7, [1.0, 2.0])]
    return rows


@pytest.mark.parametrize("tile", [2, 3, 32])
def test_plain(spark, mixed, tile):
    df = spark.createDataFrame(mixed, "vec_id long, embedding array<double>")
    got = agree(whitening.whiten(df, tile=tile), plain(mixed))
    assert got[0].n == 300


def test_one_sign(spark, mixed):
    df = spark.createDataFrame(mixed, "vec_id long, embedding array<double>")
    a = {}
    for r in whitening.whiten(df).collect():
        a.setdefault((r.vec_id, r.component), set()).add(r.whitened)
    assert all(len(v) == 1 for k, v in a.items() if k[0] is not None)
    fit = {k: next(iter(v)) for k, v in a.items()}
    for c in range(1, 6):
        y = np.array([fit[i, c] for i in range(300)])
        assert abs(y.mean()) < 1e-9 and abs((y * y).mean() - 1) < 1e-9


def test_given_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    agree(whitening.whiten(df), plain([(r.vec_id, r.embedding) for r in df.collect()]))


def test_large_entries(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=4) * 1e12).tolist()) for i in range(50)] + [(99, [1e300, -1e300, 0.0, 1.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert got and all(r.deviation is None for r in got)
    agree(whitening.whiten(spark.createDataFrame([(i, [c * 1e-9 for c in v]) for i, v in rows[:50]], "vec_id long, embedding array<double>")), plain([(i, [c * 1e-9 for c in v]) for i, v in rows[:50]]))


def test_exact_deviation():
    w = whitening.Whitening(2, 3, [3_000_000, 3_000_005], np.eye(2), 2)
    x = np.array([[1_000_000, 1_000_002], [1_000_000 + 2**28, 0], [2**60, 5]], np.int64)
    want = [sum((3 * int(v) - s) ** 2 for v, s in zip(row, w.sums)) for row in x]
    assert w.deviation(x) == [v if v < 2**63 else None for v in want] and want[1] < 2**63 < want[2]
    assert w.deviation(x[:1]) == want[:1]


def test_pack_round_trip():
    x = np.array([[1_000_000, 999_999], [1_000_000 + 32767, 1_000_000 - 32767], [2**61, -5]], np.int64)
    assert (whitening.unpack(whitening.pack(x), 2) == x).all()


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None)], [(1, [])], [(1, [2.0, 3.0])], [(1, [2.0, 3.0]), (2, [2.0, 3.0])], [(1, [float("nan")])]):
        df = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
        assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and df.count() == 0


def test_rank_and_columns(spark):
    rows = [(i, [float(i), 2.0 * i, 7.0], "x", 1.0) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component string, n double")
    got = whitening.whiten(df).collect()
    assert {r.component for r in got} == {1} and len(got) == 20
