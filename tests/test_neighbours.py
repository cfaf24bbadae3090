import math
import re
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import neighbours, retrieval


def plain(q, x, distance):
    """A score by Python's floats in the order of the entries; None for null."""
    if q is None or x is None or None in q or None in x or (distance != "cosine" and len(q) != len(x)):
        return None
    dot = lambda a, b: reduce(lambda s, p: s + p[0] * p[1], zip(a, b), 0.0)  # noqa: E731  (sum() compensates)
    if distance == "dot":
        return dot(q, x)
    if distance == "euclid":
        d = [a - b for a, b in zip(q, x)]
        return -math.sqrt(dot(d, d))
    size = math.sqrt(dot(q, q)) * math.sqrt(dot(x, x))
    return 0.0 if size == 0 else dot(q, x) / size


@pytest.mark.parametrize("distance", ["cosine", "dot", "euclid"])
def test_equals_every_pair(spark, distance, monkeypatch):
    """Many copies, near copies, zero, short, empty, null and odd vectors: rank by rank as from every pair."""
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    monkeypatch.setattr(neighbours, "QUESTIONS", 7)
    rng = np.random.default_rng(4)
    v = [x.tolist() for x in rng.normal(size=(300, 6)).astype(np.float32)]
    v += [v[0]] * 120 + [[*v[1][:5], v[1][5] * (1 + 1e-6)]] * 3 + [[0.0] * 6, [1.0, 2.0], [], None, [1.0, None, 0, 0, 0, 0], [float("nan")] * 6, [1e200, 0, 0, 0, 0, 0]]
    rows = [(int(i), None if x is None else [None if e is None else float(e) for e in x]) for i, x in zip(rng.permutation(len(v)), v)]
    index = spark.createDataFrame(rows, "chunk_id long, vector array<double>")
    asked = [r for r in rows if r[0] % 25 == 0] + [r for r in rows[-7:]]
    got = {}
    for r in retrieval.dense(spark.createDataFrame(asked, "query_id long, q_vector array<double>"), index, 9, distance).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.chunk_id, r.score)
    show = lambda s: "nan" if s is not None and math.isnan(s) else s
    for i, q in set((i, None if q is None else tuple(q)) for i, q in asked):
        key = lambda r: (2, 0, r[1]) if r[0] is None else (0, 0, r[1]) if math.isnan(r[0]) else (1, -r[0], r[1])
        want = sorted([(plain(q, x, distance), j) for j, x in rows], key=key)[:9]
        assert [(got[i][n + 1][0], show(got[i][n + 1][1])) for n in range(9)] == [(j, show(s)) for s, j in want]


def test_pairs_do_not_become_rows(spark):
    """Questions and rows meet as blocks."""
    index = spark.range(10_000).select(F.col("id").alias("chunk_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vector"))
    found = retrieval.dense(index.select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("q_vector")), index, 1, "euclid")
    assert found.filter("query_id = chunk_id and score = 0").count() == 10_000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"MapInArrow.*q_data", plan) and "named_lambda" not in plan.lower()
