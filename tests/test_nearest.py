import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import retrieval
from textloom.sources.nearest import VectorIndex, recall

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(20, 24)) * 2
    of = rng.choice(20, 3000, p=[0.4] + [0.6 / 19] * 19)
    rows = [(i, v.tolist()) for i, v in enumerate((middle[of] + rng.normal(size=(3000, 24))).astype(np.float32))]
    rows += [(5000, None), (5001, []), (5002, [1.0]), (5003, [float("nan")] * 24), (5004, [0.0] * 24)]
    return spark.createDataFrame(rows, "chunk_id long, vector array<float>").repartition(5).persist()


@pytest.mark.parametrize("distance", ["cosine", "euclid"])
def test_recall_and_exact_scores(spark, clustered, tmp_path, distance):
    index = VectorIndex(spark, str(tmp_path / "i"))
    model = index.create(clustered, distance, rows=1500)
    assert 1 <= model.probes < len(model.centres)
    for i in range(3):
        index.add(clustered.filter(F.pmod("chunk_id", F.lit(3)) == i))
    asked = clustered.filter("chunk_id % 50 = 0 and size(vector) = 24").select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("q_vector"))
    whole = clustered.filter("size(vector) = 24 and not isnan(vector[0])")
    true = retrieval.dense(asked, whole, 10, distance)
    again = VectorIndex(spark, str(tmp_path / "i"))
    found = again.search(asked, 10).persist()
    got = [r.recall for r in recall(found, true).collect()]
    assert len(got) == asked.count() and sum(got) / len(got) >= 0.9
    exact = {(r.query_id, r.chunk_id): r.score for r in true.collect()}
    assert all(abs(exact[r.query_id, r.chunk_id] - r.score) < 1e-6 for r in found.collect() if (r.query_id, r.chunk_id) in exact)
    # All lists and all candidates: the exact result.
    everything = again.search(asked, 10, probes=10**6, depth=1000)
    assert {(r.query_id, r.chunk_id) for r in everything.collect()} == set(exact)


def test_other_lists_are_not_read(spark, clustered, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "i"))
    model = index.create(clustered, rows=1500)
    index.add(clustered)
    one = clustered.filter("chunk_id = 7").select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("q_vector"))
    plan = index.search(one, 5, probes=2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan or "list#" in plan.split("PartitionFilters: ")[1][:40]
    assert len(model.centres) > 2


def test_given_table(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    index = VectorIndex(spark, str(tmp_path / "i"))
    index.create(rows)
    index.add(rows)
    asked = rows.filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("q_vector"))
    got = [r.recall for r in recall(index.search(asked, 10), retrieval.dense(asked, rows, 10)).collect()]
    assert len(got) == 40 and sum(got) / len(got) >= 0.9


def test_errors(spark, clustered, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "i"))
    with pytest.raises(ValueError):
        index.create(clustered, "dot")
    with pytest.raises(ValueError):
        index.create(clustered.filter("vector is null"))
    index.create(clustered.limit(3))
    assert index.search(clustered.selectExpr("chunk_id as query_id", "vector as q_vector")).count() == 0


def test_candidates_are_not_dealt_out(spark, clustered, tmp_path):
    """With all lists and all candidates, and with some: the best of a task go on, not the candidates with their questions."""
    index = VectorIndex(spark, str(tmp_path / "i"))
    index.create(clustered, rows=1500)
    index.add(clustered)
    asked = clustered.filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("q_vector"))
    for options in ({"probes": 10**6, "depth": 10**6}, {"probes": 3}):
        plan = index.search(asked, 5, **options)._jdf.queryExecution().executedPlan().toString()
        assert "arrays_zip" not in plan and plan.count("Generate explode") == 0
    whole = clustered.filter("size(vector) = 24 and not isnan(vector[0])")
    want = {(r.query_id, r.chunk_id, r["rank"]): r.score for r in retrieval.dense(asked.filter("size(q_vector) = 24 and not isnan(q_vector[0])"), whole, 5).collect()}
    got = {(r.query_id, r.chunk_id, r["rank"]): r.score for r in index.search(asked, 5, probes=10**6, depth=10**6).collect()}
    assert got == want


def test_questions_are_not_copied_to_lists(spark, clustered, tmp_path):
    """Questions meet the blocks as blocks of their own; what is dealt out doesn't grow with the lists that they probe."""
    index = VectorIndex(spark, str(tmp_path / "i"))
    model = index.create(clustered, rows=1500)
    index.add(clustered)
    asked = clustered.filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("q_vector"))
    found = index.search(asked, 5, probes=3, depth=1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "hashpartitioning(list" not in plan
    # Of each of the three lists a question gets rows, in the exact order of those that it gets.
    rows = {r.chunk_id: np.array(r.vector) for r in clustered.filter("size(vector) = 24 and not isnan(vector[0])").collect()}
    lists = dict(zip(rows, model.lists(model.prepared(np.array(list(rows.values()))), 1)[:, 0]))
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    assert set(got) == {r for r in rows if r % 50 == 0}
    for q, of in got.items():
        assert len(of) == 5 and all(a >= b for (_, a), (_, b) in zip(of, of[1:]))
        assert {lists[i] for i, _ in of} <= set(model.lists(model.prepared(rows[q][None]), 3)[0])
        norm = lambda v: np.linalg.norm(v) or 1.0
        assert all(abs(s - rows[q] @ rows[i] / (norm(rows[q]) * norm(rows[i]))) < 1e-9 for i, s in of)


def test_coded_neighbours(spark):
    """The marked vectors are the nearest by sums over the codebooks, and only marked pairs count."""
    from textloom.operators import neighbours
    from textloom.sources.nearest import fit

    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 8))
    m = fit(x, 600, "euclid", parts=4)
    of = np.zeros(600, int)
    codes, q = m.encode(x, of), rng.normal(size=(9, 8))
    marks = m.nearest(q, 0, codes, 40)
    for i in range(9):
        table = (((q[i] - m.centres[0]).reshape(4, 1, -1) - m.books) ** 2).sum(2)
        off = table[np.arange(4), codes].sum(1)
        assert set(np.argsort(off, kind="stable")[:30]) <= set(np.flatnonzero(marks[i])) and 40 <= marks[i].sum() < 60
    best = neighbours.Best(5, "euclid")
    best.meet(list(range(9)), q, list(range(600)), x, marks)
    for i in range(9):
        want = sorted(np.flatnonzero(marks[i]), key=lambda j: ((q[i] - x[j]) ** 2).sum())[:5]
        assert [j for key, j, _ in best.rows() if key == i] == want
