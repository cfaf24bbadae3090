import csv
import io
import json

import pytest
from pyspark.sql import functions as F

from textloom import sources
from textloom import streaming as ingest
from textloom.operators import caching, chunkers, graph, retrieval, tables
from textloom.operators.windows import COUNTERS, WindowConfig, subword_counter, windows
from textloom.plans import available, create
from textloom.sources import stores


def test_json_and_csv_equal_plain_writers(spark):
    cases = [(["a", "b"], [["1", "x"], ["2", 'q"u,o\nte']]), (["a", "a"], [["1", "2"]]), (["only"], [[""], ["\\ é\t"]]), (["a", "b"], [["short"], ["l", "o", "ng"]]), (["a"], [])]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t struct<headers:array<string>,rows:array<array<string>>>")
    got = df.select("t.*", tables.as_json(F.col("t.headers"), F.col("t.rows")).alias("j"), tables.as_csv(F.col("t.headers"), F.col("t.rows")).alias("c")).collect()
    for r in got:
        out = io.StringIO()
        csv.writer(out).writerows([r.headers, *r.rows])
        assert r.c == out.getvalue().strip()
        assert r.j == json.dumps([dict(zip(r.headers, x, strict=False)) for x in r.rows], indent=2, ensure_ascii=False)


def test_collections(spark, tmp_path):
    root = str(tmp_path)
    assert stores.ensure_collection(spark, root, "c", 2, "dot") and not stores.ensure_collection(spark, root, "c", 2)
    assert stores.collection_info(spark, root, "c").first().vectors == 0 and stores.vectors(spark, root, "c") is None
    rows = lambda *x: spark.createDataFrame(x, "chunk_id string, vector array<float>")
    for _ in range(3):
        stores.put_vectors(rows(("a", [1.0, 2.0]), ("b", [3.0, 4.0])), root, "c")
    stores.put_vectors(rows(("b", [5.0, 6.0])), root, "c")
    assert sorted(tuple(r) for r in stores.vectors(spark, root, "c").collect()) == [("a", [1.0, 2.0]), ("b", [5.0, 6.0])]
    assert stores.collection_info(spark, root, "c").first().vectors == 2
    with pytest.raises(Exception, match="2 dimensions"):
        stores.put_vectors(rows(("z", [1.0])), root, "c")
    with pytest.raises(ValueError):
        stores.put_vectors(rows(("z", [1.0, 1.0]), ("z", [1.0, 2.0])), root, "c")
    assert stores.delete_collection(spark, root, "c") and not stores.delete_collection(spark, root, "c")


def test_writes_are_as_large_as_their_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    stores.upsert_table(spark.range(20000).selectExpr("id AS k", "'old' AS v"), path, "k")
    first = stores._live(stores.Manifest(spark, path).read()[1])
    for n in range(3):
        stores.upsert_table(spark.range(n * 100, n * 100 + 200).selectExpr("id AS k", f"'new{n}' AS v"), path, "k")
    live = stores._live(stores.Manifest(spark, path).read()[1])
    assert live[0]["folder"] == first[0]["folder"] and sum(p["rows"] for p in live[1:]) == 600
    want = {k: "old" for k in range(20000)} | {k: f"new{n}" for n in range(3) for k in range(n * 100, n * 100 + 200)}
    assert dict(map(tuple, stores.read_latest(spark, path).collect())) == want
    stores.delete_keys(spark.createDataFrame([(5,), (19999,), (77777,), (None,)], "k long"), path)
    want = {k: v for k, v in want.items() if k not in (5, 19999)}
    live = stores._live(stores.Manifest(spark, path).read()[1])
    assert len(live) == 2 and live[0]["folder"] == first[0]["folder"], "four small parts are one, the large one stays"
    assert dict(map(tuple, stores.read_latest(spark, path).collect())) == want
    assert dict(map(tuple, stores.find(spark, path, [4, 5, 299, 300, 19999]).collect())) == {4: "new0", 299: "new2", 300: "new2"}
    stores.upsert_table(spark.createDataFrame([(5, "back")], "k long, v string"), path, "k")
    assert stores.find(spark, path, [5]).first().v == "back"


def test_equal_writes_are_merged_in_tiers(spark, tmp_path):
    path, want = str(tmp_path / "t"), {}
    for n in range(9):
        stores.upsert_table(spark.range(n * 300, n * 300 + 600).selectExpr("id AS k", f"{n} AS v"), path, "k")
        want |= {k: n for k in range(n * 300, n * 300 + 600)}
        stores.delete_keys(spark.range(n * 300, n * 300 + 1).withColumnRenamed("id", "k"), path)
        want.pop(n * 300)
        assert dict(map(tuple, stores.read_latest(spark, path).collect())) == want
        assert len(stores._live(stores.Manifest(spark, path).read()[1])) <= 6
    with pytest.raises(ValueError):
        stores.upsert_table(spark.createDataFrame([(None, 1)], "k long, v int"), path, "k")
    with pytest.raises(ValueError):
        stores.upsert_table(spark.createDataFrame([(1, 1), (1, 2)], "k long, v int"), path, "k")
    assert dict(map(tuple, stores.read_latest(spark, path).collect())) == want


def test_two_writers_keep_their_rows(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "t")
    put = lambda n: stores.upsert_table(spark.range(n * 10, n * 10 + 10).selectExpr("id AS k", f"{n} AS v"), path, "k")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(put, range(10)))
    assert dict(map(tuple, stores.read_latest(spark, path).collect())) == {k: k // 10 for k in range(100)}


def test_an_empty_table(spark, tmp_path):
    path, none = str(tmp_path / "t"), spark.createDataFrame([], "k long, v string")
    assert stores.read_latest(spark, path) is None and stores.find(spark, path, [1]) is None
    stores.upsert_table(none, path, "k")
    assert stores.read_latest(spark, path).count() == 0
    stores.upsert_table(spark.createDataFrame([("x", 1, 0)], "v string, k long, more int"), path, "k")
    assert stores.read_latest(spark, path).columns == ["k", "v"] and stores.upsert_table(none, path, "k") and stores.read_latest(spark, path).count() == 1


def test_files_go_up_and_down(spark, tmp_path):
    (tmp_path / "x.txt").write_text("hello")
    sources.upload(spark, str(tmp_path / "x.txt"), str(tmp_path / "store"), "in/x.txt")
    assert sources.exists(spark, str(tmp_path / "store/in/x.txt"))
    sources.download(spark, str(tmp_path / "store"), "in/x.txt", str(tmp_path / "y.txt"))
    assert (tmp_path / "y.txt").read_text() == "hello"
    with pytest.raises(ValueError):
        sources.upload(spark, str(tmp_path / "x.txt"), str(tmp_path), "../x.txt")


def test_work_that_breaks_off_is_tried_again(spark):
    sent = spark.createDataFrame([("a", 0), ("b", 2), ("c", 9)], "idempotency_key string, fails int")
    tries = []

    def work(df):
        tries.append(df.count())
        if len(tries) == 1:
            raise OSError("store is away")
        return df.withColumn("error", F.when(F.col("attempt") < F.col("fails"), "too early"))

    made, fates, dead = ingest.retried(sent, work)
    assert sorted((r.idempotency_key, r.status, r.attempts) for r in fates.collect()) == [("a", "complete", 2), ("b", "complete", 3), ("c", "dead_letter", 4)]
    assert tries == [3, 3, 2, 1] and sorted(r.idempotency_key for r in made.collect()) == ["a", "b"]
    assert [(r.idempotency_key, r.failure_reason, r.retry_count) for r in dead.collect()] == [("c", "too early", 3)]


def test_statuses_are_compacted(spark, tmp_path):
    path = str(tmp_path / "status")
    for n in (1, 50, 100, 101):
        spark.createDataFrame([(f"k{n}", "complete")], "idempotency_key string, status string").write.parquet(f"{path}/batch={n}")
    ingest._compact(spark, path, 100)
    assert sorted(r.idempotency_key for r in ingest._status(spark, path, 102).collect()) == ["k1", "k100", "k101", "k50"]
    assert sorted(r.idempotency_key for r in ingest._status(spark, path, 60).collect()) == ["k1", "k50"]


def test_subword_windows(spark):
    import public_tokenizers

    COUNTERS["test_bpe"] = count = subword_counter(public_tokenizers.path("byte_bpe_50k.json"))
    df = spark.createDataFrame([("some words that a tokenizer cuts into unbelievably many pieces " * 5,)], "text string")
    got = [r.window for r in windows(df, "text", WindowConfig(size=12, overlap=2, boundary=False, counter="test_bpe")).collect()]
    assert len(got) > 3 and all(count(x) <= 12 for x in got)


def test_windows_with_counts(spark):
    df = spark.createDataFrame([(1, "a b c d e f g", "n"), (2, "  ", "n"), (3, None, "n"), (4, "x", "n")], "id int, text string, n string")
    got = windows(df, "text", WindowConfig(size=3, overlap=1, boundary=False), count="n").collect()
    assert [(r.id, r.window_index, r.window, r.n) for r in got] == [(1, 0, "a b c", 3), (1, 1, "c d e", 3), (1, 2, "e f g", 3), (4, 0, "x", 1)]


def test_image_pages(spark):
    pages = spark.createDataFrame([(1, 1, "text of a page"), (1, 2, " ")], "doc_id int, page int, text string")
    regions = spark.createDataFrame([(1, 1, 0, 100, 100, "png", b"ab"), (1, 2, 0, 10, 10, "png", b"c")], "doc_id int, page int, image_index int, width int, height int, ext string, bytes binary")
    kinds = lambda h: [(r.page, r.is_image) for r in chunkers.chunk_image_pages(pages, regions, handling=h).orderBy("chunk_index").collect()]
    assert kinds("skip") == [(1, False)] and kinds("both") == kinds("extract") == [(1, False), (1, True)] and kinds("caption") == [(1, True)]
    assert chunkers.chunk_images(regions).first().image_base64 == "YWI="
    with pytest.raises(ValueError):
        kinds("other")


def test_entities_and_runs(spark):
    e = spark.createDataFrame([("1", "Ann", "ann", "PERSON", "a"), ("2", "Bob", "bob", "PERSON", "b")], "id string, name string, name_normalised string, entity_type string, collection string")
    assert [r.id for r in graph.list_entities(e, "a", "person").collect()] == ["1"] and graph.list_entities(e, "a", "CITY").count() == 0
    assert graph.entities_by_name(e, spark.createDataFrame([(" BOB ",)], "name string"), "b").first().id == "2"
    chunks = spark.createDataFrame([("d", "c", "x")], "doc_id string, collection string, chunk_id string")
    assert graph.run_log(chunks).first().status == "running"


def test_cache_and_embedder(spark):
    cache = spark.createDataFrame([("emb:a", [1.0]), ("old:b", [1.0]), ("emb:c", None)], "key string, vector array<float>")
    assert caching.flush(cache).count() == 1 and caching.invalidate(cache, cache.filter("key = 'emb:a'")).count() == 2
    assert [r.error for r in caching.readable(cache, 1).orderBy("key").collect()] == [False, True, False]
    texts = spark.createDataFrame([("a b a",), (" ",)], "text string")
    assert [sum(r.vector) for r in retrieval.embed(texts, 8).collect()] == [3.0, 0.0]
    with pytest.raises(Exception, match="blank text"):
        retrieval.embed(texts, 8, blank="error").collect()


def test_registry():
    assert {"graph", "hybrid"} <= set(available("retriever")) and create("retriever", "graph") is graph.graph_retrieve
