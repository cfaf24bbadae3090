import json
import time
from datetime import timedelta

from pyspark.sql import functions as F

from textloom import streaming as ingest

SCHEMA = "idempotency_key string, body string, published_at timestamp"


def test_submit_and_consume(spark):
    sent = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 1)], "idempotency_key string, published_at int")
    known = spark.createDataFrame([("b", "dead_letter"), ("c", "complete")], "idempotency_key string, status string")
    got = sorted((r.idempotency_key, r.published_at, r.status) for r in ingest.submit(sent, known).collect())
    assert got == [("a", 1, "pending"), ("a", 2, "duplicate"), ("b", 1, "duplicate"), ("c", 1, "duplicate")]
    assert ingest.submit(sent, known, retry_failed=True).filter("idempotency_key = 'b' and status = 'pending'").count() == 1
    fate = ingest.consume(ingest.submit(sent), known.filter("status = 'complete'"), (F.col("idempotency_key") == "b") | (F.col("attempt") < 2)).collect()
    assert sorted((r.idempotency_key, r.status, r.attempts) for r in fate) == [("a", "complete", 3), ("b", "dead_letter", 4), ("c", "skipped", 0)]


def test_stream_survives_a_restart(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()

    def send(name, *rows):
        (inbox / name).write_text("".join(json.dumps(r) + "\n" for r in rows))

    def run():
        raw = spark.readStream.text(str(inbox))
        parsed = ingest.parse_messages(raw, SCHEMA)
        work = lambda df: df.select("idempotency_key", F.upper("body").alias("text"))
        ingest.run_ingestion(parsed, work, F.col("body") == "bad", out, str(tmp_path / "checkpoint")).awaitTermination()

    at = "2024-01-01T00:00:00"
    send("1.json", {"idempotency_key": "a", "body": "x", "published_at": at}, {"idempotency_key": "a", "body": "x", "published_at": at}, {"idempotency_key": "b", "body": "bad", "published_at": at}, {"nonsense": 1})
    run()
    send("2.json", {"idempotency_key": "a", "body": "x", "published_at": at}, {"idempotency_key": "c", "body": "z", "published_at": at})
    run()
    assert sorted((r.idempotency_key, r.text) for r in spark.read.parquet(f"{out}/chunks").collect()) == [("a", "X"), ("c", "Z")]
    assert [r.idempotency_key for r in spark.read.parquet(f"{out}/dead_letter").collect()] == ["b"]


def test_deduplicated_stream(spark, tmp_path):
    (tmp_path / "a.json").write_text("".join(json.dumps({"idempotency_key": k, "body": "x", "published_at": "2024-01-01T00:00:00"}) + "\n" for k in "aab"))
    parsed = ingest.parse_messages(spark.readStream.text(str(tmp_path)), SCHEMA)
    query = ingest.deduplicated(parsed).writeStream.format("memory").queryName("dedup_test").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("dedup_test").count() == 2


def test_keys_expire(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()

    def run(name, *keys):
        (inbox / name).write_text("".join(json.dumps({"idempotency_key": k, "body": name, "published_at": f"2024-01-01T00:00:0{i}"}) + "\n" for i, k in enumerate(keys)))
        parsed = ingest.parse_messages(spark.readStream.text(str(inbox)), SCHEMA)
        ingest.run_ingestion(parsed, lambda df: df.select("idempotency_key", "body"), None, out, str(tmp_path / "checkpoint"), ttl=timedelta(seconds=12)).awaitTermination()

    run("1", "a", "b")
    began = time.time()
    run("2", "a", "c", "c")
    soon = time.time() - began
    time.sleep(13)
    run("3", "a", "d")
    got = sorted((r.idempotency_key, r.body) for r in spark.read.parquet(f"{out}/chunks").collect())
    assert ("a", "1") in got and ("a", "3") in got and ("d", "3") in got and got.count(("c", "2")) == 1
    assert soon > 12 or ("a", "2") not in got


def test_first_in_order_comes_through(spark, tmp_path):
    (tmp_path / "a.json").write_text("".join(json.dumps({"idempotency_key": "k", "body": b, "published_at": at}) + "\n" for b, at in [("late", "2024-01-02T00:00:00"), ("early", "2024-01-01T00:00:00"), ("none", None)]))
    parsed = ingest.parse_messages(spark.readStream.text(str(tmp_path)), SCHEMA)
    with ingest._rocks(spark):
        query = ingest.first_of_key(parsed).writeStream.format("memory").queryName("first_test").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r.body for r in spark.table("first_test").collect()] == ["early"]


def test_one_poison_message_of_a_thousand(spark):
    sent = spark.range(1000).select(F.col("id").cast("string").alias("idempotency_key"), "id")
    runs = []

    def work(given):
        runs.append(1)
        return given.select("idempotency_key", F.when(F.col("id") == 123, F.raise_error(F.lit("boom"))).otherwise(F.col("id")).cast("long").alias("id"))

    made, fates, dead = ingest.retried(sent, work)
    assert [(r.idempotency_key, r.retry_count) for r in dead.collect()] == [("123", 3)] and "boom" in dead.first().failure_reason
    assert made.count() == 999 == fates.filter("status = 'complete' and attempts = 2").count()
    assert [(r.idempotency_key, r.attempts) for r in fates.filter("status = 'dead_letter'").collect()] == [("123", 4)]
    assert len(runs) < 60
    made, fates, dead = ingest.retried(sent.filter("id > 100 and id < 130"), work, retries=0)
    assert made.count() == 28 and [r.idempotency_key for r in dead.collect()] == ["123"]


def test_poison_is_halved_without_runs_over_the_same_messages(spark):
    """Every run of an attempt has fewer messages than the one that it halves, and deep ones don't read all parts."""
    sent = spark.range(400).repartition(16).select(F.col("id").cast("string").alias("idempotency_key"), "id")
    seen, parts = [], []

    def work(given):
        seen.append((given.first().attempt, frozenset(r[0] for r in given.select("id").collect())))
        parts.append(given.rdd.getNumPartitions())
        return given.select("idempotency_key", F.when(F.col("id").isin(5, 77), F.raise_error(F.lit("boom"))).otherwise(F.col("id")).cast("long").alias("id"))

    made, fates, dead = ingest.retried(sent, work)
    assert len(seen) == len(set(seen)) and all(ids for _, ids in seen)
    assert parts[:2] == [16, 16] and min(parts) == 1
    assert made.count() == 398 and sorted(r.idempotency_key for r in dead.collect()) == ["5", "77"]
    assert "SortMergeJoin" not in fates._jdf.queryExecution().executedPlan().toString()


def test_poison_with_null_and_repeated_keys(spark):
    """A null key equals none, so it counts as come through; rows of a key share its fate, and each comes out."""
    sent = spark.createDataFrame([(None, 1), (None, 7), ("a", 1), ("a", 2), ("b", 7), ("b", 1), ("c", 3)], "idempotency_key string, id int")

    def work(given):
        return given.withColumn("id", F.when(F.col("id") == 7, F.raise_error(F.lit("boom")).cast("int")).otherwise(F.col("id")))

    made, fates, dead = ingest.retried(sent, work)
    said = lambda rows: sorted(((r.idempotency_key or "", r.status, r.attempts, bool(r.error)) for r in rows.collect()))
    assert said(fates) == [("", "complete", 1, False), ("a", "complete", 2, False), ("b", "dead_letter", 4, True), ("c", "complete", 2, False)]
    assert sorted((r.idempotency_key, r.id) for r in made.collect()) == [("a", 1), ("a", 2), ("c", 3)]
    assert sorted((r.idempotency_key, r.id) for r in dead.collect()) == [("b", 1), ("b", 7)]
    made, fates, dead = ingest.retried(sent, work, retries=0)
    assert said(fates) == [("", "complete", 1, False), ("", "dead_letter", 1, True), ("a", "complete", 1, False), ("b", "dead_letter", 1, True), ("c", "complete", 1, False)]
    assert said(ingest.retried(sent.limit(0), work)[1]) == []
