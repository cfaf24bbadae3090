"""Ingestion: idempotent submission, processing with retries, dead letters; in batch and as a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.graph import _cut

MAX_RETRIES = 3


def idempotency_key(filename: Column, collection: Column, given: Column | None = None) -> Column:
    """The caller's key, or the first 32 hex digits of sha256("filename::collection")."""
    made = F.substring(F.sha2(F.concat(filename, F.lit("::"), collection), 256), 1, 32)
    return made if given is None else F.coalesce(given, made)


def submit(messages: DataFrame, known: DataFrame | None = None, retry_failed: bool = False, order: str = "published_at") -> DataFrame:
    """messages (idempotency_key, ...) with status: pending for the first of each new key, else duplicate. A key in
    `known` (idempotency_key, status) is taken in any status; retry_failed: but for dead_letter."""
    w = Window.partitionBy("idempotency_key").orderBy(order)
    rows = messages.withColumn("_n", F.row_number().over(w))
    taken = F.lit(False)
    if known is not None:
        old = known.filter("status <> 'dead_letter'") if retry_failed else known
        rows = rows.join(old.select("idempotency_key", F.lit(True).alias("_known")).distinct(), "idempotency_key", "left")
        taken = F.coalesce("_known", F.lit(False))
    return rows.withColumn("status", F.when((F.col("_n") > 1) | taken, "duplicate").otherwise("pending")).drop("_n", "_known")


def consume(messages: DataFrame, completed: DataFrame, fails: Column, retries: int = MAX_RETRIES) -> DataFrame:
    """One row per pending key with its fate: skipped if completed before; complete after `attempts` tries; or dead_letter
    after 1 + retries. `fails` is a column over message and attempt (from 0), true where that try fails."""
    todo = messages.filter("status = 'pending'").join(completed.select("idempotency_key", F.lit(True).alias("_done")).distinct(), "idempotency_key", "left")
    tries = todo.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(retries)))).withColumn("_ok", ~F.coalesce(fails, F.lit(False)))
    fate = tries.groupBy("idempotency_key").agg(F.first("_done").alias("_done"), F.min(F.when(F.col("_ok"), F.col("attempt"))).alias("good"))
    status = F.when(F.col("_done"), "skipped").when(F.col("good").isNotNull(), "complete").otherwise("dead_letter")
    return fate.select("idempotency_key", status.alias("status"), F.when(F.col("_done"), 0).otherwise(F.coalesce(F.col("good") + 1, F.lit(retries + 1))).alias("attempts"))


def parse_messages(raw: DataFrame, schema: str) -> DataFrame:
    """(value) as JSON to columns; what can't be read is dropped."""
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("m")).select("m.*").filter("idempotency_key is not null")


def deduplicated(stream: DataFrame, event_time: str = "published_at", delay: str = "1 day") -> DataFrame:
    """The first message of each key, remembered for `delay` of event time."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["idempotency_key"])


def _tried(given: DataFrame, work: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame | None, str]:
    """What work makes of messages, written to the shared folder; None and the error where it raises."""
    try:
        return _cut(work(given)), ""
    except Exception as x:
        return None, str(x)[:1000]


def _halved(given: DataFrame, work: Callable[[DataFrame], DataFrame], error: str, held: int | None = None) -> tuple[list[DataFrame], list[tuple]]:
    """What work makes of messages on which it raised `error`, and the keys it breaks off on, each with its error.

    The messages are halved by the lowest bit in which hashes of their keys differ, so neither half is empty, and each half is
    tried alone, until those that raise stand alone: about 2 log2(n) runs for one among n. Once a quarter or less is left of
    the `held` messages that are read for a half, it is written anew in as many fewer parts, so deep halves don't read all.
    """
    key = F.xxhash64("idempotency_key")
    rows, some, every = given.agg(F.count("*"), F.bit_or(key), F.bit_and(key)).first()
    if not rows or some == every:
        return [], [(r[0], error) for r in given.select("idempotency_key").distinct().collect()]  # one, but for equal hashes
    held = held or rows
    if 4 * rows <= held:
        given, held = _cut(given.coalesce(-(-given.rdd.getNumPartitions() * rows // held))), rows
    differ = some ^ every
    side = F.shiftrightunsigned(key, (differ & -differ).bit_length() - 1).bitwiseAND(F.lit(1))
    done, broken = [], []
    for half in (0, 1):
        part = given.filter(side == half)
        out, error = _tried(part, work)
        more_done, more_broken = _halved(part, work, error, held) if out is None else ([out], [])
        done, broken = done + more_done, broken + more_broken
    return done, broken


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def retried(messages: DataFrame, work: Callable[[DataFrame], DataFrame], retries: int = MAX_RETRIES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Run work on messages, and again on those that failed, 1 + retries times at most.

    work gets messages with `attempt` (from 0) and gives rows with idempotency_key and, where a message failed, `error`.
    Where the first attempt raises, it has failed for all, as in an outage, and all are tried again; where a later one
    raises, the messages that make it raise are set apart from the others (see `_halved`), so one bad message takes none
    along. Returns what work made of the messages that came through, their fates (idempotency_key,
    status, attempts, error), and the dead letters with failure_reason and retry_count. What an attempt made is written to
    the shared folder, so work runs once for each attempt that doesn't raise.
    """
    spark, todo = messages.sparkSession, _cut(messages)
    failed = StructType([StructField("idempotency_key", todo.schema["idempotency_key"].dataType), StructField("error", StringType())])
    made, fates = [], []
    for attempt in range(retries + 1):
        given = todo.withColumn("attempt", F.lit(attempt))
        out, error = _tried(given, work)
        if out is None and attempt == 0 and retries:
            # All have failed, so none is looked up; a null key, which equals none, counts as come through.
            bad = todo.select("idempotency_key").distinct().withColumn("error", F.lit(error))
            through, todo = todo.filter("idempotency_key is null"), todo.filter("idempotency_key is not null")
        else:
            outs, broken = _halved(given, work, error) if out is None else ([out], [])
            # Keys that broke off came to the driver one by one, each after runs of its own, so they are few.
            bad = F.broadcast(spark.createDataFrame(broken, failed))
            told = [out.filter("error is not null").select("idempotency_key", "error") for out in outs if "error" in out.columns]
            if told:
                bad = _cut(_union([*told, bad]).groupBy("idempotency_key").agg(F.min("error").alias("error")))
            if outs:
                made.append(_union([out.drop("error") for out in outs]).join(bad, "idempotency_key", "left_anti"))
            through = todo.join(bad, "idempotency_key", "left_anti")
            todo = _cut(todo.join(bad.select("idempotency_key"), "idempotency_key", "left_semi"))
        fates.append(through.select("idempotency_key").distinct().select("idempotency_key", F.lit("complete").alias("status"), F.lit(attempt + 1).alias("attempts"), F.lit(None).cast("string").alias("error")))
        if attempt == retries:
            fates.append(bad.select("idempotency_key", F.lit("dead_letter").alias("status"), F.lit(attempt + 1).alias("attempts"), "error"))
        if todo.isEmpty():
            break
    dead = todo.join(bad.select("idempotency_key", F.col("error").alias("failure_reason")), "idempotency_key").withColumn("retry_count", F.lit(retries))
    return _union(made) if made else spark.createDataFrame([], messages.schema), _union(fates), dead


class FirstSeen(StatefulProcessor):
    """Lets the first message of a key through and remembers the key for `ttl` of processing time after that."""

    def __init__(self, order: str, ttl: timedelta):
        self.order, self.ttl = order, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", int(self.ttl.total_seconds() * 1000))

    def handleInputRows(self, key, rows, timer_values) -> Iterator:
        if self.seen.exists():
            return
        first = None
        for row in rows:
            at = row[self.order]
            if first is None or (at is not None and (first[0] is None or at < first[0])):
                first = (at, row)
        self.seen.update((True,))
        yield first[1]

    def close(self) -> None:
        pass


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """Queries that start within keep their state in RocksDB, on the executors' disks and in the checkpoint folder, and run
    no batches without data, which keys that expire don't need (such batches would follow each other without end)."""
    keys = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def first_of_key(stream: DataFrame, order: str = "published_at", ttl: timedelta = timedelta(hours=24)) -> DataFrame:
    """The first message of each key by `order` in its micro-batch; later ones are duplicates until `ttl` has passed. Keys
    are state: no table of earlier ones is read. The query must be started with RocksDB state, see `run_ingestion`."""
    return stream.groupBy("idempotency_key").transformWithState(FirstSeen(order, ttl), stream.schema, "Append", "ProcessingTime")


def run_ingestion(stream: DataFrame, process: Callable[[DataFrame], DataFrame], fails: Column | None, tables: str, checkpoint: str, retries: int = MAX_RETRIES, available_now: bool = True, ttl: timedelta = timedelta(hours=24)):
    """Start a query that writes each micro-batch: what process() makes of messages to tables/chunks, fates to
    tables/status, dead letters to tables/dead_letter. process() is run again on messages that failed: those with `error`,
    those that make it raise, and those for which `fails`, a column over message and attempt, is true.

    A key that came within `ttl` is a duplicate; keys are kept as state, in the checkpoint, so a batch costs the same however
    many went before, and a restart goes on from them. Files of a batch lie under its number and are overwritten when the
    batch is run again, so a restart leaves no second copy.
    """

    def work(given: DataFrame) -> DataFrame:
        if fails is None:
            return process(given)
        bad = F.coalesce(fails, F.lit(False))
        out = process(given.filter(~bad))
        out = out if "error" in out.columns else out.withColumn("error", F.lit(None).cast("string"))
        return out.unionByName(given.filter(bad).select("idempotency_key", F.lit("processing failed").alias("error")), allowMissingColumns=True)

    def one(batch: DataFrame, number: int) -> None:
        made, fates, dead = retried(batch, work, retries)
        for name, df in (("chunks", made), ("dead_letter", dead), ("status", fates)):
            df.write.mode("overwrite").parquet(f"{tables}/{name}/batch={number}")

    with _rocks(stream.sparkSession):
        writer = first_of_key(stream, ttl=ttl).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_status(statuses: DataFrame, keys: DataFrame | None = None, key: str = "idempotency_key", order: str = "batch") -> DataFrame:
    """The last status of each key, or of the keys asked for; a key that was never seen has none."""
    last = statuses.groupBy(key).agg(F.max_by(F.struct(*[c for c in statuses.columns if c != key]), order).alias("s")).select(key, "s.*")
    return last if keys is None else keys.select(key).distinct().join(last, key, "left")


def statuses(spark: SparkSession, tables: str, number: int, compact: bool = False) -> DataFrame | None:
    """(idempotency_key, status) of a stream's batches before `number`, for lookups; the stream itself doesn't read them.
    compact: first write those up to the last hundred as one folder."""
    if compact and number > 100:
        _compact(spark, f"{tables}/status", (number - 1) // 100 * 100)
    return _status(spark, f"{tables}/status", number)


def _compact(spark: SparkSession, path: str, number: int) -> None:
    """Statuses of the batches up to this one as one folder, which replaces them for readers."""
    spark.read.parquet(path).filter(F.col("batch") <= number).dropDuplicates(["idempotency_key"]).drop("batch").coalesce(8).write.mode("overwrite").parquet(f"{path}_compact/upto={number}")


def _status(spark: SparkSession, path: str, number: int) -> DataFrame | None:
    """Statuses of earlier batches: the last compacted folder, and the batches after it."""
    from ..sources import exists

    if not exists(spark, path):
        return None
    start = (number - 1) // 100 * 100
    found = spark.read.parquet(path).filter(F.col("batch") < number).select("idempotency_key", "status", "batch")
    if start and exists(spark, f"{path}_compact/upto={start}/_SUCCESS"):
        old = spark.read.parquet(f"{path}_compact/upto={start}").select("idempotency_key", "status")
        return old.unionByName(found.filter(F.col("batch") > start).select("idempotency_key", "status"))
    return found.select("idempotency_key", "status")


def statistics(stream: DataFrame, event_time: str, width: str = "1 hour", delay: str = "2 hours", by: tuple[str, ...] = ()) -> DataFrame:
    """Counts in windows of event time, late rows up to `delay` included (an extension of plain ingestion)."""
    rows = stream.withWatermark(event_time, delay) if stream.isStreaming else stream
    return rows.groupBy(F.window(event_time, width), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *by, "n")
